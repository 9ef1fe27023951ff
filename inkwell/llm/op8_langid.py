"""Language identification by Bayesian evidence fusion.

The posterior of a language given a page is proportional to

  text likelihood (naive Bayes over hashed letter trigrams, tempered, as
  neighbouring trigrams depend on each other)
  x P(declared language | language)
  x P(address suffix | language), counted over all pages
  x host prior, smoothed host <- domain <- all pages, counted over all pages.

Counts are grouped sums of the posterior from text and declaration alone; a
page's own part is taken out of what it is given.  The languages are all that
any row with a text declares, over all rows and without a least count; of each,
text likelihoods are trained on a bounded number of texts (``SAMPLE`` shared
evenly, or ``EACH`` where that is more).  All counts cover all rows.

Cases: null or letterless text has no text evidence and is rejected.  Unknown,
null or foreign declarations, hosts and suffixes give no evidence.  Rows without
a host are spread over salted keys, so they don't meet in one task.  Repeated
rows are each returned.  Without labelled rows, the result has no language and
rejects every row.  Empty tables give empty results.  Extra columns are kept by
``identify``.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, slices

#: Labelled rows that the text likelihoods are trained on, fewest of each language that has so many, and the part of a text that is read.
SAMPLE, EACH, LONGEST = 800, 50, 20_000
BUCKETS = 1 << 14
#: Trigrams' worth of evidence that a text of any length has at most.
EVIDENCE = 60.0
#: Probability that a declaration is right; weight of the wider level in a host prior.
DECLARED, SMOOTH = 0.9, 4.0
#: Hosts up to which their counts are broadcast; beyond, a shuffle join is used, but for hosts with over one in HOT of all rows.
BROADCAST_ROWS, HOT = 100_000, 1000

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams; runs of other characters are one blank."""
    b = _KEEP[np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)]
    b = b[~((b == 32) & (np.concatenate((np.zeros(1, np.uint8), b[:-1])) == 32))] if len(b) else b
    if not (b != 32).any():
        return np.zeros(0, np.int64)
    b = np.concatenate(([32], b, [32])).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def train(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket by language) from (text, language) rows."""
    names = sorted({lang for _, lang in rows})
    counts = np.full((BUCKETS, len(names)), 0.5)
    for text, lang in rows:
        t = trigrams(text)
        if len(t):
            # A long text counts no more than a page of it would.
            counts[:, names.index(lang)] += np.bincount(t, minlength=BUCKETS) * min(1.0, 2000 / len(t))
    return names, np.log(counts / counts.sum(axis=0))


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """rows(text, declared): of every declared language, the texts with the lowest hashes."""
    told = rows.where("declared is not null and text is not null").select("text", "declared", F.xxhash64("text").alias("h"))
    # Only keys are ranked, and each task sends no more than SAMPLE of a language.
    keys = told.select("declared", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("declared").orderBy("h")))
    found = {r.declared: sorted(r.hs) for r in keys.where(F.col("n") <= SAMPLE).groupBy("declared").agg(F.collect_list("h").alias("hs")).collect()}
    if not found:
        return train([])
    each = max(SAMPLE // len(found), EACH)
    lines = rows.sparkSession.createDataFrame([(lang, hs[:each][-1]) for lang, hs in found.items()], "declared string, line long")
    some = told.join(F.broadcast(lines), "declared").where("h <= line")
    # Copies of a text count once in a language, so the sample is bounded.
    some = some.groupBy("declared", "h").agg(F.min(F.left("text", F.lit(LONGEST))).alias("text")).orderBy("h", "declared")
    return train([(r.text, r.declared) for r in some.collect()])


def _scored(model, columns: list[str]):
    names, table = model

    def run(batches):
        for batch in slices(batches):
            out, n = [], []
            for text in batch.column("text").to_pylist():
                t = trigrams(text)
                n.append(len(t))
                out.append(table[t].sum(axis=0) * min(1.0, EVIDENCE / len(t)) if len(t) else np.zeros(len(names)))
            ll = pa.array([x.tolist() for x in out], pa.list_(pa.float64()))
            yield pa.record_batch([*[batch.column(c) for c in columns], ll, pa.array(n, pa.int64())], names=[*columns, "__ll", "__n"])

    return run


def _total(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, y: a + y)


def _softmax(df: DataFrame, name: str, logs: list[Column]) -> DataFrame:
    """df with an array of probabilities.  Each step is a column, so the plan grows with the number of languages and not with its powers."""
    df = df.withColumn("__logs", F.array(*logs))
    df = df.withColumn("__e", F.transform("__logs", lambda x: F.exp(x - F.array_max("__logs"))))
    return df.withColumn(name, F.transform("__e", lambda x: x / _total("__e"))).drop("__logs", "__e")


def _with_host(rows: DataFrame, table: DataFrame, total: float) -> DataFrame:
    """rows with the counts of their ``__host``, if it has any."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), "__host", "left")
    counts = [c for c in table.columns if c != "__host"]
    host = table.select("__host", F.struct(*counts).alias("__of"), (sum(F.col(c) for c in counts if c.startswith("h")) * HOT > total).alias("__hot"))
    # Fewer than HOT rows: each has more than one in HOT of all.
    hot = F.broadcast(host.where("__hot").select("__host", F.col("__of").alias("__hot")))
    cold = host.where("not __hot").select(F.col("__host").alias("__key"), "__of")
    salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("text"), F.lit(4096)).cast("string"))
    rows = rows.join(hot, "__host", "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__host")).otherwise(salt))
    rows = rows.join(cold, "__key", "left").withColumn("__of", F.coalesce("__hot", "__of"))
    return rows.select("*", *[F.col("__of").getField(c).alias(c) for c in counts]).drop("__key", "__hot", "__of")


def identify(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    """rows(text, declared, host, domain, suffix, ...) -> the columns ``keep``, language, probability, accepted."""
    names, _ = model
    spark = rows.sparkSession
    scratch = Scratch(spark, "langid")
    if not names:
        return rows.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("accepted"))
    k = len(names)
    right, wrong = math.log(DECLARED), math.log((1 - DECLARED) / max(1, k - 1))
    columns = rows.columns
    scored = rows.mapInArrow(_scored(model, columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __ll array<double>, __n long")
    known = F.col("declared").isin(*names)

    def said(i: int) -> Column:
        return F.when(known, F.when(F.col("declared") == names[i], F.lit(right)).otherwise(F.lit(wrong))).otherwise(F.lit(0.0))

    scored = _softmax(scored, "__p", [F.col("__ll")[i] + said(i) for i in range(k)])
    scored = scored.withColumn("__p", F.when(F.col("__n") > 0, F.col("__p")))
    # Rows without a host match nothing; salting keeps them from meeting in one task.
    scored = scored.withColumn("__host", F.coalesce("host", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("text"), F.lit(4096)).cast("string"))))

    def sums(df: DataFrame, by: list[str], what) -> DataFrame:
        return df.groupBy(*by).agg(*[F.sum(what(i)).alias(f"s{i}") for i in range(k)])

    counted = scored.where("__n > 0 and host is not null")
    hosts = scratch.cut(sums(counted, ["host", "domain", "suffix"], lambda i: F.col("__p")[i]))
    total = hosts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).first()
    total = [x or 0.0 for x in total]
    share = [(x + 1) / (sum(total) + k) for x in total]
    domains = sums(hosts, ["domain"], lambda i: F.col(f"s{i}"))
    suffixes = sums(hosts, ["suffix"], lambda i: F.col(f"s{i}"))
    n_suffixes = suffixes.count()

    def renamed(df: DataFrame, letter: str) -> DataFrame:
        return df.select(*[F.col(c).alias(letter + c if re.fullmatch(r"s\d+", c) else c) for c in df.columns])

    table = renamed(hosts, "h").join(renamed(domains, "d"), "domain", "left").join(renamed(suffixes, "x"), "suffix", "left")
    # A null domain or suffix joins nothing and is no evidence.
    table = scratch.cut(table.drop("domain", "suffix").withColumnRenamed("host", "__host"))
    # One row of each host: a host has one domain and one suffix.
    out = _with_host(scored, table, sum(total))
    own = [F.when(F.col("__n") > 0, F.col("__p")[i]).otherwise(F.lit(0.0)) for i in range(k)]

    def less(letter: str, i: int) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.col(f"{letter}s{i}"), F.lit(0.0)) - F.when(F.col(f"{letter}s{i}").isNotNull(), own[i]).otherwise(F.lit(0.0)))

    for x in "hd":
        out = out.withColumn(f"__{x}", F.array(*[less(x, i) for i in range(k)]))
    out = out.withColumn("__hs", _total("__h")).withColumn("__ds", _total("__d"))
    domain = [(F.col("__d")[i] + SMOOTH * share[i]) / (F.col("__ds") + SMOOTH) for i in range(k)]
    prior = [(F.col("__h")[i] + SMOOTH * domain[i]) / (F.col("__hs") + SMOOTH) for i in range(k)]
    suffix = [F.when(F.col("xs0").isNotNull(), F.log((less("x", i) + 1) / (F.lit(total[i]) + n_suffixes + 1))).otherwise(F.lit(0.0)) for i in range(k)]
    logs = [F.col("__ll")[i] + said(i) + suffix[i] + F.log(prior[i]) for i in range(k)]
    out = _softmax(out, "__q", logs)
    best = F.array_max(F.transform(F.arrays_zip(F.col("__q").alias("q"), F.array(*[F.lit(x) for x in names]).alias("l")), lambda x: F.struct(x["q"].alias("q"), x["l"].alias("l"))))
    out = out.withColumn("__best", F.when(F.col("__n") > 0, best))
    return out.select(*keep, F.col("__best.l").alias("language"), F.col("__best.q").alias("probability"), (F.coalesce(F.col("__best.q"), F.lit(0.0)) >= 0.5).alias("accepted"))


#: Elements whose content is not text of the page, what ends them, comments and tags.
_UNSEEN = re.compile(r"<(script|style|nav|footer)\b", re.I)
_ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "nav", "footer")} | {"!--": re.compile("-->"), "": re.compile(">")}
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_LONG_NUMBER = re.compile(r"&#[0-9]{20,};?")


def visible_text(page: str) -> str:
    """The page without comments, tags and unseen elements, each a blank, and with entities resolved.

    One scan forward: an end that was looked for is kept, and what has no end
    further on is not looked for again, so any page takes linear time.  A
    comment or element that never ends is a tag; a tag that never ends is text.
    """
    out: list[str] = []
    at, ends = 0, {}

    def end_of(kind: str, start: int) -> int:
        if kind not in ends or 0 <= ends[kind][0] < start:
            found = _ENDS[kind].search(page, start)
            ends[kind] = found.span() if found else (-1, -1)
        return ends[kind][1]

    while (tag := page.find("<", at)) >= 0:
        unseen = _UNSEEN.match(page, tag)
        end = end_of("!--", tag + 4) if page.startswith("<!--", tag) else end_of(unseen[1].lower(), tag) if unseen else -1
        if end < 0:
            end = end_of("", tag)
        if end < 0:
            break
        out += (page[at:tag], " ")
        at = end
    out.append(page[at:])
    # Numbers beyond any character are one replacement character, however long.
    return html.unescape(_LONG_NUMBER.sub("\ufffd", "".join(out)))


def declared_language(page: str) -> str | None:
    """What the first html tag that has a lang attribute says, lower case."""
    at = 0
    while tag := _HTML.search(page, at):
        end = page.find(">", tag.end())
        end = len(page) if end < 0 else end
        said = _LANG.search(page, tag.end(), end)
        if said:
            return said[1].lower()
        at = end
    return None


def _parsed(batches):
    """(page_id, url, html) -> page_id, text, declared, host, domain, suffix."""
    for batch in slices(batches, text="html"):
        cols: list[list] = [[], [], [], [], []]
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = page or ""
            host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
            host = host[1].lower() if host else None
            labels = host.split(".") if host else []
            row = (visible_text(page), declared_language(page), host, ".".join(labels[-2:]) if labels else None, labels[-1] if len(labels) > 1 else None)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        yield pa.record_batch([batch.column("page_id"), *[pa.array(c, pa.string()) for c in cols]], names=["page_id", "text", "declared", "host", "domain", "suffix"])


def pages_as_rows(pages: DataFrame) -> DataFrame:
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_parsed, "page_id long, text string, declared string, host string, domain string, suffix string")


def documents_as_rows(docs: DataFrame) -> DataFrame:
    """A document's ``lang`` is its declaration and its ``source`` its host; it has no suffix.  All columns are kept in ``__row``."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("declared"),
        F.col("source").cast("string").alias("host"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("suffix"),
    )


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents with an identified language, all columns as they were."""
    rows = documents_as_rows(docs)
    out = identify(rows, fit(rows), ["__row", "text"]).where("accepted")
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages_as_rows(read(spark, sf_dir, "pages"))
    return identify(rows, fit(rows), ["page_id", "declared", "host"])
