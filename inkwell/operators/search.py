"""Ranked retrieval: field-weighted BM25.

An index is three DataFrames: postings (doc, term, tf), documents with their
length, and one row of corpus totals.  A search touches only the postings of
its terms: a pushed-down filter where the index is stored by term, and where it
is not, other words leave a document's array before anything is exploded or
shuffled.  Hits are aggregated per document, and the top k taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


@dataclass
class SearchIndex:
    postings: DataFrame  # doc, term, tf
    docs: DataFrame  # doc, family, title, length
    totals: DataFrame  # n, average
    words: DataFrame | None = None  # doc, words array<struct<term, w>>, of an index that is not written

    def hits(self, terms: list[str]) -> DataFrame:
        """The postings of the terms."""
        if self.words is None:
            return self.postings.where(F.col("term").isin(*terms))
        wanted = F.filter("words", lambda x: x["term"].isin(*terms))
        return self.words.select("doc", F.inline(wanted)).groupBy("doc", "term").agg(F.sum("w").alias("tf"))

    def write(self, path: str) -> None:
        """Postings sorted by term, so that a search reads the row groups of its terms only."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark, path: str) -> SearchIndex:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "docs", "totals")))


def headings(body: Column) -> Column:
    """Texts of the ATX headings; an empty heading takes the next non-blank line, as the blanks after its marks may cross lines."""
    return F.regexp_extract_all(body, F.lit(r"(?md)^#{1,6}\s+(.*)$"), F.lit(1))


def parse_tags(raw: Column) -> Column:
    inner = F.regexp_replace(text.strip(raw), r"(?s)^\[(.*)\]\z", "$1")
    return F.filter(F.transform(F.split(inner, ","), lambda t: F.regexp_replace(t, r"""(?U)^[\s"']+|[\s"']+\z""", "")), lambda t: t != "")


def parse_page(content: Column) -> tuple[Column, Column]:
    """(header map, body): an unclosed header keeps its keys and leaves no body."""
    lines = text.split_lines(content)
    opens = (F.size(lines) > 0) & (text.strip(F.get(lines, F.lit(0))) == "---")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    at = F.array_position(F.transform(rest, text.strip), "---").cast("int")
    head = F.when(~opens, text.no_strings()).when(at > 0, F.slice(rest, F.lit(1), at - 1)).otherwise(rest)
    key = r"^([\p{L}\p{N}_]+):\s*(.*)$"
    pairs = F.transform(F.filter(head, lambda x: x.rlike(key)), lambda x: F.struct(F.regexp_extract(x, key, 1).alias("k"), text.strip(F.regexp_extract(x, key, 2)).alias("v")))
    last = text.let(pairs, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["k"] == x["k"])))
    body = F.when(~opens, content).when(at > 0, F.array_join(F.slice(rest, at + 1, F.size(rest)), "\n")).otherwise("")
    return F.map_from_entries(last), body


def build_index(docs: DataFrame) -> SearchIndex:
    """docs(doc, family, title, tags array, headings array, body) -> index.

    Each field's tokens are counted with the field's weight; one shuffle by
    (doc, term), pre-aggregated, as the text itself never moves.
    """
    fields = {
        "title": text.tokens(F.coalesce("title", F.lit(""))),
        "tags": F.flatten(F.transform(F.coalesce("tags", text.no_strings()), text.tokens)),
        "headings": F.flatten(F.transform(F.coalesce("headings", text.no_strings()), text.tokens)),
        "body": text.tokens(F.coalesce("body", F.lit(""))),
    }

    def weigh(weight: int):
        return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))

    weighted = F.concat(*[F.transform(x, weigh(fixed.FIELD_WEIGHTS[n])) for n, x in fields.items()])
    words = docs.select("doc", weighted.alias("words"))
    postings = words.select("doc", F.inline("words")).groupBy("doc", "term").agg(F.sum("w").alias("tf"))
    length = sum(fixed.FIELD_WEIGHTS[n] * F.size(x) for n, x in fields.items()).cast("long")
    lengths = docs.select("doc", "family", "title", length.alias("length"))
    totals = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))
    return SearchIndex(postings, lengths, totals, words)


def query_terms(query: str) -> Column:
    """Distinct terms in the query's order."""
    return F.array_distinct(text.tokens(F.lit(query)))


def terms_of(spark, query: str) -> list[str]:
    """The query's terms on the driver: a row of constants, which needs no job."""
    return spark.sql("SELECT 1").select(query_terms(query)).first()[0]


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def score(index: SearchIndex, query: str) -> DataFrame:
    """doc, family, title, score, matched (terms in the query's order) of every document with a term of the query."""
    terms = terms_of(index.docs.sparkSession, query)
    place = F.array_position(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), F.col("term")).cast("int") - 1
    hits = index.hits(terms).withColumn("pos", place)
    # At most a row for each term of the query.
    df = F.broadcast(document_frequencies(hits.select("doc", "term")))
    # One row of totals.
    totals = F.broadcast(index.totals.withColumn("one", F.lit(1)))
    parts = hits.join(df, "term").join(index.docs, "doc").withColumn("one", F.lit(1)).join(totals, "one")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ratio = F.when(F.col("average") > 0, F.col("length") / F.col("average")).otherwise(1.0)
    part = idf * F.col("tf") * (fixed.K1 + 1) / (F.col("tf") + fixed.K1 * (1 - fixed.B + fixed.B * ratio))
    scored = parts.withColumn("part", part).groupBy("doc", "family", "title").agg(
        F.sum("part").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("matched")
    )
    return scored.where("score > 0")


def search(index: SearchIndex, query: str, top: int = 10) -> DataFrame:
    """The top documents: score descending, ties by family and document (paths part by part).

    ``top`` as a slice end: 0 gives none, a negative one drops that many from the end.
    """
    found = score(index, query)
    key = F.split(F.col("doc").cast("string"), "/") if dict(index.docs.dtypes)["doc"] == "string" else F.col("doc")
    if top < 0:
        top = max(0, found.count() + top)
    return found.orderBy(F.desc("score"), "family", key).limit(top)


def render(results: DataFrame) -> DataFrame:
    """Text lines as a terminal shows them."""
    return results.select(F.format_string("%6.2f  %s  — %s", "score", F.col("doc").cast("string"), F.coalesce("title", F.lit(""))).alias("line"))
