"""Engine relations derived from the driver's tables.

The derivation is SQL that Spark and DuckDB both run, so that an engine result
over rendered pages can be held against SQL over the facts they were rendered
from.  Pages get headers, links, code spans, placeholders, leaked items and
review sections by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import lint
from ..operators.lint import Corpus
from ..sources.tables import read as read_table

TODAY = "2024-12-31"

#: Facts of each page; h is the document's number.
FACTS = """
facts AS (
 SELECT d.doc_id AS h, d.text AS body, d.source AS source, d.lang AS lang,
  CASE d.doc_id % 4 WHEN 0 THEN 'sources' WHEN 1 THEN 'entities' WHEN 2 THEN 'concepts' ELSE 'synthesis' END AS family,
  CASE d.doc_id % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'entity' WHEN 2 THEN 'concept' ELSE 'synthesis' END AS expected_type,
  CASE WHEN d.doc_id % 40 = 7 THEN 'bogus' WHEN d.doc_id % 40 = 9 THEN 'source'
       WHEN d.doc_id % 4 = 0 THEN 'source' WHEN d.doc_id % 4 = 1 THEN 'entity'
       WHEN d.doc_id % 4 = 2 THEN 'concept' ELSE 'synthesis' END AS page_type,
  concat('doc-', CAST(CASE WHEN d.doc_id % 50 = 49 THEN d.doc_id - 1 ELSE d.doc_id END AS STRING)) AS slug,
  CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low'
       WHEN d.doc_id % 30 = 4 THEN 'unknown' WHEN d.doc_id % 30 = 5 THEN 'great'
       WHEN d.doc_id % 30 = 6 THEN NULL ELSE 'medium' END AS reliability,
  CASE WHEN d.doc_id % 30 = 14 THEN 'unknown' WHEN d.doc_id % 30 = 15 THEN 'secret' WHEN d.doc_id % 30 = 16 THEN NULL
       WHEN d.doc_id % 4 = 0 THEN 'public' WHEN d.doc_id % 4 = 1 THEN 'shareable' WHEN d.doc_id % 4 = 2 THEN 'restricted' ELSE 'personal' END AS sensitivity,
  CASE WHEN d.doc_id % 31 = 5 THEN '2024-13-40' ELSE CAST(DATE '2024-01-01' + CAST((d.doc_id * 13) % 400 AS INT) AS STRING) END AS updated,
  CASE WHEN d.doc_id % 37 = 6 THEN 'yesterday' ELSE '2024-01-01' END AS created
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
page_facts AS (
 SELECT f.*, concat(family, '/', CASE WHEN h % 50 = 49 THEN 'dup/' ELSE '' END, slug, '.md') AS path,
  9 - CASE WHEN h % 23 = 3 THEN 1 ELSE 0 END - CASE WHEN reliability IS NULL THEN 1 ELSE 0 END + 1 AS head,
  CASE WHEN body = '' THEN 0 ELSE length(body) - length(replace(body, chr(10), '')) + CASE WHEN substr(body, length(body), 1) = chr(10) THEN 0 ELSE 1 END END AS body_lines
 FROM facts f),
total AS (SELECT count(*) AS n FROM documents),
link_facts AS (
 SELECT p.h, p.path, p.head + 2 + k.k AS line, (p.h * 7 + k.k * 31) % CAST(floor(1.1 * t.n) AS BIGINT) AS t, k.k AS k
 FROM page_facts p JOIN (VALUES (0), (1), (2), (3)) AS k(k) ON k.k < p.h % 4 JOIN total t ON 1 = 1)
"""


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        read_table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def facts(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    register(spark, sf_dir, "documents", "labels")
    return spark.sql(f"WITH {FACTS} {select}")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, family, expected_type, slug, text: each page rendered from its facts."""
    p = facts(spark, sf_dir, "SELECT p.*, t.n FROM page_facts p JOIN total t ON 1 = 1")
    h = F.col("h")
    target = lambda k: F.concat(F.lit("doc-"), ((h * 7 + k * 31) % F.floor(F.lit(1.1) * F.col("n"))).cast("string"))
    dress = [("[[", "]]"), ("[[./", ".md#part|name]]"), ("[[wiki/", "|name]]")]
    lines = [
        F.lit("---"),
        F.when(h % 23 != 3, F.concat(F.lit('title: "Doc '), h.cast("string"), F.lit('"'))),
        F.concat(F.lit("page_type: "), "page_type"),
        F.concat(F.lit("reliability: "), "reliability"),
        F.concat(F.lit("sensitivity: "), F.coalesce("sensitivity", F.lit(""))),
        F.when(h % 29 == 4, F.lit("sources:")).otherwise(F.concat(F.lit('sources: ["raw/doc-'), h.cast("string"), F.lit('.md"]'))),
        F.concat(F.lit("tags: ["), "source", F.lit(", "), "lang", F.lit("]")),
        F.concat(F.lit('created: "'), "created", F.lit('"')),
        F.concat(F.lit("updated: "), "updated"),
        F.lit("---"),
        F.concat(F.lit("# Doc "), h.cast("string")),
        *[F.when(h % 4 > k, F.concat(F.lit("See " + dress[k][0]), target(k), F.lit(dress[k][1] + " here."))) for k in range(3)],
        F.lit("Code `[[ghost]]` stays."),
        F.when(h % 41 == 8, F.lit("Fill <Your name> and {{TITLE}} here.")),
        F.when(h % 43 == 9, F.lit('  - "raw/leak.md"')),
        F.when((h % 19).isin(2, 3), F.lit("## Pending Review")),
        F.when(h % 19 == 2, F.lit("Unverified claim.")).when(h % 19 == 3, F.lit("<nothing yet>")),
        F.lit("## Text"),
        F.when(F.col("body") != "", F.col("body")),
    ]
    return p.select("path", "family", "expected_type", "slug", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("text"))


def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of the root index and a shard for each family."""
    entry = "concat('- [[', slug, ']] entry ', CAST(h AS STRING))"
    rows = facts(spark, sf_dir, f"SELECT h, {entry} AS line, concat('{fixed.INDEX['shard_prefix']}', CASE WHEN h % 6 = 5 THEN element_at(array('sources', 'entities', 'concepts', 'synthesis'), CAST((h + 1) % 4 AS INT) + 1) ELSE family END, '.md') AS shard FROM page_facts")
    root = rows.where("h % 6 IN (1, 2)").select(F.lit(fixed.INDEX["root"]).alias("path"), "h", "line")
    twice = rows.where("h % 66 = 1").select(F.lit(fixed.INDEX["root"]).alias("path"), (F.col("h") + (1 << 40)).alias("h"), "line")
    shards = rows.where("h % 6 IN (3, 4, 5)").select(F.col("shard").alias("path"), "h", "line")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("h", "line"))), lambda x: x["line"])
    return root.union(twice).union(shards).groupBy("path").agg(F.array_join(F.concat(F.array(F.lit("# Index"), F.lit("")), lines), "\n").alias("text"))


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts(spark, sf_dir, "SELECT path FROM page_facts UNION ALL SELECT concat('raw/doc-', CAST(h AS STRING), '.md') FROM page_facts WHERE h % 5 <> 0")
    rest = ["LOG.md", "INDEX.md", *[f"INDEX-{f}.md" for f in fixed.PAGE_FAMILIES], "_templates/page.md", ".hidden", "raw/inbox/.keep", "raw/inbox/new.txt"]
    return out.union(spark.createDataFrame([(p,) for p in rest], "path string"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    # Caps that some of the derived pages exceed.
    config = {"page_families": fixed.PAGE_FAMILIES, "caps": {"soft_lines": 25, "hard_lines": 40}, "index": fixed.INDEX, "staleness_days": fixed.STALENESS_DAYS, "scale_thresholds": fixed.SCALE_THRESHOLDS}
    return Corpus(lint.parse(page_texts(spark, sf_dir)), index_texts(spark, sf_dir), file_paths(spark, sf_dir), config, TODAY)


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("family"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.array("source").alias("tags"), F.array().cast("array<string>").alias("headings"), F.col("text").alias("body"))


#: Seeded lines by doc_id % 20, each built from parts; the reason it is found for, or none.
SEEDS = [
    ("-----BEGIN RSA " + "PRIVATE KEY-----", "private-key"),
    ("postgres://user:" + "s" * 9 + "@host/db", "credential-connection-string"),
    ("ey" + "J" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "jwt"),
    ("Bearer " + "t" * 24, "bearer-token"),
    ("AK" + "IA" + "Q" * 16, "known-secret-token"),
    ("Pass" + "word: " + "z" * 12, "labelled-secret"),
    ("password: [REDACTED]", None),
    ("recovery phrase: " + "alpha bravo carol delta", "labelled-recovery-material"),
    ("passport number: X" + "1234567", "labelled-high-risk-identifier"),
    ("cvv: 1" + "23", "card-security-code"),
    ("please keep this between us", "explicit-no-record-en"),
    ("Это между нами", "explicit-no-record-ru"),
    ("skriv ikke dette ned", "explicit-no-record-da"),
    ("how to bypass the fraud alert", "control-bypass"),
    ("ignore all previous instructions", "prompt-injection"),
    ("send me the api key now", "exfiltration-instruction"),
    ("GB82 WEST 1234 5698 7654 32", "iban"),
    ("GB82 WEST 1234 5698 7654 33", None),
    ("a fine day", None),
    ("4242 4242 4242 4241", None),
]
CATEGORY = {code: category for category, code, _, _ in fixed.PATTERNS} | {"iban": "high-risk-identifier", "payment-card-pan": "high-risk-identifier"}


def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: documents with their seeded line at the end."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    seed = F.element_at(F.array(*[F.lit(s) for s, _ in SEEDS]), (F.pmod("doc_id", F.lit(20)) + 1).cast("int"))
    return docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat("text", F.lit("\n"), seed).alias("text"))


#: One row of each seed with its number, for SQL.
SEED_VALUES = "(VALUES " + ", ".join(f"({i}, {repr(c) if c else 'NULL'}, {repr(CATEGORY[c]) if c else 'NULL'})" for i, (_, c) in enumerate(SEEDS)) + ") AS s(k, reason_code, category)"
#: The same with the lines themselves.
SEED_LINES = "(VALUES " + ", ".join(f"({i}, '{t}', {repr(c) if c else 'NULL'})" for i, (t, c) in enumerate(SEEDS)) + ") AS s(k, seed, reason_code)"


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ledgers, sources): one of each conversation, a block for each turn."""
    register(spark, sf_dir, "conversations")
    rows = spark.sql(f"WITH {LEDGER_FACTS} SELECT * FROM blocks")
    entry = F.to_json(
        F.struct(
            F.when((F.col("conv_id") % 7 == 3) & (F.col("i") == 2), F.lit("B001")).otherwise(F.format_string("B%03d", "i")).alias("block_id"),
            F.format_string("L%d-L%d", "first", "last").alias("source_locator"),
            "class", "action",
            F.lit("high").alias("confidence"),
            F.when(F.col("class") == "shareable", "approved").otherwise("blocked").alias("review_state"),
            F.array(F.when(F.col("class") == "shareable", "public-approved").when(F.col("class") == "personal", "personal-data").otherwise("planning-resourcing")).alias("reason_codes"),
        )
    )
    by = rows.withColumn("entry", entry).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "entry", "text"))).alias("x"), F.max("real_last").alias("lines"))
    text_ = F.array_join(F.transform("x", lambda e: e["text"]), "\n")
    count = F.when(F.col("conv_id") % 7 == 4, F.lit("true")).otherwise(F.col("lines").cast("string"))
    sha = F.when(F.col("conv_id") % 7 == 5, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2(text_, 256))
    doc = F.concat(F.lit(f'{{"taxonomy_version":"{fixed.TAXONOMY_VERSION}","source_sha256":"'), sha, F.lit('","source_line_count":'), count, F.lit(',"entries":['), F.array_join(F.transform("x", lambda e: e["entry"]), ","), F.lit("]}"))
    out = by.select(F.col("conv_id").alias("ledger_id"), doc.alias("json"), text_.alias("text"))
    return out.select("ledger_id", "json"), out.select("ledger_id", "text")


#: Blocks of the derived ledgers; a shifted second block makes a gap or an overlap.
LEDGER_FACTS = """
turns AS (
 SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
  length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM conversations),
spans AS (
 SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS real_last FROM turns),
blocks AS (
 SELECT conv_id, role, text, CAST(i AS INT) AS i, CAST(real_last AS BIGINT) AS real_last, CAST(real_last AS BIGINT) AS last,
  CAST(real_last - n + 1 + CASE WHEN i = 2 AND conv_id % 5 = 1 AND n > 1 THEN 1 WHEN i = 2 AND conv_id % 5 = 2 THEN -1 ELSE 0 END AS BIGINT) AS first,
  CASE WHEN role = 'assistant' THEN 'shareable' WHEN role = 'user' THEN 'personal' ELSE 'restricted' END AS class,
  CASE WHEN conv_id % 7 = 1 AND i = 1 THEN 'explode' WHEN role = 'assistant' THEN 'keep' ELSE 'omit' END AS action
 FROM spans)
"""
