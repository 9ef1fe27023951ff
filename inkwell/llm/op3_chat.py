"""Chat formatting with cumulative-snapshot collapse.

A logged conversation that is a prefix of a longer one is a snapshot of it.
Rolling hashes identify every prefix: the hash of the first n turns is the XOR
of hashes of (place, role, text), kept with two seeds, so 128 bits.  An
anti-join removes conversations whose whole hash is a proper prefix of another
conversation; of equal conversations, the one with the smallest conv_id stays.
What is left is rendered turn by turn.

DataFrame functions only.  Turns are partitioned by conversation, which a
rendered row has to hold whole anyhow; copies and frequent first turns are
pre-aggregated by hash.

Cases: turns are ordered by turn, then role, then text, nulls first; repeated
rows are turns of their own.  A null role or text differs from an empty one in
comparison and is rendered empty.  Rows without a conv_id take no part.  Empty
tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

#: What goes before the role, between role and text, and after the text.
CHATML = ("<|im_start|>", "\n", "<|im_end|>\n")


def maximal_conversations(turns: DataFrame, marks: tuple[str, str, str] = CHATML) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, n_turns, n_copies, n_chars, rendered."""
    scratch = Scratch(turns.sparkSession, "chat")
    turns = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order))
    said = [F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for seed in (1, 2):
        turns = turns.withColumn(f"h{seed}", F.bit_xor(F.xxhash64(F.lit(seed), *said)).over(upto))
    whole = Window.partitionBy("conv_id")
    prefixes = scratch.cut(turns.withColumn("turns", F.count("*").over(whole)).select("conv_id", "n", "turns", "h1", "h2"))
    full = prefixes.where("n = turns").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.first("turns").alias("n_turns"), F.count("*").alias("n_copies"))
    parts = prefixes.where("n < turns").select("h1", "h2").distinct()
    kept = full.join(parts, ["h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")
    before, between, after = (F.lit(m) for m in marks)
    line = F.concat(before, F.coalesce("role", F.lit("")), between, F.coalesce("text", F.lit("")), after)
    text = turns.select("conv_id", "n", line.alias("line")).join(kept, "conv_id")
    lines = F.sort_array(F.collect_list(F.struct("n", "line")))
    out = text.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))
    return out.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), "rendered")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(read(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, n, turns, sha256(string_agg(
      coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n'), '')
    OVER (PARTITION BY conv_id ORDER BY n)) AS h FROM t),
f AS (SELECT h, min(conv_id) AS conv_id, min(turns) AS n_turns, count(*) AS n_copies FROM p WHERE n = turns GROUP BY h),
k AS (SELECT * FROM f WHERE h NOT IN (SELECT h FROM p WHERE n < turns)),
r AS (
  SELECT t.conv_id, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered
  FROM t JOIN k ON t.conv_id = k.conv_id GROUP BY t.conv_id)
SELECT k.conv_id, n_turns, n_copies, CAST(length(rendered) AS BIGINT) AS n_chars, rendered FROM k JOIN r ON k.conv_id = r.conv_id
"""
