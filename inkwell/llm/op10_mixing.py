"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's words are cut into blocks of (nearly) equal length.  Blocks are
dealt to sources, then within a source to its shards, by highest quotients
claim / (2 * seats + 1).  A shard's quota of q blocks out of n takes every block
q // n times and q % n of them, by a seeded permutation, once more; so no word
is taken more than ``most`` times (2).

Built from DataFrame functions only.  A source is split over hashed cells, at
least ``CELLS`` and so many that a cell has some ``CELL_ROWS`` rows at most, so
a source with a third of all rows is spread at any size; one shuffle keyed by
(source, cell) carries the rows.  Apportionment starts from the rounded
claims, which is a Sainte-Lague result for its own sum, and moves the few seats
that the sum is off by in order of quotients.

Cases: null text has no words and is never taken.  A null source is a source
like any other, last in order.  Repeated rows are rows of their own.  A source
without words has target 0.  Empty tables give empty results.  Extra columns
are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, few, read

#: Fewest hashed cells that a source is spread over, and rows that a cell has at most, or so, if all rows are of one source.
CELLS, CELL_ROWS = 4096, 1 << 15
#: Words of a block, fewest blocks that a shard is cut into, and words of a shard.
BLOCK, LEAST_BLOCKS, SHARD = 256, 64, 1 << 16
#: Multipliers of the seeded permutation; no block count is a multiple of all three.
PRIMES = (1_000_003, 998_244_353, 1_000_000_007)

_S = ["__no", "__s"]


def _seats(df: DataFrame, by: list[str], claim: str, most: str, house: Column, key: list[str]) -> DataFrame:
    """Sainte-Lague seats for each row within ``by``; house: how many there are in all."""
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    df = df.withColumn("__a", F.least(F.floor(F.col(claim) + 0.5), F.col(most)))
    df = df.withColumn("__d", F.greatest(house - F.sum("__a").over(all_), -F.sum("__a").over(all_)))
    # Next seats to give (d > 0) by highest quotient, or to take back (d < 0) by lowest.
    steps = df.where("__d <> 0").withColumn("__j", F.explode(F.sequence(F.lit(1), F.abs("__d").cast("int"))))
    seat = F.when(F.col("__d") > 0, F.col("__a") + F.col("__j")).otherwise(F.col("__a") - F.col("__j") + 1)
    steps = steps.withColumn("__seat", seat).where(f"__seat between 1 and {most}")
    steps = steps.withColumn("__q", F.col(claim) / (2 * F.col("__seat") - 1) * F.signum("__d"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    steps = steps.withColumn("__n", F.row_number().over(order.orderBy(F.desc("__q"), *key)))
    moved = steps.where("__n <= abs(__d)").groupBy(*by, *key).agg(F.sum(F.signum("__d")).cast("long").alias("__m"))
    on = [*by, *key]
    return df.join(moved, on, "left").withColumn("quota", (F.col("__a") + F.coalesce("__m", F.lit(0))).cast("long")).drop("__a", "__d", "__m")


def _plan(cells: DataFrame, scratch: Scratch, weights, total: float, most: int, n_cells: int, rows: int) -> DataFrame:
    """cells(__no, __s, __cell, words), ``rows`` at most -> with the source's size and target, the shard, its blocks and quota, and the cell's first word in it."""
    sources = cells.groupBy(*_S).agg(F.sum("words").alias("source_size"))
    # Aggregated rows: one of each source.
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("__rank", F.row_number().over(one.orderBy(*_S))).withColumn("weight", w)
    sources = sources.withColumn("__cap", F.col("source_size").cast("double") * most)
    before = one.orderBy(F.col("__cap") / F.col("weight"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = total * F.sum("source_size").over(one) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("__level", level)
    # The level at the first source that stays below its cap holds for all that do.
    free = F.col("__level") * F.col("weight") <= F.col("__cap")
    sources = sources.withColumn("__final", F.min(F.when(free, F.struct(F.col("__cap") / F.col("weight"), F.col("__rank"), F.col("__level").alias("l")))).over(one)["l"])
    sources = sources.withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__final") * F.col("weight"), F.col("__cap"))))
    sources = sources.withColumn("__shards", F.least(F.lit(n_cells), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD))).cast("int"))
    sources = sources.select(*_S, "source_size", "target", "__shards")

    placed = scratch.cut(few(cells.join(sources, _S).withColumn("__shard", F.pmod("__cell", "__shards")), rows))
    shards = placed.groupBy(*_S, "__shard").agg(F.sum("words").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = F.least(F.col("shard_size"), F.greatest(F.lit(LEAST_BLOCKS), F.round(F.col("shard_size") / BLOCK).cast("long")))
    shards = scratch.cut(few(shards.where("shard_size > 0").withColumn("blocks", blocks.cast("long")), rows))
    each = shards.groupBy(*_S).agg(F.sum("blocks").alias("source_blocks"), F.first("source_size").alias("n"), F.first("target").alias("target"))
    each = each.withColumn("claim", F.col("source_blocks") * F.col("target") / F.col("n")).withColumn("top", F.col("source_blocks") * most)
    each = _seats(each, [], "claim", "top", F.round(F.sum("claim").over(one)), _S).withColumnRenamed("quota", "source_quota")
    shards = shards.join(each.select(*_S, "source_blocks", "source_quota"), _S)
    shards = shards.withColumn("claim", F.col("source_quota") * F.col("blocks") / F.col("source_blocks")).withColumn("top", F.col("blocks") * most)
    shards = _seats(shards, _S, "claim", "top", F.col("source_quota"), ["__shard"])
    shards = shards.select(*_S, "__shard", "shard_size", "blocks", "quota")
    start = Window.partitionBy(*_S, "__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__first", F.coalesce(F.sum("words").over(start), F.lit(0)))
    return scratch.cut(few(placed.join(shards, [*_S, "__shard"], "left").select(*_S, "__cell", "__shard", "source_size", "target", "shard_size", "blocks", "quota", "__first"), rows))


def _times(block: Column, seed: int) -> Column:
    """How often the mix takes a block of the row's shard."""
    n, q = F.col("blocks"), F.col("quota")
    a = F.when(n % PRIMES[0] != 0, F.lit(PRIMES[0])).when(n % PRIMES[1] != 0, F.lit(PRIMES[1])).otherwise(F.lit(PRIMES[2]))
    shift = F.pmod(F.xxhash64(F.lit(seed), *_S, "__shard"), n)
    return F.floor(q / n) + F.when(F.pmod(F.pmod(a, n) * block + shift, n) < F.pmod(q, n), F.lit(1)).otherwise(F.lit(0))


def _drawn(docs: DataFrame, weights, total: float, most: int, seed: int) -> DataFrame:
    """docs with size, source_size, target, taken, and what is needed to find the words taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    n_cells = CELLS
    rows = docs.count()
    while n_cells * CELL_ROWS < rows:
        n_cells *= 2
    docs = docs.withColumn("__no", F.col("source").isNull()).withColumn("__s", F.coalesce("source", F.lit("")))
    docs = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    docs = docs.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("__cell", F.pmod("__h", F.lit(n_cells)).cast("int"))
    cells = scratch.cut(few(docs.groupBy(*_S, "__cell").agg(F.sum("size").alias("words")), rows))
    plan = _plan(cells, scratch, weights, total, most, n_cells, rows)
    order = Window.partitionBy(*_S, "__cell").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = docs.join(plan, [*_S, "__cell"])
    out = out.withColumn("__at", F.col("__first") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    begin, end = F.col("__at"), F.col("__at") + F.col("size")

    def block(word: Column) -> Column:
        return F.call_function("div", word * F.col("blocks"), F.col("shard_size"))

    def edge(j: Column) -> Column:
        return F.call_function("div", j * F.col("shard_size") + F.col("blocks") - 1, F.col("blocks"))

    taken = F.aggregate(
        F.sequence(block(begin), block(end - 1)),
        F.lit(0).cast("long"),
        lambda acc, j: acc + (F.least(end, edge(j + 1)) - F.greatest(begin, edge(j))) * _times(j, seed),
    )
    return out.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=(5, 2, 1), total: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken."""
    return _drawn(docs.select("doc_id", "text", "source"), weights, total, most, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), total: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that words of a document are taken.

    A document of which only some blocks are taken has these words with the
    white space before them; one that is taken whole keeps its text.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text", "source")]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(0)
    out = _drawn(docs.select("doc_id", "text", "source", kept.alias("__kept")), weights, total, most, seed).where("taken > 0")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int") + F.lit(0))))
    first = F.least("taken", "size")
    share = F.when(F.col("__copy") == 1, first).otherwise(F.col("taken") - F.col("size"))

    def take(word: Column, i: Column) -> Column:
        times = _times(F.call_function("div", (F.col("__at") + i) * F.col("blocks"), F.col("shard_size")), seed)
        # Copy 1 has the words taken at all, copy 2 those taken twice.
        return times >= F.col("__copy")

    part = F.array_join(F.filter(words, take), "")
    whole = (F.col("taken") == F.col("size") * most) | ((F.col("__copy") == 1) & (F.col("quota") >= F.col("blocks"))) | (share == F.col("size")) & (F.col("quota") < F.col("blocks"))
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).where("text <> ''")
    back = {c: F.col(f"__kept.c{i}").alias(c) for i, c in enumerate(others)}
    if "n_chars" in back:
        back["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return out.select(*[back.get(c, F.col(c)) for c in columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
