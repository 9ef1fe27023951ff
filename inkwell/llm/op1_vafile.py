"""Exact top-k search with a vector-approximation file.

The file holds blocks of vectors: their ids, for each component the cell of a
grid that it falls into (one byte), the block's own bounds, and the exact
integer vectors.  A search scans the cells for bounds on each query's score
with each vector, and then reads exact vectors in the order of their upper
bounds, until the k-th score found is above every bound that is left (for
distances: in lower-bound order until the k-th is certain).  Results are exact.

Grid lines are quantiles of at most ``SAMPLE`` vectors and only affect speed:
outer cells end at the block's own extremes, so bounds hold for any data.
Queries are a table, dealt into groups of some ``GROUP``, and the file into
parts of some ``PART`` vectors.  Each group meets each part in one task, which
is bounded both ways and answers with at most k rows for each query; a grouped
top-k joins the answers.  Nothing but the grid comes to the driver.

Scores are inner products of floor(1024 * component).  They are exact while
they fit in 64 bits; beyond, they stop at the limits of a long.

Cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows without a vec_id.  Of rows with one vec_id, the one whose
vector is smallest (by components) counts, so repeated rows count once.
Vectors of different length have no score; empty ones score 0 with each other.
Ties go to the smaller vec_id.  Empty tables give empty results.  Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lowest, read

SCALE, CELLS, SAMPLE = 1024, 64, 4096
#: Vectors of a block, queries compared at once, exact vectors read at once for a query.
BLOCK, QUERIES, READ = 2048, 2048, 32
#: Queries of a group and vectors of a part of the file, which meet in one task.
GROUP, PART = 1 << 14, 1 << 13
#: Largest absolute sum up to which float64 arithmetic on integers is exact.
EXACT = 2.0**53


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<double> of whole numbers; see the module for what takes part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad).withColumn("v", F.transform("e", lambda x: _floor(x * scale)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _floor(x):
    """As double: the result may be beyond a long.  Never negative zero."""
    near = F.rint(x)
    return F.when(near > x, near - 1).otherwise(near) + F.lit(0.0)


def _grid(rows: DataFrame) -> dict[int, np.ndarray]:
    """Of each vector length in the sample: CELLS - 1 grid lines for each component."""
    some = lowest(rows.select("v", F.xxhash64("vec_id").alias("h")), SAMPLE, "h").collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(len(r.v), []).append(r.v)
    return {n: np.quantile(np.array(v), np.linspace(0, 1, CELLS + 1)[1:-1], axis=0, method="nearest") for n, v in by.items() if n}


def _blocks(grid):
    """(vec_id, v) -> blocks of the file."""

    def block(ids: list[int], v: np.ndarray):
        n = v.shape[1]
        lines = grid.get(n, np.zeros((CELLS - 1, n)))
        cells = np.empty(v.shape, np.uint8)
        for j in range(n):
            cells[:, j] = np.searchsorted(lines[:, j], v[:, j], side="right")
        low, high = (v.min(axis=0), v.max(axis=0)) if n else (np.zeros(0), np.zeros(0))
        return n, len(ids), np.array(ids, np.int64).tobytes(), cells.tobytes(), low.tobytes(), high.tobytes(), v.tobytes()

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            out = []
            for n in np.unique(np.diff(off)).tolist():
                at = np.flatnonzero(np.diff(off) == n)
                for s in range(0, len(at), BLOCK):
                    part = at[s : s + BLOCK]
                    out.append(block(ids[part].tolist(), np.array([flat[off[i] : off[i + 1]] for i in part], np.float64).reshape(len(part), n)))
            names = ["n", "rows", "ids", "cells", "low", "high", "exact"]
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray | list[int]:
    """Exact inner products of one query with vectors."""
    if not len(q) or np.abs(q).max() * np.abs(v).max(initial=0) * len(q) < EXACT:
        return (v @ q).astype(np.int64).tolist()
    whole = [int(x) for x in q]
    return [max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(whole, row, strict=True)))) for row in v.tolist()]


def _block(row: dict) -> dict:
    n, rows = row["n"], row["rows"]
    return {"ids": np.frombuffer(row["ids"], np.int64), "cells": np.frombuffer(row["cells"], np.uint8).reshape(rows, n), "low": np.frombuffer(row["low"]), "high": np.frombuffer(row["high"]), "exact": np.frombuffer(row["exact"]).reshape(rows, n)}


def _scan(b: dict, lines: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, best: dict[int, list[tuple[int, int]]]):
    """A block's vectors into the best of each query: bounds from the cells, then exact vectors in bound order."""
    # Each cell's ends, within the block's extremes; one below the next line, as components are whole.
    start = np.clip(np.vstack([b["low"][None], lines]), b["low"], b["high"])
    end = np.clip(np.vstack([lines, b["high"][None]]), b["low"], b["high"])
    cols = np.arange(q.shape[1])
    low, high = start[b["cells"], cols], end[b["cells"], cols]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    upper = plus @ high.T + minus @ low.T
    # Products in floating point may be off by rounding once they are large.
    size = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) if q.shape[1] else np.zeros_like(upper)
    upper = upper + np.where(size < EXACT, 0.0, size * 1e-9)
    lower = plus @ low.T + minus @ high.T - np.where(size < EXACT, 0.0, size * 1e-9)
    # One more than k, as a query's own vector takes no part.
    at = max(0, lower.shape[1] - k - 1)
    kth = np.partition(lower, at, axis=1)[:, at] if lower.shape[1] > k else np.full(len(q), -np.inf)
    for i, qid in enumerate(q_ids.tolist()):
        got = best.setdefault(qid, [])
        floor = max(float(kth[i]), -got[-1][0] if len(got) == k else -np.inf)
        left = np.flatnonzero(upper[i] >= floor)
        left = left[np.argsort(-upper[i, left], kind="stable")]
        for s in range(0, len(left), READ):
            part = left[s : s + READ]
            if len(got) == k and upper[i, part[0]] < -got[-1][0]:
                break
            scores = _products(q[i], b["exact"][part])
            got += [(-x, int(v)) for x, v in zip(scores, b["ids"][part].tolist(), strict=True) if v != qid]
            got.sort()
            del got[k:]


def _search(grid, k: int):
    """A part of the file and a group of queries -> (query_id, vec_id, score), at most k rows for each query."""

    def run(file: pa.Table, asked: pa.Table) -> pa.Table:
        best: dict[int, list[tuple[int, int]]] = {}
        lists = asked.column("v").combine_chunks()
        ids, off, flat = asked.column("vec_id").to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        wide = np.diff(off)
        for i in range(file.num_rows):
            row = file.slice(i, 1).to_pylist()[0]
            n = row["n"]
            at = np.flatnonzero(wide == n)
            if not len(at):
                continue
            b, lines = _block(row), grid.get(n, np.zeros((CELLS - 1, n)))
            for s in range(0, len(at), QUERIES):
                some = at[s : s + QUERIES]
                q = flat[off[some][:, None] + np.arange(n)].astype(np.float64).reshape(len(some), n)
                _scan(b, lines, ids[some], q, k, best)
        rows = [(qid, v, -x) for qid, got in best.items() for x, v in got]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, query: str = "vec_id % 100 = 0", k: int = 10, scale: int = SCALE) -> DataFrame:
    """table(vec_id, embedding) -> query_id, rank, vec_id, score: the k highest for each row that ``query`` selects."""
    spark = table.sparkSession
    scratch = Scratch(spark, "vafile")
    rows = scratch.cut(whole_vectors(table, scale))
    grid = _grid(rows)
    file = scratch.cut(rows.mapInArrow(_blocks(grid), "n int, rows int, ids binary, cells binary, low binary, high binary, exact binary"))
    asked = rows.where(query)
    parts, groups = (max(1, -(-n // each)) for n, each in ((rows.count(), PART), (asked.count(), GROUP)))
    asked = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    file = file.select("*", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    found = file.groupBy("g", "p").cogroup(asked.groupBy("g", "p")).applyInArrow(_search(grid, k), "query_id long, vec_id long, score long")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "score"))), 1, k)
    # In two steps, so that no group has the answers of all tasks at once.
    found = found.withColumn("part", F.spark_partition_id() % 64).groupBy("query_id", "part").agg(best.alias("best"))
    found = found.select("query_id", F.explode("best").alias("x")).select("query_id", "x.vec_id", "x.score")
    found = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("p", "x"))
    return found.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op1_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
