import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm import op10_mixing as m

SCHEMA = "doc_id long, text string, source string, size string, quota string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), total=1.5, most=2):
    """Excess over the cap is shared anew by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, rest = {}, total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = most * sizes[s]
            rest -= capped[s]


def check(rows, docs):
    assert len(rows) == len(docs)
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 256, sizes[s] / 64), s


def test_small_table(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    first = m.op10_mixing(spark, sf).collect()
    check(first, docs)
    key = lambda r: r.doc_id
    assert sorted(first, key=key) == sorted(m.op10_mixing(spark, sf).collect(), key=key)


@pytest.fixture(scope="module")
def odd():
    docs = [(i, "w " * (37 * i % 900), None if i % 7 == 0 else "sé"[: i % 3] + "x") for i in range(80)]
    return [*docs, (1, None, "none"), (None, "a b", "b"), (1, "", ""), (5, "same row", "b"), (5, "same row", "b")]


def test_cells_grow_with_the_table(spark, odd, monkeypatch):
    monkeypatch.setattr(m, "CELLS", 2)
    monkeypatch.setattr(m, "CELL_ROWS", 9)
    monkeypatch.setattr(m, "SHARD", 500)
    df = spark.createDataFrame([(*d, "", "") for d in odd], SCHEMA)
    rows = m.mix(df).collect()
    assert len(rows) == len(odd) and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source for r in rows}:
        of = [r for r in rows if r.source == s]
        # A shard is cut into 64 blocks at least, so a block is a word or more of each.
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(16, of[0].source_size / 16), s


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*d, "", "") for d in odd], SCHEMA)
    check(m.mix(df).collect(), odd)
    assert m.mix(df.limit(0)).collect() == []


def test_mixed_documents(spark, odd):
    df = spark.createDataFrame([(*d, "a", "b") for d in odd], SCHEMA)
    out = m.mixed_documents(df)
    assert out.columns == df.columns
    words = F.coalesce(F.regexp_count("text", F.lit(m.WORD)), F.lit(0))
    got = {tuple(r) for r in out.groupBy("source").agg(F.sum(words)).collect()}
    want = {tuple(r) for r in m.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    assert got == want


def test_seats(spark):
    """Sainte-Lague by the highest quotients, one seat after another."""
    claims = [10.4, 0.4, 0.45, 3.5, 3.5, 7.2, 1.49, 0.0]
    for house in (20, 27, 35):
        df = spark.createDataFrame([("a", i, c, 99) for i, c in enumerate(claims)], "g string, k int, claim double, most int")
        got = {r.k: r.quota for r in m._seats(df, ["g"], "claim", "most", F.lit(house), ["k"]).collect()}
        seats = dict.fromkeys(range(len(claims)), 0)
        for _ in range(house):
            seats[min(seats, key=lambda k: (-claims[k] / (2 * seats[k] + 1), k))] += 1
        assert got == seats
