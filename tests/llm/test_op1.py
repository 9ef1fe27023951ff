import math
import random

import duckdb
import pytest

from inkwell.llm import op1_vafile as m


def brute(rows, k=10):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * x) for x in v]
            vectors[i] = min(w, vectors.get(i, w))
    out = []
    for q in sorted(i for i in vectors if i % 100 == 0):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vectors[q], v, strict=True)))), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def got(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    return sorted(tuple(r) for r in m.top_k(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, monkeypatch, seed):
    monkeypatch.setattr(m, "BLOCK", 37)
    monkeypatch.setattr(m, "QUERIES", 6)
    monkeypatch.setattr(m, "SAMPLE", 50)
    monkeypatch.setattr(m, "GROUP", 20)
    monkeypatch.setattr(m, "PART", 90)
    r = random.Random(seed)
    rows = [(i * 20, [r.choice([-0.5, 0.0, 0.25, r.gauss(0, 1)]) for _ in range(8)]) for i in range(300)]
    rows += [(7 + i, rows[i % 5][1]) for i in range(60)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5, -2.0]), (100, [0.5, -3.0]), (200, None), (300, [1.0, None]), (400, [nan, 1.0]), (500, [inf, 0.0]), (None, [1.0, 1.0]), (600, []), (601, []), (700, [3.0]), (-100, [-1e-9, 0.0]), (5, [1e18, 1e18]), (800, [1e18, -1e18]), (6, [1e12, 3.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0])]) == []


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in m.op1_vafile(spark, sf).collect()) == sorted(con.execute(m.SQL).fetchall())
