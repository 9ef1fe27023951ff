import hashlib
import random

import numpy as np
import pytest

from inkwell.llm import op9_suffix as m


def brute(rows, length=50):
    docs = [(m.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in docs:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((None if i == m.LAST else i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sum string, first long").repartition(3)
    return sorted((tuple(r) for r in m.remove_repeats(df, **kw).collect()), key=str)


def corpus(seed, alphabet="ab", n=40):
    r = random.Random(seed)
    passages = ["".join(r.choice(alphabet) for _ in range(r.randint(8, 40))) for _ in range(12)]
    return [(r.randrange(60), "".join(r.choice(passages)[: r.randint(1, 40)] for _ in range(r.randint(0, 14)))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 12), (3, 20), (4, 6)])
def test_against_brute_force(spark, monkeypatch, seed, length):
    monkeypatch.setattr(m, "CHUNK", 700)
    rows = corpus(seed)
    assert got(spark, rows, length=length) == brute(rows, length)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    p = "A passage of more than fifty bytes that many documents hold, é and ß too. "
    rows = [(1, None), (2, ""), (3, p), (3, p), (4, p), (5, p[:49]), (6, p[:49]), (7, "x" + p + "y"), (8, p[1:51]), (None, p), (None, p), (9, "z" * 30000), (10, "z" * 60), (11, p + p), (0, p[:50])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in m.op9_suffix(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 60 + "c")], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in m.remove_repeats(df, texts=True).collect()} == {1: b"a" * 60, 2: b"bc"}


def test_plain_doubling_finds_the_same_starts(spark):
    r = random.Random(6)
    base = "".join(r.choice("abc ") for _ in range(400))
    rows = [(i, base[r.randrange(300) :][: r.randrange(120)] + "é" * r.randrange(3) + base[r.randrange(300) :][: r.randrange(90)]) for i in range(25)] + [(3, base), (None, base[:70]), (7, None), (9, "")]
    got = {(x.id, x.row, x.pos) for x in m.doubled_positions(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    texts = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(i, least.get(t[p : p + 50], i))
    want = {(i, k, p) for k, (i, t) in enumerate(texts) for p in range(len(t) - 49) if least[t[p : p + 50]] < i}
    assert got == want and len(want) > 100
