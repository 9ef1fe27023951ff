import random
import re

import numpy as np
import pytest

from inkwell.llm import op2_minhash as m

SCHEMA = "doc_id long, text string, node string, band string"


def brute(rows, k=2, num=80, den=100):
    def shingles(t):
        t = re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            return frozenset()
        return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a)), i == least.get(find(a))) for a, (i, s) in enumerate(sets)), key=str)


def got(spark, data, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], SCHEMA)
    return sorted((tuple(r) for r in m.near_duplicates(df, **kw).collect()), key=str)


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 9, 30, 80, 200]))]
        for _ in range(r.choice([1, 2, 4, 12])):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "nodes"), [(1 << 18, 1500), (200, 1500), (1 << 18, 2)])
def test_against_brute_force(spark, monkeypatch, block, nodes):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "NODES", nodes)
    rows = corpus()
    assert got(spark, rows, words=2) == brute(rows)


def test_many_components_in_one_bucket(spark, monkeypatch):
    """Bands of one row: buckets hold unlike documents, so blocks have work."""
    monkeypatch.setattr(m, "BLOCK", 400)
    monkeypatch.setattr(m, "NODES", 7)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{shared} " + " ".join(f"u{i // 3}x{j}" for j in range(30)) + f" z{i}") for i in range(30)]
    assert got(spark, rows, words=2, bands=40, rows=1) == brute(rows)


def test_near_copies_of_near_copies(spark, monkeypatch):
    """One large cluster in which many documents are unlike its centre."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(60)] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    for block in (1 << 18, 700):
        monkeypatch.setattr(m, "BLOCK", block)
        assert got(spark, rows, words=2) == brute(rows)


def test_overlaps():
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(200), r.randint(1, 90))), np.uint64) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) if a is not b else None for b in sets] for a in sets]
    got = m._overlaps(sets, few=9)
    assert all(want[i][j] is None or want[i][j] == got[i, j] for i in range(50) for j in range(50))


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    rows = corpus(9)
    assert got(spark, rows, words=2) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE"), (6, "ÉA b"), (7, "éa b"), (8, "a b"), (8, "a b"), (None, "q r s t"), (9, "x " * 50000), (10, "x\x85x y"), (None, "A B")]
    assert got(spark, rows, words=2) == brute(rows)
    assert got(spark, [], words=2) == []


def test_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = m.op2_minhash(spark, sf)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, small tables are written by a few tasks: each file costs processes and time."""
    from pyspark.sql import functions as F

    from inkwell.llm.common import Scratch

    files, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: (out := cut(self, df), files.append(out.select(F.input_file_name()).distinct().count()))[0])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    r = random.Random(5)
    rows = []
    for g in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        rows += [(10 * g + i, " ".join(base + [f"x{i}"])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    try:
        for k, v in zip(old, ("17", "false"), strict=True):
            spark.conf.set(k, v)
        out = m.near_duplicates(docs).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {x.doc_id: x.component_id for x in out} == {i: i // 10 * 10 for i, _ in rows}
    assert max(files) <= spark.sparkContext.defaultParallelism
