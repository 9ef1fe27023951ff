"""Each stage on what its predecessor kept, held against plain restatements."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from inkwell.llm import op4_pii, op7_packing, op10_mixing

from .test_op2 import brute as near_brute
from .test_op4 import plain
from .test_op10 import targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest documents with odd rows and a clashing column."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900, None, "en", "src0", 0, "y"), (901, "", None, None, 0, "y"), (902, "12 34 -- 56", "en", "src1", 11, "y"), (903, "write to a.b@mail.example.com now", "en", None, 33, "y"), rows[3], (904, "the long text " * 9000, "en", "src0", 126000, "y"), (None, "the nameless words of the text", "en", "src2", 30, "y")]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["documents"] = [tuple(r) for r in docs.collect()]
    for name, stage in p.STAGES:
        df = stage(spark, docs, folder)
        if name != "packing":
            assert df.columns == docs.columns and df.schema == docs.schema
        path = str(tmp_path_factory.mktemp("stages") / name)
        df.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = [tuple(r) for r in docs.collect()]
    return out


def test_names():
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "personal_data", "mixing", "packing"]


def test_language_id(stages):
    gone = Counter(stages["documents"]) - Counter(stages["language_id"])
    assert not Counter(stages["language_id"]) - Counter(stages["documents"])
    assert sorted(r[0] for r in gone) == [900, 901, 902]


def test_near_dedup(stages):
    rows = stages["language_id"]
    kept = {(i, n) for i, n, c, k in near_brute([(r[0], r[1]) for r in rows], k=5) if k or c is None}
    want = {r for r in rows if r[0] in {i for i, _ in kept}}
    assert sorted(stages["near_dedup"], key=str) == sorted(want, key=str)


def test_personal_data(stages):
    before = {r[0]: r for r in stages["near_dedup"]}
    for r in stages["personal_data"]:
        old = before[r[0]]
        assert (r[0], *r[2:4], r[5]) == (old[0], *old[2:4], old[5]) and r[4] == len(r[1])
        spans = plain(old[1])
        if not spans:
            assert r[1] == old[1] or re.search("<(email|ip|card|phone)>", r[1])
        for s, _, e in spans:
            assert old[1][s:e] not in r[1]
    assert len(before) == len(stages["personal_data"])
    assert next(r[1] for r in stages["personal_data"] if r[0] == 903) == "write to <email> now"


def test_mixing(stages):
    before, after = Counter(), Counter()
    words = {}
    for r in stages["personal_data"]:
        n = len(WORD.findall(r[1]))
        before[r[3]] += n
        words[r[0], r[3]] = n
    each = Counter()
    for r in stages["mixing"]:
        n = len(WORD.findall(r[1]))
        after[r[3]] += n
        each[r[0], r[3]] += n
    want = targets(before)
    assert all(abs(after[s] - want[s]) <= max(2, 256, before[s] / 64) for s in before)
    assert all(n <= 2 * words[k] for k, n in each.items())


def test_packing(stages):
    t = Tokenizer.from_file(op7_packing.default_tokenizer())
    want = Counter()
    for r in stages["mixing"]:
        ids = np.array([*t.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), op7_packing.PIECE):
            part = ids[s : s + op7_packing.PIECE]
            want[r[0], s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(r[:5] for r in stages["packing"]) == want
    ends = {}
    for *_, length, _, _, seq, offset in sorted((r for r in stages["packing"]), key=lambda r: (r[5], r[6])):
        assert offset == ends.get(seq, 0)
        ends[seq] = offset + length
    assert max(ends.values()) <= 2048 and sum(ends.values()) / (2048 * len(ends)) > 0.97


def test_run_is_its_stages(spark, folder, stages):
    assert Counter(tuple(r)[:5] for r in p.run(spark, folder).collect()) == Counter(r[:5] for r in stages["packing"])


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
    assert op4_pii.KINDS and op10_mixing.CELLS


def test_null_and_reused_ids(spark):
    """Each row is judged by its own text; of a group one row stays, with the smallest id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a + " more"), (5, b), (None, b + " more"), (None, c), (None, c), (None, c + " more"), (7, d), (7, d + " more"), (7, d), (8, "one text of id eight"), (8, "and quite another one"), (9, ""), (None, ""), (None, "")]
    out = p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = Counter((r.doc_id, r.text) for r in out)
    sevens, nulls = [x for x in got.elements() if x[0] == 7], [x for x in got.elements() if x[0] is None and x[1]]
    assert len(sevens) == 1 and sevens[0][1] in (d, d + " more")
    assert len(nulls) == 1 and nulls[0][1] in (c, c + " more")
    assert got == Counter([(1, a), (5, b), *sevens, *nulls, (8, "one text of id eight"), (8, "and quite another one"), (9, ""), (None, ""), (None, "")])


def test_columns_named_as_helpers(spark):
    """Helper columns keep clear of the table's own."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, 1, "t", 7, 8), (2, a + " more", 2, "t", 7, 8), (3, b, 3, "t", 7, 8), (3, b, 3, "t", 7, 8), (3, a, 4, "u", 7, 8), (3, "quite another text of id three", 5, "v", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n long, __t string, __id long, __OWN long")
    out = p.near_dedup(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) == sorted([rows[0], rows[2], rows[5]])
