import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkwell.llm import op7_packing as m

SCHEMA = "doc_id long, text string, length string, part string"
TEXTS = [None, "", " ", "Hello World, it's 2024!", "a\x0bb\x0cc\x1cd\x85e\xa0f", "É é ñ", "x<|endoftext|>y <|startoftext|>", "don't  DON'T\n\n12345 \t日本語 テスト", "İstanbul ΣΑΣ", "<|ENDOFTEXT|> THE <|x", "a.b,c!!d?e*f# 1.5%; é: 's't don't, it's. x''y", "e\u0301. n\u0303!", "word " * 9000]


def check(rows, docs, sequence):
    t = Tokenizer.from_file(m.default_tokenizer())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for got, n in [(by_doc[i], len(ids[i])) for i in ids] + [(v, None) for v in by_seq.values()]:
        at = 0
        for start, length in sorted(got):
            assert start == at
            at += length
        assert at == n if n is not None else at <= sequence
    return sum(map(len, ids.values())) / (len(by_seq) * sequence)


def test_round_trip(spark):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "", "") for i, t in docs], SCHEMA).repartition(3)
    check(m.pack(df).collect(), docs, 2048)


def test_small_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(m.op7_packing(spark, sf).collect(), docs, 2048) > 0.98


def test_forgetting(spark, monkeypatch):
    monkeypatch.setattr(m, "REMEMBER", 3)
    docs = [(i, t) for i, t in enumerate(TEXTS[:12])]
    check(m.pack(spark.createDataFrame([(i, t, "", "") for i, t in docs], SCHEMA), sequence=16, piece=8).collect(), docs, 16)


def test_empty(spark):
    assert m.pack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_patterns(seed):
    r = random.Random(seed)
    hist = {n: r.choice([1, 3, 50, 1000]) for n in r.sample(range(1, 33), 12)}
    got = {n: [] for n in hist}
    for count, slots in m.shortest_pack_first(hist, 32):
        assert sum(n for n, _ in slots) <= 32
        for n, rank in slots:
            got[n] += range(rank, rank + count)
    assert {n: sorted(v) for n, v in got.items()} == {n: list(range(c)) for n, c in hist.items()}


def test_ids_over_all_of_unicode():
    """Every character before every kind of mark, after a letter and between letters, against the tokenizer itself."""
    import pyarrow as pa

    chunks, whole = m.Chunks(m.default_tokenizer()), Tokenizer.from_file(m.default_tokenizer())
    marks = ".,!?*#&$%;:"
    points = [c for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or 0xA000 <= c < 0xB000 or 0xF900 <= c < 0x12000 or 0x1D000 <= c < 0x1F900 or c % 97 == 0)]
    texts = [f"{chr(c)}{marks[c % 11]} a{chr(c)}{marks[(c + 3) % 11]}b H{chr(c)}!" for c in points]
    texts += [f"{x}{k}" for x in ("\u0130", "nation\u0130", "I\u0307", "J\u030c", "T\u0308", "W\u030a", "H\u0331", "\u00df", "\u1e9e", "\ufb01", "\u01c5") for k in marks]
    for start in range(0, len(texts), 4096):
        part = texts[start : start + 4096]
        ids, first = chunks.flat(pa.array(part))
        want = [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]
        wrong = [t for t, s, e, w in zip(part, first, first[1:], want, strict=False) if ids[s:e].tolist() != w]
        assert not wrong, wrong[:5]


def test_ids_of_mixed_strings():
    import pyarrow as pa

    r = random.Random(8)
    chunks, whole = m.Chunks(m.default_tokenizer()), Tokenizer.from_file(m.default_tokenizer())
    parts = [*"aZé\u0130\u0301\u030cJTß.,!?*#&$%;:'\"-_1٣Ⅷ日한ﬁΣς", "nation", "'s", "'LL", "<|", "|>", "endoftext", " ", "\n", "\u3000", "\u1680", "\x1c", "\x85", "😀", "\u200d", "\u0e33"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(20_000)]
    # One at a time too, as capitals are folded for a whole batch or not at all.
    for size in (1, 500):
        for start in range(0, 2000 if size == 1 else len(texts), size):
            part = texts[start : start + size]
            ids, first = chunks.flat(pa.array(part))
            for k, t in enumerate(part):
                assert ids[first[k] : first[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def held(chunks, words):
    """Bytes of Python, numpy and Arrow that stay after these words were tokenised, 1,000 in a text and 20 texts at a time."""
    import gc
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    chunks.flat(pa.array(["the first call"]))
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for start in range(0, len(texts), 20):
        chunks.flat(pa.array(texts[start : start + 20]))
    gc.collect()
    size = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    return size


def test_remembered_chunks_take_little_memory():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60_000)]
    assert held(m.Chunks(m.default_tokenizer()), words) < 100 * len(words)


def test_long_chunks_are_bounded_in_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(m, "REMEMBER_BYTES", 1 << 20, raising=False)
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij0123456789-.", k=2000)) for _ in range(4000)]
    chunks, whole = m.Chunks(m.default_tokenizer()), Tokenizer.from_file(m.default_tokenizer())
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    arrow = pa.total_allocated_bytes()
    for start in range(0, len(texts), 2):
        part = texts[start : start + 2]
        ids, first = chunks.flat(pa.array(part))
        if start % 20 == 0:
            assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]
    kept = sum(x.nbytes for x in (chunks.ids, chunks.start)) + pa.total_allocated_bytes() - arrow + sum(map(len, getattr(chunks, "at", ())))
    assert kept < 6 << 20
