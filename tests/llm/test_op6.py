import hashlib
import re
import struct
from collections import Counter

import numpy as np
import xxhash

from inkwell.llm import op6_imatch as m


M64 = 2**64 - 1


def mixed(x: int) -> int:
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & M64
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & M64
    return x ^ (x >> 33)


def words(text: str) -> set[bytes]:
    """Terms as the docstring has them: runs of letters and digits, lower case for ASCII; all beyond ASCII is letters."""
    return {w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())}


def fingerprint(text: str, band: set[int]) -> list[str]:
    """A restatement over whole numbers: the whole hash, then each level's seeded subsets."""
    own = sorted(xxhash.xxh3_64_intdigest(w) for w in words(text))
    kept = [h for h in own if h in band]
    pack = lambda hs: struct.pack(f"<{len(hs)}Q", *hs)
    out = [xxhash.xxh3_64_hexdigest(pack(kept or own), seed=1 if kept else 0)]
    for k in range(72):
        seed = mixed((k + 1) * 0x9E3779B97F4A7C15 & M64)
        part = [h for h in kept if mixed(h ^ seed) < 2 ** (62 - k // 8)]
        out.append(xxhash.xxh3_64_hexdigest(pack(part))[:6] if part else "000000")
    return out


def alike(a: list[str], b: list[str]) -> float:
    levels = []
    for level in range(9):
        pairs = [(x, y) for x, y in zip(a[1 + 8 * level : 9 + 8 * level], b[1 + 8 * level : 9 + 8 * level], strict=True) if {x, y} != {"000000"}]
        levels.append(sum(x == y for x, y in pairs) / max(4, len(pairs)))
    return 1.0 if a == b else max(levels)


def brute(rows):
    docs = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh3_64_intdigest((r[1] or "").encode()) - 2**63))
    df = Counter(w for _, t in docs for w in words(t or ""))
    n = len(docs)
    band = {xxhash.xxh3_64_intdigest(w) for w, c in df.items() if 0.001 * n <= c <= max(2, 0.1 * n)}
    out = []
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % n][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (fingerprint(x, band) for x in (t, new, after))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c)))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, z string").repartition(3)
    return sorted((tuple(r) for r in m.with_next(df).collect()), key=str)


def test_odd_rows(spark):
    rows = [(i * 3 % 71, f"word{i % 7} té {i} 😀 " * (i % 9)) for i in range(60)] + [(5, None), (6, ""), (6, ""), (None, "lost"), (None, None), (7, "long " * 60000), (8, "x")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(4, "alone here")]) == brute([(4, "alone here")])


def test_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = m.op6_imatch(spark, sf).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows)
    plain = {r.doc_id: r.fingerprint for r in m.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in out}
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, plain[i]) == plain[i]


def test_edits_are_nearer_than_neighbours(spark):
    out = [r for r in m.op6_imatch(spark, "/root/testdata/sf0.01").collect() if r.n_chars >= 400 and r.near_next < 1]
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out]) + 0.1
    assert np.mean([r.near_edited > r.near_next for r in out]) > 0.8


def test_unlike_texts_without_lexicon_terms_do_not_collide():
    prints = m.Fingerprints(np.zeros(0, np.uint64))
    seen = {prints(b"only%d here" % i)[0] for i in range(300_000)}
    assert len(seen) == 300_000 and all(len(x) == 16 for x in seen)
