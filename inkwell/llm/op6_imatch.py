"""I-Match document fingerprints.

Document frequencies are counted over the whole corpus; terms whose inverse
document frequency lies in a band are the lexicon.  A text's fingerprint hashes
its sorted distinct lexicon terms once over the whole lexicon, and once over
each of ``LEVELS * EACH`` seeded random subsets of it.  Subsets come in levels
of halving density, so short and long texts alike have subsets in which only a
few of their terms lie, and such a subset often survives an edit.

The lexicon's size has a proven bound, whatever the corpus: a term of the band
is in at least ``LOW`` of all documents, so there are at most (mean distinct
terms of a document) / LOW of them, 8 bytes each.  It goes to all tasks.

Likeness of two fingerprints: 1 if equal (by the whole hash of 64 bits, and all subsets' hashes of 24); else, of the subsets of a level that
are not empty in both, the share with equal hashes, for the level where it is
highest (levels with fewer than ``FEW`` such subsets count as having FEW).

Neighbours (``with_next``) meet by a range partitioning on descending id, each
partition in order; only the partitions' first and last rows meet again.

Cases: null text is empty.  A text without lexicon terms is known by all its
terms, an empty one by none; equal texts have equal fingerprints.  Documents
with one id are ordered by text; null ids come last.  A lone document is its
own next.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, as_binary, mix, read, slices

#: The band of document frequencies, as shares of all documents.
LOW, HIGH = 0.001, 0.1
LEVELS, EACH, FEW = 9, 8, 4
#: Hex digits of the whole lexicon's hash, which equality rests on, and of a subset's; terms that a worker holds before it passes counts on.
WHOLE, DIGITS, HELD = 16, 6, 1_000_000

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> set[bytes]:
    """Distinct runs of letters and digits, lower case for ASCII."""
    return set(text.translate(_TERMS).split())


class Hashes:
    """64-bit hashes of terms, remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: set[bytes]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        known, h = self.known, xxhash.xxh3_64_intdigest
        for w in words:
            if w not in known:
                known[w] = h(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def _counts(batches):
    hashes = Hashes()
    held: list[np.ndarray] = []
    size = 0

    def out():
        t, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in slices(batches):
        for text in as_binary(batch.column("text")):
            held.append(hashes(terms(text)))
            size += len(held[-1])
        if size > 4 * HELD:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    total = docs.count()
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # At most (mean distinct terms) / low rows, see the module.
    some = counts.where((F.col("n") >= low * total) & (F.col("n") <= max(2.0, high * total))).select("term")
    return np.sort(some.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def _subsets() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, LEVELS * EACH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    below = np.array([2 ** (64 - 2 - k // EACH) for k in range(LEVELS * EACH)], np.uint64)
    return seeds, below


class Fingerprints:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.hashes, (self.seeds, self.below) = lexicon, Hashes(), _subsets()

    def __call__(self, text: bytes) -> list[str]:
        """The whole lexicon's hash, then each subset's; zeros where none of the terms is in it."""
        h = np.sort(self.hashes(terms(text)))
        none = "0" * DIGITS
        if len(self.lexicon) and len(h):
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            band = h[self.lexicon[at] == h]
        else:
            band = h[:0]
        digest = xxhash.xxh3_64_hexdigest
        out = [digest((band if len(band) else h).tobytes(), seed=len(band) > 0)[:WHOLE]]
        if not len(band):
            return out + [none] * len(self.seeds)
        chosen = mix(band[:, None] ^ self.seeds[None, :]) < self.below[None, :]
        for k in range(len(self.seeds)):
            part = band[chosen[:, k]]
            out.append(digest(part.tobytes())[:DIGITS] if len(part) else none)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    if a == b:
        return 1.0
    none, best = "0" * DIGITS, 0.0
    for level in range(LEVELS):
        x, y = a[1 + level * EACH : 1 + (level + 1) * EACH], b[1 + level * EACH : 1 + (level + 1) * EACH]
        some = sum(p != none or q != none for p, q in zip(x, y, strict=True))
        same = sum(p == q != none for p, q in zip(x, y, strict=True))
        best = max(best, same / max(FEW, some))
    return best


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _row(prints: Fingerprints, doc_id, text: str, own: list[str], after: str, next_: list[str]) -> tuple:
    new = edited(text, after).encode("utf-8", "surrogatepass")
    changed = prints(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), "".join(own), "".join(changed), likeness(own, changed), likeness(own, next_)


def _packed(batches):
    z = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        texts = as_binary(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id"), pa.array([xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts], pa.int64()), pa.array([z.compress(t) for t in texts], pa.binary())], names=["doc_id", "h", "z"])


def _in_order(lexicon: np.ndarray):
    """Rows of a partition in order -> results; the first and the last row as edges (their text packed), the last without result."""

    def run(batches):
        z, prints = zstandard.ZstdDecompressor(), Fingerprints(lexicon)
        part = TaskContext.get().partitionId()
        before = None

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.binary()]
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_NAMES, "part", "is_first", "z"])

        for batch in slices(batches, text="z", bytes_=1 << 20):
            rows = []
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("z").to_pylist(), strict=True):
                text = z.decompress(packed)
                now = (doc_id, text.decode("utf-8", "surrogatepass"), prints(text), packed)
                if before is None:
                    rows.append((doc_id, *[None] * 6, part, True, packed))
                else:
                    rows.append((*_row(prints, *before[:3], now[1], now[2]), None, None, None))
                before = now
            if rows:
                yield batch_of(rows)
        if before is not None:
            yield batch_of([(before[0], *[None] * 6, part, False, before[3])])

    return run


def _at_edges(lexicon: np.ndarray):
    def run(batches):
        z, prints = zstandard.ZstdDecompressor(), Fingerprints(lexicon)
        for batch in slices(batches, text="z", bytes_=1 << 20):
            rows = []
            for doc_id, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "z_next")), strict=True):
                text, after = z.decompress(a), z.decompress(b)
                rows.append(_row(prints, doc_id, text.decode("utf-8", "surrogatepass"), prints(text), after.decode("utf-8", "surrogatepass"), prints(after)))
            if rows:
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=_NAMES)

    return run


def with_next(docs: DataFrame, words: np.ndarray | None = None) -> DataFrame:
    """docs(doc_id, text) -> fingerprints of each text, of its edited text, and their likenesses."""
    scratch = Scratch(docs.sparkSession, "imatch")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = lexicon(docs) if words is None else words
    packed = docs.mapInArrow(_packed, "doc_id long, h long, z binary")
    order = [F.desc("doc_id"), F.asc("h")]
    rows = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    done = scratch.cut(rows.mapInArrow(_in_order(words), f"{_RESULT}, part int, is_first boolean, z binary"))
    # Two rows of each partition.
    edges = done.where("part is not null")
    place = edges.where("is_first").select("part", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("k"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("all"))
    first = edges.where("is_first").join(place, "part").select("k", F.col("z").alias("z_next"))
    last = edges.where("not is_first").join(place, "part").select("doc_id", "z", (F.pmod("k", "all") + 1).alias("k"))
    ends = last.join(first, "k").mapInArrow(_at_edges(words), _RESULT)
    return done.where("part is null").select(*_NAMES).union(ends)


def _printed(words: np.ndarray):
    def run(batches):
        prints = Fingerprints(words)
        for batch in slices(batches):
            out = ["".join(prints(t)) for t in as_binary(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, words: np.ndarray | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_printed(lexicon(docs) if words is None else words), "doc_id long, fingerprint string")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(read(spark, sf_dir, "documents"))
