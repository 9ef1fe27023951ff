"""Removal of repeated substrings by prefix doubling.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id.  Prefix doubling ranks positions by prefixes of
doubling length: the pair of ranks at p and p + h is p's rank at length 2h; a
position whose rank is unique is settled and drops out; ranking ends at the
threshold.  Here the first ranks are at half the threshold and the second
doubling ends it.  Sorting every position of a corpus at every length would
move many times the corpus, so positions drop out as early as they can:

1. Ranks at half length are sorted for synchronised positions only: in every
   LENGTH-byte string, the position whose half-length rank is least.  Equal
   strings choose equal positions, so a string whose chosen rank is unique to
   one document is unique itself, and is settled.
2. Rank pairs of one in ``EVERY`` of the strings that are left (by distance to
   the chosen position, so copies choose alike) are sorted.  Most of a repeat
   is settled by these, as strings that overlap cover what is between them.
3. Chosen ranks with strings that are still open are announced.
4. Rank pairs of all strings at announced ranks are sorted, which settles all.

A rank is the 64-bit hash of its prefix, so that equal prefixes have equal
ranks without a global renumbering; in step 1 and 3 its first 40 bits, where an
accident costs time only.

Texts are packed into chunks of about ``CHUNK`` bytes.  A chunk sends each rank
once, with its smallest document, so a passage that a third of all documents
share is sent once per chunk, and is answered with one bit.  Equal texts are
one document with the smallest id; the others go whole.

Cases: null text is empty.  Texts under LENGTH bytes lose nothing.  Rows with
equal doc_id are not smaller than each other, whatever their texts; null ids
are larger than all others.  Empty tables give empty results.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, as_binary, mix, read, slices, trim

LENGTH, EVERY = 50, 8
#: Bytes of a chunk, and bytes of text for each range of ranks that one task sorts.
CHUNK, RANGE = 2 << 20, 16 << 20
#: Rows and bytes up to which a side is broadcast; beyond, a shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
LAST = 2**63 - 1
_M = np.uint64(0x9E3779B97F4A7C15)
_UPPER = np.uint64(2**64 - 2**15)


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit ranks of the length-byte strings at all positions, by doubling."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rank, have = data.astype(np.uint64) + np.uint64(1), 1
    while have * 2 <= length:
        rank = rank[:-have] * _M + rank[have:]
        rank ^= rank >> np.uint64(29)
        have *= 2
    return mix(rank[:n] * _M + rank[length - have : length - have + n])


def least_positions(rank: np.ndarray, width: int) -> np.ndarray:
    """For each p the first position of the least rank in [p, p + width); at most 2**15 ranks, compared by their upper bits."""
    n = len(rank) - width + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    key = (rank & _UPPER) | np.arange(len(rank), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return (np.minimum(key[:n], key[width - have : width - have + n]) & ~_UPPER).astype(np.int32)


def ranks_and_least(data: np.ndarray, half: int, width: int, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Both for all positions, in blocks that stay in a core's cache."""
    n = len(data)
    ranks, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for s in range(0, n, block):
        rank = prefix_ranks(data[s : s + block + half + width - 2], half)
        ranks.append(rank[:block])
        least.append(least_positions(rank, width)[:block] + np.int32(s))
    return np.concatenate(ranks), np.concatenate(least)


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the place of each key among them, the order that sorts the keys, and where each begins in it."""
    order = np.argsort(keys)
    in_order = keys[order]
    new = np.concatenate((np.ones(min(1, len(keys)), bool), in_order[1:] != in_order[:-1]))
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return in_order[starts], place, order, starts


def _least(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values[order], starts) if len(starts) else values[:0]


class Chunk:
    """The state of a chunk's texts, rebuilt from the answers so far."""

    def __init__(self, row: dict, ranges: int, length: int, answers: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.bytes = zstandard.ZstdDecompressor().decompress(row["z"])
        self.ranges, self.length, half = ranges, length, length // 2
        data = np.frombuffer(self.bytes, np.uint8)
        rank, least = ranks_and_least(data, half, length - half + 1)
        sizes = np.diff(self.ends, prepend=0)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), sizes)
        last = np.repeat((self.ends - length).astype(np.int32), sizes)[: len(least)]
        at = np.flatnonzero(last >= np.arange(len(least), dtype=np.int32)).astype(np.int32)
        # Chosen positions never step back, so they are grouped as they are: one for each run.
        chosen = least[at]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), chosen[1:] != chosen[:-1])))
        chosen, runs = chosen[first], np.diff(first, append=len(at))
        self.names, self.name_of, order, starts = _grouped(rank[chosen] >> np.uint64(24))
        if answers < 1:
            own = self.ids[doc[chosen]][order]
            self.several = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts) if len(starts) else np.zeros(0, bool)
            return
        shared = self._answer(row["a1"], self.names, 40)
        self.shared_names = self.names[shared]
        kept = shared[self.name_of]
        at = at[np.repeat(kept, runs)]
        name = np.repeat(self.name_of[kept], runs[kept])
        some = (least[at] - at) % EVERY == 0
        owner = self.ids[doc[at]]

        def pairs(which: np.ndarray):
            p = at[which]
            u, place, order, starts = _grouped(mix(rank[p] * _M + rank[p + length - half]))
            return u, place, _least(owner[which], order, starts)

        def smaller(which, answer):
            return at[which][self._answer(answer, self.pairs, 64)[place] | (self.smallest[place] < owner[which])]

        # Each step rebuilds only what it needs: the last one what the second and the fourth found.
        if answers != 3:
            self.pairs, place, self.smallest = pairs(some)
        if answers < 2:
            return
        if answers != 3:
            found = smaller(some, row["a2"])
        if answers < 3:
            before = np.concatenate((np.zeros(1, np.int32), np.cumsum(self._cover(found), dtype=np.int32)))
            open_ = ~some & (before[at + length] - before[at] < length)
            self.open = np.zeros(len(self.names), bool)
            self.open[name[open_]] = True
            self.open = self.open[shared]
            return
        asked = np.zeros(len(self.names), bool)
        asked[np.flatnonzero(shared)[self._answer(row["a3"], self.shared_names, 40)]] = True
        rest = ~some & asked[name]
        self.pairs, place, self.smallest = pairs(rest)
        if answers < 4:
            return
        self.covered = self._cover(np.concatenate([found, smaller(rest, row["a4"])]))

    def _cover(self, starts: np.ndarray) -> np.ndarray:
        """Which bytes strings at distinct starts cover."""
        step = np.zeros(len(self.bytes) + 1, np.int32)
        step[starts] += 1
        step[starts + self.length] -= 1
        return np.cumsum(step, dtype=np.int32)[:-1] > 0

    def parts(self, names: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
        """(range, start, end) of the sorted names."""
        # By the upper 32 bits; only ranges that have names are visited, however many there are.
        own = ((names >> np.uint64(bits - 32)) * np.uint64(self.ranges)) >> np.uint64(32)
        at = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)])) if len(own) else np.zeros(1, np.int64)
        return [(int(own[s]), s, e) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _answer(self, answers: list[dict] | None, names: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(len(names), bool)
        got = {a["range"]: a["bits"] for a in answers or ()}
        for r, s, e in self.parts(names, bits):
            out[s:e] = _unbits(got[r], e - s)
        return out


def _asks(ranges: int, length: int, step: int):
    """Step 1 to 4 -> (range, chunk, names, more): more has flags in steps 1 and 3, documents in 2 and 4."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row, ranges, length, step - 1)
                out = []
                if step in (1, 3):
                    names, flags = (c.names, c.several) if step == 1 else (c.shared_names, c.open)
                    for r, s, e in c.parts(names, 40):
                        out.append((r, row["chunk"], e - s, names[s:e].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), _bits(flags[s:e])))
                else:
                    for r, s, e in c.parts(c.pairs, 64):
                        docs, at = np.unique(c.smallest[s:e], return_inverse=True)
                        out.append((r, row["chunk"], e - s, c.pairs[s:e].tobytes(), np.concatenate([docs.view(np.uint8), at.astype(np.uint32 if len(docs) > 65536 else np.uint16).view(np.uint8), np.array([len(docs)], np.int64).view(np.uint8)]).tobytes()))
                trim()
                if out:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "chunk", "n", "names", "more"])

    return run


def _documents(data: bytes, n: int) -> np.ndarray:
    k = int(np.frombuffer(data[-8:], np.int64)[0])
    return np.frombuffer(data[: 8 * k], np.int64)[np.frombuffer(data[8 * k : -8], np.uint32 if k > 65536 else np.uint16)]


def _sorted_range(step: int):
    """All asks of one range -> an answer for each: is the rank in several documents (1), open anywhere (3), in a smaller document (2, 4)?"""

    def run(table: pa.Table) -> pa.Table:
        trim()
        n = table.column("n").to_pylist()
        names, more = table.column("names").to_pylist(), table.column("more").to_pylist()
        if step in (1, 3):
            wide = np.zeros((sum(n), 8), np.uint8)
            wide[:, :5] = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 5)
            key, value = wide.view(np.uint64).ravel(), np.concatenate([_unbits(m, k) for m, k in zip(more, n, strict=True)])
        else:
            key, value = np.frombuffer(b"".join(names), np.uint64), np.concatenate([_documents(m, k) for m, k in zip(more, n, strict=True)])
        order = np.argsort(key)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        sizes = np.diff(starts, append=len(key))
        if step in (1, 3):
            group = np.logical_or.reduceat(value[order], starts)
            if step == 1:
                group |= sizes > 1
            answer = np.repeat(group, sizes)
        else:
            answer = np.repeat(np.minimum.reduceat(value[order], starts), sizes) < value[order]
        back = np.empty(len(key), bool)
        back[order] = answer
        ends = np.cumsum(n)
        bits = [_bits(back[e - k : e]) for e, k in zip(ends.tolist(), n, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})

    return run


def _chunked(size: int):
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0
        z = zstandard.ZstdCompressor(level=3)

        def out():
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            cols = [pa.array([(part << 32) + k]), pa.array([held]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([z.compress(b"".join(texts))], pa.binary())]
            return pa.record_batch(cols, names=["chunk", "bytes", "ids", "ends", "z"])

        for batch in slices(batches, bytes_=1 << 20):
            for i, t in zip(batch.column("id").to_pylist(), as_binary(batch.column("text")), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= size:
                    yield out()
                    ids, texts, held, k = [], [], 0, k + 1
        if ids:
            yield out()

    return run


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _results(ranges: int, length: int, texts: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0], ranges, length, 4)
                data, start, rows = np.frombuffer(c.bytes, np.uint8), 0, []
                for doc, end in zip(c.ids.tolist(), c.ends.tolist(), strict=True):
                    gone = c.covered[start:end]
                    kept = data[start:end][~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) and gone[0])
                    rows.append((doc, end - start, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                    start = end
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                cols = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
                names = [x.split()[0] for x in _RESULT.split(", ")]
                trim()
                yield pa.record_batch(cols if texts else cols[:5], names=[*names, "kept"] if texts else names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` the bytes kept.

    length: an even number of bytes.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("sum", F.md5("text"))
    equal = scratch.cut(docs.groupBy("sum").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sum", "first"))
    side = F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal
    marked = docs.join(side, "sum", "left")
    single = marked.where("first is null or first = id").select("id", "text")
    chunks = scratch.cut(single.mapInArrow(_chunked(CHUNK), "chunk long, bytes long, ids binary, ends binary, z binary"))
    ranges = max(32, -(-(chunks.agg(F.sum("bytes")).first()[0] or 0) // RANGE))
    known = chunks.select("chunk", "ids", "ends", "z")
    for step in (1, 2, 3, 4):
        asks = known.mapInArrow(_asks(ranges, length, step), "range int, chunk long, n long, names binary, more binary")
        answers = asks.groupBy("range").applyInArrow(_sorted_range(step), "chunk long, range int, bits binary")
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias(f"a{step}"))
        answers = scratch.cut(answers)
        size = answers.agg(F.sum(F.expr(f"aggregate(a{step}, 0L, (x, y) -> x + length(y.bits) + 16)"))).first()[0] or 0
        known = known.join(F.broadcast(answers) if size <= BROADCAST_BYTES else answers, "chunk", "left")
    kept = known.mapInArrow(_results(ranges, length, texts), _RESULT + (", kept binary" if texts else ""))
    whole = F.octet_length("text") >= length
    copies = marked.where("first < id").select(
        "id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(whole, F.octet_length("text")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(F.when(whole, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept")] if texts else []),
    )
    out = kept.union(copies)
    return out.select(F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), *out.columns[1:])


def _first_ranks(have: int):
    """(row, id, text) -> row, id, pos, rank of all positions: the first bytes as a number."""

    def run(batches):
        for batch in slices(batches, rows=64, bytes_=1 << 20):
            for row, i, t in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), as_binary(batch.column("text")), strict=True):
                n = len(t) - have + 1
                if n > 0:
                    rank = np.zeros(n, np.int64)
                    for k in range(have):
                        rank = (rank << 8) | np.frombuffer(t, np.uint8)[k : k + n]
                    yield pa.record_batch([pa.array(np.full(n, row)), pa.array(np.full(n, i)), pa.array(np.arange(n, dtype=np.int64)), pa.array(rank)], names=["row", "id", "pos", "rank"])

    return run


def doubled_positions(docs: DataFrame, length: int = LENGTH, first: int = 7) -> DataFrame:
    """docs(doc_id, text) -> id, row, pos: all starts of strings of ``length`` bytes that also start in a document with a smaller id.

    Plain prefix doubling over all positions: Spark sorts rank pairs at growing
    offsets, equal pairs get one rank (their least position), and a position
    whose rank only one document has is settled and leaves, with all that
    would pair with it.  It moves some hundred times the corpus, so the
    operator filters positions first; this is what it is measured against.
    """
    scratch = Scratch(docs.sparkSession, "doubling")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = scratch.cut(docs.withColumn("row", F.monotonically_increasing_id()))
    now, have = docs.mapInArrow(_first_ranks(first), "row long, id long, pos long, rank long").withColumn("other", F.lit(0)), first
    while True:
        same = Window.partitionBy("rank", "other")
        ranked = now.select("row", "id", "pos", F.min(F.struct("row", "pos")).over(same).alias("rank"), F.min("id").over(same).alias("lo"), F.max("id").over(same).alias("hi"))
        if have == length:
            return ranked.where("lo < id").select("id", "row", "pos")
        alive = scratch.cut(ranked.where("lo < hi").select("row", "id", "pos", "rank"))
        step = min(have, length - have)
        later = alive.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("other"))
        now, have = alive.join(later, ["row", "pos"]), have + step


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
