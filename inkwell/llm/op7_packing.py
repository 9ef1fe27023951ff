"""Packing token sequences by shortest-pack-first over the length histogram.

A document's ids end with an end id.  Ids are cut into pieces of at most
``piece`` ids.  The histogram of piece lengths (at most ``piece`` entries,
whatever the corpus) goes to the driver, where lengths are placed longest
first, each into the emptiest pack pattern that has room; patterns carry
counts, so the work does not grow with the corpus.  Pieces find their place by
rank: the r-th piece of a length goes where the patterns put the r-th.

Ranks need no single task and no sort of a frequent length: each input
partition numbers its own pieces of each length as it writes them, and
per-partition counts are summed up to offsets.

Distinct white-space-free chunks, parted from trailing marks, are tokenised
once and remembered.  Borders are only drawn where the tokenizer's normal form
of both sides and its patterns cannot reach across.

Cases: null text is empty and has the end id alone.  Repeated rows are each
packed.  Empty tables give empty results.  Very long texts give many pieces.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, flat_words, read, slices

#: Ids of a sequence, and longest piece.
SEQUENCE, PIECE = 2048, 512
#: Distinct chunks whose ids a worker remembers at most, and bytes of them and of their ids (beyond one slice's).
REMEMBER, REMEMBER_BYTES = 300_000, 16 << 20
#: Bytes of text that are tokenised at once: indexes of their ids take some twenty times as much.
SLICE_BYTES = 1 << 20
END_ID = 1
#: A letter or digit and the marks after it, which the tokenizer takes apart.  Only letters that are one letter in lower case
#: too, by any Unicode table: the lower case of U+0130 ends in a combining mark, which goes with the marks after it.
_MARKS = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,!?*#&$%;:]+)"
#: Capitals whose lower case, but not themselves, may join with a combining mark to one character.
_JOINED = r"[A-Z]\pM"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks:
    """Ids of white-space-free chunks, remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A special token between chunks keeps them apart, so many take one call.
        self.folds = self._same("The Quick BROWN Fox's", "the quick brown fox's")
        self.splits = self._same("one, two... three!! é% 4# a;b", "one , two ... three !! é % 4 # a ;b")
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self._word_path()
        self.clear()

    def _word_path(self):
        """A cheaper way for words of a-z, where it is the same: such a word needs no normalising, and its last id is known by its word-end mark."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.plain = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or not self.folds:
            return
        plain = Tokenizer.from_str(self.tokenizer.to_str())
        plain.normalizer, plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        rng = np.random.default_rng(1)
        probes = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 24, 300)] + ["the", "nation", "s", "t", "ll"]
        want = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probes]
        if all(plain.encode(x, add_special_tokens=False).ids == w and self.ends_word[w].tolist() == [False] * (len(w) - 1) + [True] for x, w in zip(probes, want, strict=True)):
            self.plain = plain

    def _same(self, a: str, b: str) -> bool:
        return self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids

    def clear(self):
        # An Arrow column, looked up by a hash table for each slice: a dict of strings takes several times the memory.
        self.chunks = pa.array([], pa.large_string())
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.known = np.zeros(1 << 16, np.int64), 0

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray):
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(need, np.uint32)])
        self.ids[self.used : need] = ids
        if self.known + len(chunks) + 1 > len(self.start):
            self.start = np.concatenate([self.start[: self.known + 1], np.zeros(self.known + len(chunks), np.int64)])
        self.start[self.known + 1 : self.known + 1 + len(chunks)] = self.used + np.cumsum(lengths)
        self.learned += chunks
        self.used, self.known = need, self.known + len(chunks)

    def _learn(self, chunks: list[str]):
        encode = self.tokenizer.encode_batch_fast
        if self.plain:
            words = [c for c in chunks if c.isascii() and c.isalpha() and c.islower()]
            if words:
                for s in range(0, len(words), 4096):
                    part = words[s : s + 4096]
                    ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                    self._add(part, ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1))
                chunks = [c for c in chunks if not (c.isascii() and c.isalpha() and c.islower())]
        odd = [c for c in chunks if not self.special or any(x in c for x in self.special)]
        if odd:
            for c, e in zip(odd, encode(odd, add_special_tokens=False), strict=True):
                self._add([c], np.array(e.ids, np.uint32), np.array([len(e.ids)]))
            odd_set = set(odd)
            chunks = [c for c in chunks if c not in odd_set]
        mark, number = next(iter(self.special.items()), ("", -1))
        for s in range(0, len(chunks), 2048):
            part = chunks[s : s + 2048]
            ids = np.array(encode([mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = ids == number
            ends = np.append(np.flatnonzero(cut), len(ids))
            self._add(part, ids[~cut], np.diff(ends, prepend=-1) - 1)

    def _forget(self, known: int):
        """All but the first chunks, which are mostly the frequent ones."""
        self.known, self.used = known, int(self.start[known])
        self.chunks = pa.concat_arrays([self.chunks.slice(0, known)])
        self.ids, self.start = self.ids[: self.used].copy(), self.start[: known + 1].copy()

    def __call__(self, chunks: pa.Array) -> np.ndarray:
        """Where ``start`` has each of these distinct chunks."""
        chunks = chunks.cast(pa.large_string())
        if self.known + len(chunks) > REMEMBER:
            self._forget(min(self.known, REMEMBER // 3))
        if self.chunks.nbytes + 4 * self.used > REMEMBER_BYTES:
            size = pc.binary_length(self.chunks).to_numpy().cumsum() + 4 * self.start[1 : self.known + 1]
            self._forget(int(np.searchsorted(size, REMEMBER_BYTES // 3, side="right")))
        found = pc.index_in(chunks, value_set=self.chunks)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        found = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            at, self.learned = self.known, []
            strings = chunks.take(pa.array(new)).to_pylist()
            self._learn(strings)
            place = {c: at + i for i, c in enumerate(self.learned)}
            found[new] = [place[c] for c in strings]
            self.chunks = pa.concat_arrays([self.chunks, pa.array(self.learned, pa.large_string())])
            self.learned = []
        return found

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts one after another, and each text's first."""
        # Capitals are folded by the tokenizer anyhow, but only after it has joined combining marks; and folding would make a special token of "<|X|>".
        lower = self.folds and not any(pc.any(x, min_count=0).as_py() for x in (pc.match_substring(column, "<|"), pc.match_substring_regex(column, _JOINED)))
        offsets, idx, names = flat_words(column, lower=lower)
        if not len(idx):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.splits:
            names = pc.replace_substring_regex(names, _MARKS, r"\1 \2")
        cuts, piece, names = flat_words(names, lower=False)
        piece = self(names)[piece]
        take, ends = _runs(cuts[:-1][idx], np.diff(cuts)[idx])
        offsets = ends[offsets]
        piece = piece[take]
        take, ends = _runs(self.start[piece], self.start[piece + 1] - self.start[piece])
        return self.ids[take], ends[offsets]


def chunks_of(path: str) -> Chunks:
    """A worker that lives on keeps the loaded tokenizer and the frequent chunks for its next task."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_inkwell_kept", {})
    if path not in kept:
        kept[path] = Chunks(path)
    return kept[path]


def _runs(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes start .. start + length of each run, one after another, and where each run begins, with the end."""
    ends = np.concatenate(([0], np.cumsum(length)))
    return np.repeat(start - ends[:-1], length) + np.arange(ends[-1]), ends


def _pieces(path: str, piece: int):
    def run(batches):
        chunks = chunks_of(path)
        pid = TaskContext.get().partitionId()
        seen = np.zeros(piece + 1, np.int64)
        for batch in slices(batches, rows=1024, bytes_=SLICE_BYTES):
            ids, first = chunks.flat(batch.column("text"))
            row, start, length, crc, rank, total = [], [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(END_ID)).astype("<u4")
                for s in range(0, len(own), piece):
                    part = own[s : s + piece]
                    row.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    rank.append(seen[len(part)])
                    total.append(len(own))
                    seen[len(part)] += 1
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, rank)]
            yield pa.record_batch([*cols, pa.array([pid] * len(row), pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part"])

    return run


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(packs, slots) of each pattern; slots are (length, rank of the piece that the pattern's first pack has there).

    Later packs of a pattern have the next ranks.
    """
    open_: list[tuple[int, int]] = []  # (room, key) of patterns with room, by room
    patterns: dict[int, tuple[int, int, list[tuple[int, int]]]] = {}
    key = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room, k = open_[-1] if open_ else (0, -1)
            if room >= length:
                open_.pop()
                count, _, slots = patterns.pop(k)
                used = min(count, left)
                if used < count:
                    patterns[k] = (count - used, room, [(n, r + used) for n, r in slots])
                    insort(open_, (room, k))
                slots, room = [*slots, (length, rank)], room - length
                placed = used
            else:
                # A new pack stays the only one with room until it is full.
                each = min(capacity // length, left)
                used = left // each
                slots, room = [(length, rank + i * used) for i in range(each)], capacity - each * length
                placed = used * each
            key += 1
            patterns[key] = (used, room, slots)
            if room:
                insort(open_, (room, key))
            rank, left = rank + placed, left - placed
    return [(count, slots) for count, _, slots in patterns.values()]


def _places(patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length: first ranks in order, and from each the first sequence and the offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for count, slots in patterns:
        offset = 0
        for length, rank in slots:
            out.setdefault(length, []).append((rank, sequence, offset))
            offset += length
        sequence += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for n, v in out.items()}


def _placed(places):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, seq, off = places[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.record_batch([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, piece: int = PIECE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; a row for each piece."""
    scratch = Scratch(docs.sparkSession, "pack")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, part long"
    pieces = scratch.cut(docs.mapInArrow(_pieces(tokenizer or default_tokenizer(), piece), schema))
    counts = scratch.cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(shortest_pack_first(histogram, sequence))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.mapInArrow(_placed(places), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
