"""MinHash near-duplicate detection.

Many universal hash minima of each document's word shingles, banding, signature
verification, confirmation on full sets, and connected components by
alternating large-star and small-star.

How it stays whole and linear.  Documents with equal sets are one node.  A
bucket (a band value) links each member to its smallest member, so a bucket of
m members gives m - 1 pairs.  Nodes of one component need no more comparison.
Buckets tie nodes to clusters; a cluster that still holds several components is
dealt into blocks of about ``BLOCK`` shingles and ``NODES`` sets, whichever is
less, and each two blocks meet in one task that counts overlaps of full sets by matrix products and gives a spanning
forest of the links between components.  No bucket is capped, no pair that
banding proposes stays untested unless its two documents are already in one
component, and no list of all pairs of a group is ever made.

Chance of a miss: two sets at the threshold 0.8 share none of 36 bands of 5
with probability (1 - 0.8**5)**36 = 6e-7.

Cases: null or empty text has an empty set and no links.  Texts with fewer
words than a shingle have their whole word sequence as one shingle.  A null
doc_id never names a component: rows linked only with null ids get a null
component_id and are kept.  Repeated rows are each returned, and have the same
component.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, flat_words, mix, read, slices, word_hashes

BANDS, ROWS = 36, 5
#: Shingles of a block of a cluster; two blocks meet in one task.
BLOCK = 1 << 18
#: Sets of such a block: the task that compares two blocks has a square of twice as many.
NODES = 1500
#: Rows of (two longs) up to which a list of documents is broadcast; beyond, a shuffle join is used.
BROADCAST_ROWS = 1_000_000


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    offsets, idx, names = flat_words(column)
    flat = word_hashes(names)[idx] if len(names) else np.zeros(0, np.uint64)
    n = len(flat)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(words, max(n, 1))):
        rolled[: n - i] = mix(rolled[: n - i] * np.uint64(0x9E3779B97F4A7C15) + flat[i:])
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= words:
            out.append(np.unique(rolled[s : e - words + 1]))
        elif e > s:
            h = np.uint64(xxhash.xxh3_64_intdigest(flat[s:e].tobytes(), seed=e - s))
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Minima of the universal hashes x -> a * (x ^ b) mod 2**32, a odd."""
    a, b = _coefficients(hashes)
    full = [i for i, s in enumerate(sets) if len(s)]
    sig = np.zeros((len(sets), hashes), np.uint32)
    if full:
        flat = np.concatenate([sets[i] for i in full])
        flat = (flat >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        got = np.empty((hashes, len(full)), np.uint32)
        for j in range(hashes):
            got[j] = np.minimum.reduceat((flat ^ b[j]) * a[j], starts)
        sig[full] = got.T
    return sig


def _sign(words: int, bands: int, rows: int, least: int):
    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            sig = _signatures(sets, bands * rows)
            salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            keys = np.tile(salt, (len(sets), 1))
            for r in range(rows):
                keys = mix(keys * np.uint64(31) + sig[:, r::rows].astype(np.uint64))
            n = np.array([len(s) for s in sets], np.int64)
            node = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            lists = [k if c >= least else k[:0] for k, c in zip(keys.view(np.int64), n.tolist(), strict=True)]
            off = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(n),
                    pa.array(np.array(node, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))),
                ],
                names=["doc_id", "th", "n_shingles", "node", "bands"],
            )

    return run


def _sets(words: int, hashes: int):
    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            sig = (_signatures(sets, hashes) & np.uint32(255)).astype(np.uint8)
            yield pa.record_batch(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int32())] + [pa.array([s.tobytes() for s in x], pa.binary()) for x in (sets, sig)],
                names=["node", "n", "set", "sig"],
            )

    return run


def _alike(num: int, den: int, hashes: int):
    """Keep pairs whose sizes and signatures allow the threshold: five standard deviations of leeway."""
    t = num / den
    floor = (t - 5 * (max(t * (1 - t), 0.01) / hashes) ** 0.5) * hashes

    def run(batches):
        for batch in batches:
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            sa, sb = (np.array(batch.column(c).to_pylist(), dtype=f"V{hashes}").view(np.uint8).reshape(-1, hashes) for c in ("sig_a", "sig_b"))
            ok = (np.count_nonzero(sa == sb, axis=1) >= floor) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(num: int, den: int):
    """Keep pairs whose full sets have den * both >= num * either."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlaps(sets: list[np.ndarray], few: int = 16) -> np.ndarray:
    """How many elements each two sets share."""
    k = len(sets)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    out = np.zeros((k, k), np.float32)
    # Elements of few sets add to single pairs; those of many go through matrix products.
    order = np.argsort(code, kind="stable")
    row, code, count = row[order], code[order], count[code[order]]
    low = (count > 1) & (count <= few)
    r, c = row[low], code[low]
    for step in range(1, few):
        same = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        pairs = np.bincount(r[same] * k + r[same + step], minlength=k * k).reshape(k, k).astype(np.float32)
        out += pairs + pairs.T
    r, c = row[count > few], code[count > few]
    ids = np.unique(c, return_inverse=True)[1] if len(c) else c
    for start in range(0, int(ids.max()) + 1 if len(ids) else 0, 2048):
        part = (ids >= start) & (ids < start + 2048)
        m = np.zeros((k, 2048), np.float32)
        m[r[part], ids[part] - start] = 1
        out += m @ m.T
    return out


def _between_blocks(num: int, den: int):
    """Links between nodes of different labels of two blocks of a cluster: a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        node, label = table.column("node").to_pylist(), table.column("label").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        block = table.column("block").to_numpy()
        u, v = [], []
        if len(np.unique(label)) > 1:
            n = np.array([len(s) for s in sets], np.float32)
            # Whole numbers below 2**24 are exact; longer sets need more.
            shared = _overlaps(sets).astype(np.float64 if den * n.max() * 2 >= 2**24 else np.float32, copy=False)
            ok = den * shared >= num * (n[:, None] + n[None, :] - shared)
            ok &= label[:, None] != label[None, :]
            if len(np.unique(block)) > 1:
                ok &= block[:, None] != block[None, :]
            root = {x: x for x in label.tolist()}

            def find(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b in zip(*np.nonzero(np.triu(ok)), strict=True):
                x, y = find(int(label[a])), find(int(label[b]))
                if x != y:
                    root[x] = y
                    u.append(node[a])
                    v.append(node[b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def connected_components(edges: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """(u, v) links, ``rows`` at most -> (u, label), label the smallest node of the component; by alternating large-star and small-star.

    Every node that occurs in a link gets a row.  Each step is a grouped
    minimum and an equi-join, so a node with very many neighbours is
    pre-aggregated and its join partition can be split.
    """

    def checksum(e):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = scratch.cut(few(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), rows))
    seen = checksum(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.cut(few(large, seen[0]))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        new = scratch.cut(few(small, 2 * seen[0]))
        now = checksum(new)
        scratch.drop(e, large)
        e = new
        if now == seen:
            break
        seen = now
    labels = e.select("u", F.col("v").alias("label"))
    return scratch.cut(few(labels.union(e.select(F.col("v").alias("u"), F.col("v").alias("label"))).distinct(), 2 * seen[0]))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, by_row: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per row of docs.

    ``by_row`` adds th, the text's hash, and kept is then true for one (doc_id, th) of each component: the smallest id (null is
    last) and of its texts the smallest hash.  So null and reused ids are judged by their own text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    # Different sets of fewer than this many shingles can't be this alike: (x - 1) / x < num / den for x up to it.
    least = next(x for x in range(1, 10**6) if den * x >= num * (x + 1)) if num < den else 1 << 62
    signed = scratch.cut(docs.mapInArrow(_sign(words, bands, rows, least), "doc_id long, th long, n_shingles long, node long, bands array<long>"))
    n_docs = signed.count()
    banded = signed.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = scratch.cut(few(banded.join(buckets, "band").select("band", "low", "node").distinct(), bands * n_docs))
    tested = scratch.cut(few(members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), members.count()))
    n_tested = tested.count()

    # One row of each set: the document with the smallest id.
    first = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("x"))
    first = first.select("node", F.col("x.doc_id").alias("rep_id"), F.col("x.th").alias("rep_th"))

    # Full sets of the nodes that share a bucket with another.
    nodes = members.select("node").distinct()
    wanted = scratch.cut(few(first.join(nodes, "node"), n_docs))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(side, (docs.th == side.rep_th) & docs.doc_id.eqNullSafe(side.rep_id)).select("node", "text")
    full = scratch.cut(texts.mapInArrow(_sets(words, bands * rows), "node long, n int, set binary, sig binary"))

    def both(x: DataFrame, *names: str) -> DataFrame:
        for end in ("a", "b"):
            x = x.join(full.select(F.col("node").alias(end), *[F.col(n).alias(f"{n}_{end}") for n in names]), end)
        return x

    like = scratch.cut(few(both(tested, "n", "sig"), n_tested).mapInArrow(_alike(num, den, bands * rows), "a long, b long"))
    linked = scratch.cut(few(both(like, "set"), like.count()).mapInArrow(_confirm(num, den), "a long, b long"))
    n_linked = linked.count()
    edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(edges, scratch, n_linked)

    # Clusters of nodes that buckets tie together; those of three or more nodes that still hold several components are open.
    clusters = connected_components(tested.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, n_tested)
    named = clusters.select(F.col("u").alias("node"), F.col("label").alias("cluster")).join(labels, F.col("node") == F.col("u"), "left")
    named = named.select("node", "cluster", F.coalesce("label", "node").alias("label")).join(full.select("node", "n"), "node")
    named = scratch.cut(few(named, n_docs))
    open_ = named.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("size")).where("lo <> hi and k > 2")
    open_ = open_.select("cluster", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("k") / NODES)).cast("int").alias("blocks"))
    open_ = scratch.cut(few(named.join(open_, "cluster").select("node", "cluster", "label", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"), "blocks"), n_docs))
    dealt = open_.join(full.select("node", "set"), "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "set")
    more = dealt.groupBy("cluster", "i", "j").applyInArrow(_between_blocks(num, den), "u long, v long")
    more = scratch.cut(more)
    n_more = more.count()
    if n_more:
        labels = connected_components(edges.union(more), scratch, n_linked + n_more)

    scratch.drop(members, wanted, full, like, named, open_)
    nodes = first.join(labels, F.col("node") == F.col("u")).select("node", "label", "rep_id", "rep_th")
    smallest = nodes.groupBy("label").agg(F.min("rep_id").alias("c"), F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "rep_th"))["rep_th"].alias("c_th"))
    linked = nodes.join(smallest, "label").select(F.col("node").alias("l_node"), "c", "c_th")
    smallest_of_set = first.select(F.col("node").alias("s_node"), "rep_id", "rep_th").join(linked, F.col("s_node") == F.col("l_node"), "left")
    # Equal sets are one component, but empty ones aren't linked.
    of = [F.when(F.col("l_node").isNull(), F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("rep_id", "c"), ("rep_th", "c_th"))]
    named = scratch.cut(few(smallest_of_set.select("s_node", *of[: 2 if by_row else 1]), n_docs))
    if by_row:
        out = signed.join(named, F.col("node") == F.col("s_node"))
        empty = F.col("n_shingles") == 0
        kept = empty | (F.col("doc_id").eqNullSafe(F.col("c")) & (F.col("th") == F.col("c_th")))
        return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"), kept.alias("kept"), "th")
    out = signed.select("doc_id", "n_shingles", "node").join(named, F.col("node") == F.col("s_node"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2)
