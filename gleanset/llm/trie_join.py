"""Similarity join of n-gram sets by prefix trees.

All shingles have one global order, rarest first. It comes from counts over all
documents in hashed buckets, a table of fixed size; within a bucket the hash
decides. Two sets that are similar enough share a shingle among their first
ones (the prefix filter), so documents that share none never meet. Of those that
do, pairs that cannot be similar by their sizes and by the parities of their
shingles in buckets part again: every difference of the sets flips one bit at
most, so as many bits differ as shingles do, or fewer.

Documents that meet, directly or through others, are a class. A class of bounded
weight is compared in one task. A larger one is first drawn together: every
document is compared with the one it shares most prefix shingles with, in chunks
of bounded weight. What then still shares a prefix shingle across components is
dealt to tiles, and every two tiles with such a shingle are compared.

In a task the sets are stored in a trie, most frequent shingles first, so that
paths run together. It is traversed once: the overlaps with all other sets are
counted along a path and shared by the whole subtree, and a set leaves a subtree
as soon as the overlap so far and what is left of both cannot reach the bound,
or when links already connect it to the subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import mix64, per_batch, possible, settled, slices
from gleanset.llm.minhash import components, shingle_sets

WORDS = 4
PERCENT = 85
# Buckets of the global order: 2^18 counts, a megabyte in each worker.
ORDER_BITS = 18
TILE = 1 << 20
# What a set counts besides its shingles, so that a task compares some 2048 sets at most.
ENTRY = TILE // 2048
# Sets of more shingles than this give keys at a rate that falls with their size, some 200 in all.
SAMPLED = 1200
# From this size on (sets similar to sampled ones are larger) prefixes are longer by a share of the set, so that many of their shingles agree.
LONGER = 1000
SHARE = 3
# Words of 64 bits in the parities of a set: one bit for two shingles, between these bounds.
LEAST_PARITY, MOST_PARITY = 8, 512
# Keys with more nodes than this keep them all together.
MEMBERS = 4096
# Keys of up to this many nodes are worked through side by side.
SIDE = 12
# With no more sets than this left, overlaps are taken set by set.
FEW = 4


def ranks(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The place of each bucket of shingles when buckets are ordered by the documents' shingles in them, over all documents."""
    buckets = 1 << ORDER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                found = list(shingle_sets(part.column("text"), words))
                counts += np.bincount((np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    place = np.empty(buckets, np.uint64)
    place[np.argsort(counts, kind="stable")] = np.arange(buckets, dtype=np.uint64)
    return place


def ordered(shingles: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The set in numbers that follow the global order: the bucket's place, then the rest of the hash. No two hashes become one."""
    bucket = (shingles & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)
    return np.sort((place[bucket] << np.uint64(64 - ORDER_BITS)) | (shingles >> np.uint64(ORDER_BITS)))


def prefix_length(size: int, percent: int) -> int:
    """A similar set shares at least ``percent`` of the set, so one of this many first shingles."""
    return size - -(-percent * size // 100) + 1 if size else 0


def prefix(values: np.ndarray, percent: int) -> np.ndarray:
    """The keys of an ordered set: its first shingles, of large sets a part of them.

    With a prefix longer by l, similar sets have l shingles of it in common. A
    large set keeps those whose hash is below a bound that falls with its size;
    of 30 and more in common at that rate, none is below the bound of both with
    a probability of e^-30, which is that of equal hashes.
    """
    n = len(values)
    if n < LONGER:
        return values[:prefix_length(n, percent)]
    first = values[:prefix_length(n, percent) + -(-SHARE * n // 100)]
    return first if n <= SAMPLED else first[mix64(first) < np.uint64((SAMPLED << 64) // n)]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles is in each bucket, as words of 64 bits; a power of two of them, by the size of the set.

    Halves of the words xor-ed are the parities in half as many buckets.
    """
    words = LEAST_PARITY
    while words < MOST_PARITY and 128 * words < len(shingles):
        words *= 2
    bucket = (shingles >> np.uint64(ORDER_BITS) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=64 * words) & 1).astype(np.uint8)).view(np.uint64)


def sketches(docs: DataFrame, place: Broadcast, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, digest, parity, keys): the set size, a 128-bit digest of the set, its parities and its prefix."""

    def work(batch: pa.RecordBatch) -> dict:
        counts, digests, odd, keys = [], [], [], []
        for part in slices(batch):
            for shingles in shingle_sets(part.column("text"), words):
                counts.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                odd.append(parities(shingles).tobytes())
                keys.append(prefix(ordered(shingles, place.value), percent).view(np.int64))
        ends = np.cumsum([0] + [len(k) for k in keys])
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array(counts, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "parity": pa.array(odd, pa.binary()), "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys))),
        }

    return per_batch(_read(docs), "doc_id long, n_shingles long, digest binary, parity binary, keys array<long>", work)


def able(sizes: tuple, bits: tuple, percent: int) -> np.ndarray:
    """Whether pairs may be similar: linked sets differ in (100 - percent) of 100 + percent parts of their sizes at most."""
    (m, n), (x, y) = sizes, bits
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return ((100 + percent) * np.maximum(differ, np.abs(m - n)) <= (100 - percent) * (m + n)) & (m > 0) & (n > 0)


def together(sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """For one key the first node of everyone's group: those that pairs of able nodes connect."""
    first = np.arange(len(sizes))
    left = np.arange(len(sizes))
    while len(left):
        root, reach, left = left[0], [left[0]], left[1:]
        while reach and len(left):
            at = reach.pop()
            near = able((sizes[at], sizes[left]), (bits[at], bits[left]), percent)
            first[left[near]] = root
            reach += left[near].tolist()
            left = left[~near]
    return first


def side_by_side(sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """As :func:`together` for many keys with equally many nodes each: arrays of keys by nodes."""
    keys, d = sizes.shape
    near = np.zeros((keys, d, d), bool)
    for i in range(d):
        near[:, i, i] = True
        for j in range(i + 1, d):
            near[:, i, j] = near[:, j, i] = able((sizes[:, i], sizes[:, j]), (bits[:, i], bits[:, j]), percent)
    first = np.broadcast_to(np.arange(d), (keys, d))
    while True:
        least = np.where(near, first[:, None, :], d).min(axis=2)
        if (least == first).all():
            return first
        first = least


def folded(bits: list[bytes], words: int) -> np.ndarray:
    """Parities in ``words`` words each, of such with as many or more."""
    out = np.empty((len(bits), words), np.uint64)
    sizes = np.array([len(b) for b in bits])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        own = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1, words)
        out[at] = np.bitwise_xor.reduce(own, axis=1)
    return out


def parted(shared: DataFrame, sets: DataFrame, percent: int, most: int = MEMBERS) -> DataFrame:
    """(node, key, hub): the nodes of each key in groups that able pairs connect, each a key of its own.

    ``shared`` is (node, key, hub, members), ``sets`` (node, n_shingles, parity).
    Nodes of a key stand by size; a gap that no pair can bridge cuts them, and a
    run is compared in the parities of its smallest set. A key of more than
    ``most`` nodes stays one group, so no task holds more of them at once. A
    node with several sets is compared by all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(key: np.ndarray, node: np.ndarray, size: np.ndarray, bits: list[bytes]) -> pa.RecordBatch:
            apart = (key[1:] != key[:-1]) | (100 * size[:-1] < percent * size[1:])
            begin = np.flatnonzero(np.concatenate(([True], apart)))
            often = np.diff(np.concatenate((begin, [len(key)])))
            words = np.array([len(bits[i]) // 8 for i in begin])
            hub = node.copy()
            for d, width in {(d, w) for d, w in zip(often.tolist(), words.tolist(), strict=True) if d > 1}:
                at = begin[(often == d) & (words == width)]
                if d <= SIDE:
                    for low in range(0, len(at), (1 << 17) // width):
                        rows = at[low:low + (1 << 17) // width, None] + np.arange(d)
                        own = folded([bits[i] for i in rows.ravel()], width).reshape(*rows.shape, width)
                        hub[rows] = np.take_along_axis(node[rows], side_by_side(size[rows], own, percent), axis=1)
                else:
                    for low in at:
                        part = slice(low, low + d)
                        hub[part] = node[part][together(size[part], folded(bits[part], width), percent)]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(key), pa.array(hub)], names=["node", "key", "hub"])

        held = None
        for batch in batches:
            key, node, size = (batch.column(n).to_numpy() for n in ("key", "node", "n_shingles"))
            bits = batch.column("parity").to_pylist()
            if held is not None:
                key, node, size = (np.concatenate(pair) for pair in zip(held[:3], (key, node, size), strict=True))
                bits = held[3] + bits
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield groups(key[:cut], node[:cut], size[:cut], bits[:cut])
            held = (key[cut:], node[cut:], size[cut:], bits[cut:])
        if held is not None and len(held[0]):
            yield groups(*held)

    some = shared.filter(F.col("members") <= most).join(sets, "node").select("key", "node", "n_shingles", "parity")
    found = some.repartition("key").sortWithinPartitions("key", "n_shingles", "node").mapInArrow(run, "node long, key long, hub long")
    whole = shared.filter(F.col("members") > most).select("node", "key", "hub")
    return found.withColumn("key", F.xxhash64("key", "hub")).union(whole)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


class Trie:
    """Sets of ordered numbers as paths of a prefix tree, for one traversal.

    A path holds the numbers that two sets or more have, the largest first; the
    others count in sizes only. Sets stand in the order of their paths, so a
    subtree is a run of sets.
    """

    def __init__(self, sets: list[np.ndarray]):
        lengths = np.array([len(s) for s in sets], np.int64)
        values, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = often > 1
        # Numbers from 0 on for common values, downwards in the global order.
        dense = (np.cumsum(common[::-1])[::-1] - 1)[number]
        kept, owner = common[number], np.repeat(np.arange(len(sets)), lengths)
        ends = np.cumsum(np.bincount(owner[kept], minlength=len(sets)))
        steps = np.split(dense[kept], ends[:-1])
        paths = [s[::-1] for s in steps]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = lengths[self.order]
        self.depths = np.array([len(p) for p in self.paths], np.int64)
        where = np.empty(len(sets), np.int64)
        where[self.order] = np.arange(len(sets))
        by_step = np.argsort(dense[kept], kind="stable")
        self.holders = where[owner[kept][by_step]]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(dense[kept], minlength=int(common.sum())))))
        self.shared = np.array([0] + [self._together(a, b) for a, b in zip(self.paths[:-1], self.paths[1:], strict=True)], np.int64)

    @staticmethod
    def _together(a: np.ndarray, b: np.ndarray) -> int:
        """How many steps two paths have in common."""
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        return int(np.argmax(differ)) if differ.any() else n

    def _holding(self, steps: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many of the steps each of the other sets holds."""
        if len(others) <= FEW:
            return np.array([len(np.intersect1d(steps, self.paths[y], assume_unique=True)) for y in others], np.int64)
        first, last = self.begin[steps], self.begin[steps + 1]
        counts = last - first
        at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        return np.bincount(self.holders[at], minlength=len(self.paths))[others]

    def links(self, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Pairs of sets that connect all labels which linked pairs connect, directly or through others."""
        label = np.asarray(labels)[self.order].copy()
        found: list[tuple[int, int]] = []
        self.visited = 0
        everyone = np.arange(len(self.paths))
        open_ = [(0, len(self.paths), 0, everyone, np.zeros(len(self.paths), np.int64))]
        while open_:
            low, high, depth, others, overlap = open_.pop()
            behind = others >= low
            if (label[low:high] == label[low]).all():
                behind &= label[others] != label[low]
            others, overlap = others[behind], overlap[behind]
            if not len(others):
                continue
            end = int(self.depths[low]) if high - low == 1 else int(self.shared[low + 1:high].min())
            if end > depth:
                overlap = overlap + self._holding(self.paths[low][depth:end], others)
            self.visited += 1
            left = int(self.depths[low:high].max()) - end
            most = overlap + np.minimum(left, self.depths[others] - overlap)
            able = (100 + percent) * most >= percent * (int(self.sizes[low:high].min()) + self.sizes[others])
            others, overlap = others[able], overlap[able]
            inner = low
            while inner < high and self.depths[inner] == end:
                near = (others > inner) & ((100 + percent) * overlap >= percent * (self.sizes[inner] + self.sizes[others]))
                for y in others[near]:
                    if label[y] != label[inner]:
                        found.append((self.order[inner], self.order[y]))
                        label[label == label[y]] = label[inner]
                inner += 1
            if len(others) and inner < high:
                cuts = [inner, *(inner + 1 + np.flatnonzero(self.shared[inner + 1:high] == end)).tolist(), high]
                open_ += [(a, b, end, others, overlap) for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]
        return found


def compared(docs: DataFrame, dealt: DataFrame, place: Broadcast, words: int, percent: int) -> DataFrame:
    """(a, b): links between nodes of different components, for the groups (i, j) of ``dealt`` (node, component, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
            rows = list(dict.fromkeys(rows))
            if len({r[1] for r in rows}) < 2:
                return None
            _, labels = np.unique([r[1] for r in rows], return_inverse=True)
            found = Trie([np.frombuffer(r[2], np.uint64) for r in rows]).links(labels, percent)
            ends = [pa.array([rows[pair[k]][0] for pair in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        current, held = None, []
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(n).to_pylist() for n in ("i", "j", "node", "component")]
                for i, j, node, component, shingles in zip(*columns, shingle_sets(part.column("text"), words), strict=True):
                    if (i, j) != current:
                        if (out := links(held)) is not None:
                            yield out
                        current, held = (i, j), []
                    if len(shingles):
                        held.append((node, component, ordered(shingles, place.value).tobytes()))
        if (out := links(held)) is not None:
            yield out

    # Texts of documents in no group are not shuffled; texts are smaller than sets.
    asked = possible(_read(docs), dealt.select(F.col("node").alias("doc_id")), "doc_id", "asked").filter("asked")
    ready = asked.join(dealt, F.col("doc_id") == F.col("node")).select("i", "j", "node", "component", "text")
    return ready.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "a long, b long").filter("a != b")


def stars(members: DataFrame, tile: int) -> DataFrame:
    """(node, component, i, j): each node with the hub that most of its keys have, in chunks of bounded weight; the hub is in all of them.

    ``members`` is (node, key, hub, weight).
    """
    votes = members.filter("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    best = settled(votes.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"), F.max("weight").alias("weight")), "stars")
    chunks = best.groupBy("hub").agg(F.ceil(F.sum("weight") / tile).alias("chunks"))
    rays = best.join(chunks, "hub").select("node", F.col("hub").alias("i"), F.expr("pmod(xxhash64(node), chunks)").alias("j"))
    centres = chunks.select(F.col("hub").alias("node"), F.col("hub").alias("i"), F.explode(F.expr("sequence(0L, chunks - 1)")).alias("j"))
    return rays.union(centres).select("node", F.col("node").alias("component"), "i", "j")


def tile_pairs(members: DataFrame, tile: int) -> DataFrame:
    """(node, component, i, j): nodes that share a key with another component, in every two tiles where that is so.

    ``members`` is (node, key, root, component, weight) of keys that several
    components have. A component of more than a tile's weight has tiles of its
    own, which are not compared with each other; the others of a class share
    tiles, each component in one.
    """
    nodes = members.groupBy("root", "component", "node").agg(F.max("weight").alias("weight"))
    sums = nodes.groupBy("root", "component").agg(F.sum("weight").alias("own"))
    light = sums.filter(F.col("own") <= tile).groupBy("root").agg(F.ceil(F.sum("own") / tile).alias("tiles"))
    of = sums.join(light, "root", "left").select(
        "root", "component", (F.col("own") > tile).alias("heavy"),
        F.when(F.col("own") > tile, F.ceil(F.col("own") / tile)).otherwise(F.col("tiles")).alias("tiles"),
    )
    number = F.when(F.col("heavy"), F.expr("pmod(xxhash64(node), tiles)")).otherwise(F.expr("pmod(xxhash64(component), tiles)"))
    owner = F.when(F.col("heavy"), F.col("component"))
    dealt = settled(
        members.join(of, ["root", "component"]).select(
            "node", "key", "component", owner.alias("owner"), F.xxhash64("root", F.coalesce(owner, F.lit(-1)), "heavy", number).alias("tile")
        ),
        "tiles",
    )
    seen = dealt.groupBy("key", "tile", "owner").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    pairs = seen.alias("p").join(seen.alias("q"), "key").filter(
        "p.tile < q.tile AND (p.owner IS NULL OR q.owner IS NULL OR p.owner != q.owner)"
    ).select("key", F.col("p.tile").alias("i"), F.col("q.tile").alias("j"))
    inner = seen.filter("low != high").select("key", F.col("tile").alias("i"), F.col("tile").alias("j"))
    every = pairs.union(inner)
    ends = every.select("key", F.col("i").alias("tile"), "i", "j").union(every.filter("i != j").select("key", F.col("j").alias("tile"), "i", "j"))
    return dealt.join(ends, ["key", "tile"]).select("node", "component", "i", "j").distinct()


def similar_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all
    shingles of both; ``component_id`` is the least ``doc_id`` that links lead
    to. Every linked pair shares a key, sets of more than SAMPLED shingles but for
    a chance of e^-30, so no link is lost. A null or
    wordless text has no shingles and no links; one with fewer words than a
    shingle has its whole sequence as the only one. Rows with one ``doc_id`` are
    one document: all their texts' links are its own. A row without ``doc_id``
    cannot name a component and has none. Equal sets are one node from the
    start. Empty tables give empty tables; other columns are not read.
    """
    entry = max(1, tile // 2048)
    place = docs.sparkSession.sparkContext.broadcast(ranks(docs, words))
    sketched = settled(sketches(docs, place, words, percent), "sketches")
    known = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = settled(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("keys", "parity", "n_shingles")]
        ),
        "sets",
    )
    keyed = reps.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("members"))
    meeting = settled(keyed.join(hubs.filter("hub != last").drop("last"), "key").distinct(), "meeting")
    groups = settled(parted(meeting, reps.select("node", "n_shingles", "parity"), percent), "groups")
    pairs = groups.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    classes = settled(components(pairs), "classes")
    weights = reps.groupBy("node").agg(F.sum(F.col("n_shingles") + entry).alias("weight"))
    weighed = classes.join(weights, "node")
    sums = settled(weighed.groupBy("root").agg(F.sum("weight").alias("total")), "weights")
    large = sums.filter(F.col("total") > tile).select("root")
    whole = classes.join(sums.filter(F.col("total") <= tile).select("root"), "root").select(
        "node", F.col("node").alias("component"), F.col("root").alias("i"), F.lit(-1).cast("long").alias("j")
    )
    if large.isEmpty():
        edges = settled(compared(docs, settled(whole, "dealt"), place, words, percent), "links")
    else:
        inside = settled(groups.join(weighed.join(large, "root"), "node").distinct(), "inside")
        first = settled(compared(docs, settled(whole.union(stars(inside, tile)), "dealt"), place, words, percent), "links")
        drawn = settled(components(first.join(inside.select(F.col("node").alias("a")).distinct(), "a", "left_semi")), "drawn")
        named = inside.join(drawn.select("node", F.col("root").alias("c")), "node", "left").withColumn("component", F.coalesce("c", "node"))
        apart = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
        rest = settled(named.join(apart, "key").select("node", "key", "root", "component", "weight"), "rest")
        edges = first.union(settled(compared(docs, settled(tile_pairs(rest, tile), "dealt"), place, words, percent), "links"))
    members = settled(
        sketched.join(reps.select("digest", "node"), "digest", "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
        ),
        "members",
    )
    several = members.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b")
    same = members.join(several.select("doc_id", "a"), "doc_id").filter("node != a").select("a", F.col("node").alias("b"))
    roots = settled(components(edges.union(same)), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    found = roots.join(least, "root").select("node", "component_id")
    return members.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "node", "doc_id").alias("component_id"))
