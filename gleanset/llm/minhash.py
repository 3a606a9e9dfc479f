"""Near-duplicate documents by circulant MinHash.

Signatures take two permutations of a universe of places. The first scatters the
hashed shingles; coordinate k of the signature is the least value of the second,
shifted k places round, over the document's places. So one table lookup per
shingle yields a run of neighbouring entries, one for each coordinate.

Bands of coordinates make candidates. Those only say which documents may belong
together: candidate classes are cut into tiles of bounded size, every document's
full shingle set goes once to each tile pair that shares a band, and there all
pairs are counted exactly by matrix products. Only links that hold on full sets
count, and a tile reports a forest of them rather than the links themselves.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset.llm.common import mix64, per_batch, possible, settled, slices, utf8, word_hashes, word_spans

WORDS = 5
PERCENT = 85
UNIVERSE = 1 << 20
BANDS = 36
ROWS = 7
SEED = 20
TILE = 1 << 20
# What a document counts besides its shingles, so that a tile holds 2048 documents at most.
ENTRY = TILE // 2048
LIGHT = 16


@functools.lru_cache(maxsize=2)
def permutations(universe: int, coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the windows of the circulant one."""
    random = np.random.default_rng(seed)
    scatter = random.permutation(universe).astype(np.int32)
    circle = random.permutation(universe).astype(np.int32)
    return scatter, sliding_window_view(np.concatenate((circle, circle[:coordinates - 1])), coordinates)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A to Z are lower-cased. A text with fewer words than a shingle has its whole
    word sequence as the only one; a null or wordless text has none.
    """
    body, offsets = utf8(column)
    capital = (body >= 65) & (body <= 90)
    body = body + (capital * np.uint8(32))
    starts, ends, rows = word_spans(body, offsets)
    hashes = word_hashes(body, starts, ends)
    factor = np.uint64(0xA0761D6478BD642F)
    full = max(0, len(hashes) - words + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(words):
        rolled = rolled * factor + hashes[k:k + full]
    rolled = mix64(rolled)
    for first, last in zip(rows[:-1], rows[1:], strict=True):
        if last - first >= words:
            yield np.unique(rolled[first:last - words + 1])
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for at in range(first, last):
                whole = mix64(whole * factor + hashes[at:at + 1])
            yield whole
        else:
            yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray, scatter: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """All coordinates of one non-empty set."""
    places = scatter[(shingles & np.uint64(len(scatter) - 1)).astype(np.int64)]
    least = None
    for at in range(0, len(places), 2048):
        part = windows[places[at:at + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands do not meet."""
    cells = signatures.reshape(-1, bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2])
    for k in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return keys.view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_shingles, digest, keys): the set size, a 128-bit digest of the set and the keys of all bands."""

    def work(batch: pa.RecordBatch) -> dict:
        scatter, windows = permutations(UNIVERSE, bands * rows, seed)
        counts, digests, filled, made = [], [], [], []
        for part in slices(batch):
            for shingles in shingle_sets(part.column("text"), words):
                counts.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                filled.append(bool(len(shingles)))
                if len(shingles):
                    made.append(signature(shingles, scatter, windows))
        flat = band_keys(np.stack(made), bands, rows).ravel() if made else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(np.array(filled) * bands)))
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": pa.array(counts, pa.int64()),
            "digest": pa.array(digests, pa.binary()), "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
        }

    return per_batch(_read(docs), "doc_id long, n_shingles long, digest binary, keys array<long>", work)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b): nodes with one root are connected.

    Each round every node moves to the first of its neighbours and itself, and
    edges follow; edges within a node vanish. First is by number in even rounds,
    which folds a star about its least node at once, and by a random rank in odd
    ones, so that no numbering of a long path makes many rounds: what is left
    shrinks by a constant factor. Rounds are written to the shared folder.
    """
    left, moves = settled(edges.select("a", "b").distinct(), "edges"), []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).groupBy("a")
        if len(moves) % 2:
            seed = F.lit(len(moves))
            rank = lambda c: F.struct(F.xxhash64(c, seed).alias("r"), F.col(c).alias("n"))
            first = both.agg(F.min(rank("b")).alias("best")).select("a", F.least("best", rank("a"))["n"].alias("to"))
        else:
            first = both.agg(F.min("b").alias("best")).select("a", F.least("a", "best").alias("to"))
        move = settled(first, "moves")
        moves.append(move)
        ends = left.join(move.select("a", F.col("to").alias("x")), "a").join(
            move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b"
        )
        crossing = ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = settled(crossing.distinct(), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("a").alias("root"), "to")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots


def tiles(nodes: DataFrame, shared: DataFrame, tile: int = TILE, entry: int = ENTRY) -> DataFrame:
    """Deal the members of each candidate class to tiles, and tiles to groups that are compared.

    ``nodes`` is (node, root, n_shingles), ``shared`` (node, key) for the keys
    that several nodes have. Returns (node, root, tile, groups); a group is a
    pair of tiles that share a key, or a tile with itself.
    """
    weight = F.col("n_shingles") + entry
    upto = F.sum(weight).over(Window.partitionBy("root").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = settled(nodes.withColumn("tile", F.floor((upto - weight) / tile).cast("long")), "tiles")
    large = dealt.groupBy("root").agg(F.max("tile").alias("last")).filter("last > 0").select("root")
    seen = dealt.join(large, "root", "left_semi").join(shared, "node").select("root", "key", "tile").distinct()
    pairs = seen.alias("p").join(seen.alias("q"), ["root", "key"]).filter("p.tile < q.tile").select(
        "root", F.col("p.tile").alias("i"), F.col("q.tile").alias("j")
    ).distinct()
    both = pairs.select("root", F.col("i").alias("tile"), "i", "j").union(pairs.select("root", F.col("j").alias("tile"), "i", "j"))
    met = both.groupBy("root", "tile").agg(F.collect_list(F.struct("i", "j")).alias("met"))
    alone = F.array(F.struct(F.col("tile").alias("i"), F.col("tile").alias("j")))
    return dealt.join(met, ["root", "tile"], "left").select(
        "node", "root", "tile", F.coalesce(F.concat(alone, F.col("met")), alone).alias("groups")
    )


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    often = np.diff(np.concatenate((begin, [len(values)])))
    shared = np.zeros((n, n), np.float32)
    for d in range(2, min(LIGHT, n) + 1):
        at = begin[often == d]
        if len(at):
            owners = owner[at[:, None] + np.arange(d)]
            for i in range(d - 1):
                for j in range(i + 1, d):
                    shared += np.bincount(owners[:, i] * n + owners[:, j], minlength=n * n).reshape(n, n)
    heavy = np.flatnonzero(often > LIGHT)
    shared += shared.T
    for at in range(0, len(heavy), 4096):
        some = heavy[at:at + 4096]
        cells = np.zeros((n, len(some)), np.float32)
        for column, (start, count) in enumerate(zip(begin[some], often[some], strict=True)):
            cells[owner[start:start + count], column] = 1
        shared += cells @ cells.T
    return shared.astype(np.int64)


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the ids whose sets are linked, directly or through others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        linked = 100 * shared >= percent * (sizes.sum() - shared)
        return (ids[:1], ids[1:]) if linked else (ids[:0], ids[:0])
    shared = intersections(sets)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(linked, label[None, :], len(sets)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    other = label != np.arange(len(sets))
    return ids[other], ids[label[other]]


def links(docs: DataFrame, dealt: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): edges between documents that are linked on their full sets, for the classes of :func:`tiles`."""

    def collect(batch: pa.RecordBatch) -> dict:
        sets = [s.tobytes() for part in slices(batch) for s in shingle_sets(part.column("text"), words)]
        groups = batch.column("groups")
        rows = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(groups).to_numpy())
        pairs = groups.flatten()
        rows = pa.array(rows)
        return {
            "root": batch.column("root").take(rows), "i": pairs.field("i"), "j": pairs.field("j"),
            "node": batch.column("node").take(rows), "shingles": pa.array(sets, pa.binary()).take(rows),
        }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
            distinct = sorted(set(rows))
            if len(distinct) < 2:
                return None
            a, b = forest(np.array([r[0] for r in distinct]), [np.frombuffer(r[1], np.uint64) for r in distinct], percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        current, held = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("root", "i", "j", "node", "shingles")]
            for root, i, j, node, shingles in zip(*columns, strict=True):
                if (root, i, j) != current:
                    if (out := found(held)) is not None:
                        yield out
                    current, held = (root, i, j), []
                held.append((node, shingles))
        if (out := found(held)) is not None:
            yield out

    # Texts of documents in no candidate class are not shuffled.
    asked = possible(_read(docs), dealt.select(F.col("node").alias("doc_id")), "doc_id", "asked").filter("asked")
    texts = asked.join(dealt, F.col("doc_id") == F.col("node")).select("node", "root", "groups", "text")
    sets = per_batch(texts, "root long, i long, j long, node long, shingles binary", collect)
    ready = sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ready.mapInArrow(compare, "a long, b long").filter("a != b")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, tile: int = TILE
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all
    shingles of both. ``component_id`` is the least ``doc_id`` that links lead
    to; ``kept`` marks that document. A null or wordless text has no shingles
    and no links. Rows with one ``doc_id`` are one document: all their texts'
    links are its own. A row without ``doc_id`` cannot name a component: it has
    none and is kept. Empty tables give empty tables; other columns are not read.

    Sets that are equal are one node from the start, so exact copies cost a row
    each, however many there are. Bands find a pair at the threshold with
    probability 1 - (1 - 0.85^7)^36, all but one in a million, and more similar
    ones more surely; groups of copies hold many such pairs.
    """
    sketched = settled(sketches(docs, words, bands, rows), "sketches")
    known = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = settled(
        known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles")),
        "sets",
    )
    keyed = reps.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last")
    shared = settled(keyed.join(hubs.select("key", "hub"), "key"), "bands")
    classes = components(shared.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    nodes = classes.join(reps.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    dealt = settled(tiles(nodes, shared.select("node", "key"), tile, max(1, tile // 2048)), "dealt")
    members = settled(
        sketched.join(reps.select("digest", "node"), "digest", "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
        ),
        "members",
    )
    first = members.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    several = first.filter("a != b").select("doc_id", "a")
    same = members.join(several, "doc_id").filter("node != a").select("a", F.col("node").alias("b"))
    roots = settled(components(links(docs, dealt, words, percent).union(same)), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    found = F.coalesce("component_id", "node", "doc_id")
    return members.join(named, "node", "left").select(
        "doc_id", "n_shingles", found.alias("component_id"),
        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"),
    )
