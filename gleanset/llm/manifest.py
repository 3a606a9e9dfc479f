"""Merkle manifest of a dataset, built by slot pivots.

Every row is a leaf. Leaves of a group (a language, say) stand in order; every
``FANOUT`` consecutive nodes become one. A level is made by a pivot: conditional
aggregates spread the children of a parent into one column per slot. All columns
joined and hashed are the parent; all but a child's own are its siblings.

Levels are written as they are built, each with an eighth of the nodes below.
Proofs are handed down the other way: a parent's row holds its children, so
exploding its slots yields each child with its siblings, and a level is joined
with the proofs of its parents, never a document with its ancestors. Only the
highest level of the longest group sets the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.llm.common import settled

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows whose number has a CRC divisible by this are tampered with in the audit.
TAMPER = 3
PATH = "array<struct<left:string,right:string>>"


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, key, hash, forged): each row's leaf, and its leaf with A to Z of the text lower-cased if the audit picks the row.

    ``group`` is empty for null and otherwise begins with ``+``, so that null
    stands first. Rows without a key are never picked.
    """
    leaf = hashed(*[encoded(F.col(f"`{f}`")) for f in fields])
    lowered = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = hashed(*[encoded(lowered if f == text else F.col(f"`{f}`")) for f in fields])
    picked = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % TAMPER == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`")), F.lit("")).alias("group"), F.col(f"`{key}`").cast("long").alias("key"),
        leaf.alias("hash"), F.when(picked, other).alias("forged"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` from 0 and the size ``n`` of their group, in ``order`` within the group.

    Rows are dealt to ranges of (group, order) and numbered there; the ranges'
    counts, one row for each group in a range, give where each begins. A row
    number is the last key, so repeated rows spread over ranges, too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["group", *order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = settled(dealt.select(*rows.columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "placed")
    counts = dealt.groupBy("group", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "group", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"),
        F.sum("__n").over(Window.partitionBy("group")).alias("n"),
    )
    return dealt.join(bases, ["group", "__part"]).select(
        *rows.columns, (F.col("__at") - F.col("__first") + F.col("__base")).alias("pos"), "n"
    )


def pivoted(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(group, pos, n, slots, hash): parents of ``nodes``; each slot holds one child's payload, null behind a short run's end."""
    slot, child = F.col("pos") % FANOUT, F.struct(*payload)
    spread = nodes.groupBy("group", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
        F.first("n").alias("n"), *[F.max(F.when(slot == k, child)).alias(f"s{k}") for k in range(FANOUT)]
    )
    columns = [F.col(f"s{k}") for k in range(FANOUT)]
    joined = F.concat_ws("", *[c["hash"] for c in columns])
    return spread.select("group", "pos", F.ceil(F.col("n") / FANOUT).alias("n"), *columns, F.sha2(joined, 256).alias("hash"))


class Tree:
    """The written levels over ``leaves`` (group, pos, n, hash, payload) and the top node of every group."""

    def __init__(self, leaves: DataFrame, payload: list[str]):
        self.payload = payload
        self.levels: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        nodes, names = leaves, ["hash", *payload]
        while True:
            self.tops.append(nodes.filter("n = 1"))
            if nodes.filter("n > 1").isEmpty():
                break
            level = settled(pivoted(nodes.filter("n > 1"), names), "level")
            self.levels.append(level)
            nodes, names = level.select("group", "pos", "n", "hash"), ["hash"]

    def roots(self) -> DataFrame:
        """(group, hash) of all groups."""
        out = self.tops[0].select("group", "hash")
        for top in self.tops[1:]:
            out = out.union(top.select("group", "hash"))
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with payload, ``path`` and the columns of ``above``, which has (group, path) of every group.

        A path lists, level by level upwards, what stands left and right of the
        node in its run; the groups' own paths continue it.
        """
        extra = [c for c in above.columns if c not in ("group", "path")]
        paths = None
        for depth in range(len(self.tops) - 1, -1, -1):
            names = self.payload if depth == 0 else []
            reached = self.tops[depth].select("group", "pos", "hash", *names).join(above, "group")
            if depth < len(self.levels):
                met = self.levels[depth].drop("n", "hash").join(paths.drop("hash"), ["group", "pos"])
                reached = reached.unionByName(self._children(met, names, extra))
            paths = reached
        return paths

    @staticmethod
    def _children(parents: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
        hashes = [F.col(f"s{k}.hash") for k in range(FANOUT)]
        children = F.array(*[
            F.struct(
                F.lit(k).alias("slot"), F.col(f"s{k}").alias("child"),
                F.struct(F.concat_ws("", *hashes[:k]).alias("left"), F.concat_ws("", *hashes[k + 1:]).alias("right")).alias("step"),
            )
            for k in range(FANOUT)
        ])
        each = parents.select("group", "pos", "path", *extra, F.explode(F.filter(children, lambda c: c["child"].isNotNull())).alias("c"))
        return each.select(
            "group", (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), "c.child.hash", *[f"c.child.{n}" for n in names],
            F.concat(F.array("c.step"), F.col("path")).alias("path"), *extra,
        )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, group, leaf, forged, subroot, root, path) of every row of ``docs``.

    Leaves of a group ascend by key, null first; rows with one key stand by
    their leaves, and rows that are equal in all fields have equal leaves, so
    their order changes nothing. Groups are ordered by their bytes, null first.
    A group of one row has its leaf as subroot; with one group its subroot is
    the root. Null and empty fields differ. Columns other than ``fields`` are
    not read. An empty table gives an empty one.
    """
    rows = settled(placed(leaves(docs, fields, group, key, text), ["key", "hash"]), "leaves")
    tree = Tree(rows, ["key", "forged"])
    subroots = tree.roots().select(F.lit("").alias("group"), F.col("group").alias("member"), "hash")
    whole = Tree(settled(placed(subroots, ["member"]), "subroots"), ["member"])
    top = whole.roots().select(F.col("hash").alias("root"), F.lit("").alias("group"), F.expr(f"cast(array() AS {PATH})").alias("path"))
    members = whole.proofs(top).select(F.col("member").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    return tree.proofs(settled(members, "members")).select(
        "key", F.when(F.col("group") != "", F.substring("group", 2, 2147483647)).alias("group"), F.col("hash").alias("leaf"), "forged",
        "subroot", "root", "path",
    )


def audit(proven: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of :func:`manifest`.

    Rows that the audit picks are folded from their tampered leaf with the
    original siblings; ``verified`` tells whether the root comes out.
    """
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    reached = folded(F.coalesce("forged", "leaf"), F.col("path"))
    return proven.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), reached.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
