"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns the columns of ``docs``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.llm.common import possible, read_table, settled
from gleanset.llm.minhash import near_duplicates
from gleanset.llm.mixing import mixed_texts
from gleanset.llm.packing import pack, pieces
from gleanset.llm.quality_rules import fit, passing
from gleanset.llm.queries import WORD_VOCABULARY
from gleanset.llm.secrets import redact


# Near copies leave the corpus from a Jaccard of 0.8 on; 42 bands of 6 miss (1 - 0.8^6)^42 of such pairs, three in a million.
NEAR = {"percent": 80, "bands": 42, "rows": 6}


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, which are fitted on all documents of the stage."""
    return passing(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id.

    Rows are judged by their own text under a number given once, so rows without
    an id and different texts under one id stay. Of equal ids the first row stays.
    """
    rows = settled(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), **NEAR)
    verdicts = settled(found.select(F.col("doc_id").alias("__row"), "component_id", "kept"), "verdicts")
    groups = verdicts.filter("NOT kept").select("component_id").distinct()
    members = settled(verdicts.join(groups, "component_id", "left_semi").join(rows.select("__row", "doc_id"), "__row"), "members")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    stays = members.groupBy("component_id").agg(F.min_by("__row", order).alias("__row"))
    leaves = settled(members.join(stays, "__row", "left_anti").select("__row"), "leaves")
    # Rows that surely stay are not shuffled; only the others meet the rows that leave.
    marked = possible(rows, leaves, "__row", "__open")
    kept = marked.filter("NOT __open").unionByName(marked.filter("__open").join(leaves, "__row", "left_anti").select(*marked.columns))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each time; a cut document ends at the cut."""
    return mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(pieces(docs, public_tokenizers.path(WORD_VOCABULARY)))


STAGES = [
    ("quality rules", good),
    ("near duplicates", distinct),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

# Token ids, hashes and models are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read back before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settled(docs, "stage")
    return docs
