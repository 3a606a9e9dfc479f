"""The queries of the corpus operators and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.llm.common import read_table
from gleanset.llm.cotraining import scored, train
from gleanset.llm.language import identify, language_models
from gleanset.llm.manifest import audit, manifest
from gleanset.llm.minhash import near_duplicates
from gleanset.llm.mixing import mix, word_counts
from gleanset.llm.packing import pack, pieces
from gleanset.llm.quality_rules import fit, measured
from gleanset.llm.secrets import scan
from gleanset.llm.token_counts import prefix_table, within_budget
from gleanset.llm.token_files import read_documents, write_files
from gleanset.llm.topk import top_inner_products
from gleanset.llm.trie_join import similar_classes
from gleanset.llm.whitening import whitened
from gleanset.session import scratch_path

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 2048


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)))


def co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, train(docs, read_table(spark, sf_dir, "labels")))


def likelihood_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return measured(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(word_counts(read_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def norm_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


NORM_SORTED_SEARCH_SQL = """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
    QUALIFY rank <= 5
"""


CIRCULANT_MINHASH_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM words
    ), cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared
        FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), linked AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (nx + ny - shared)),
    edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
    reached AS (
        SELECT doc_id, doc_id AS other FROM sets
        UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
    ), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""


PREFIX_TREE_JOIN_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM words
    ), cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared
        FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), linked AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (nx + ny - shared)),
    edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
    reached AS (
        SELECT doc_id, doc_id AS other FROM sets
        UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
    ), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""


def bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "planes")
    write_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), folder)
    return read_documents(spark, folder)


def entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "pages"), *language_models(read_table(spark, sf_dir, "documents")))


def prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prefix_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return within_budget(table, TOKEN_LIMIT)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(manifest(read_table(spark, sf_dir, "documents")))


# Bytes are taken one by one for the CRC: each is mixed in, then eight shifts follow (entries of -1).
MERKLE_MANIFEST_SQL = r"""
    WITH RECURSIVE fields AS (
        SELECT doc_id, coalesce('+' || lang, '') AS g, text,
            coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
            || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
            list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
        FROM documents
    ), leaves AS (
        SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
            CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')) END AS forged
        FROM fields
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
    ), nodes AS (
        SELECT g, 0 AS level, pos, n, leaf AS hash FROM placed
        UNION ALL
        SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, n, pos // 8
    ), subroots AS (
        SELECT g, level, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), uppers AS (
        SELECT 0 AS level, pos, n, hash FROM subroots
        UNION ALL
        SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY level, n, pos // 8
    ), runs AS (
        SELECT g, level, pos // 8 AS run, list(hash ORDER BY pos) AS members, false AS upper FROM nodes WHERE n > 1 GROUP BY ALL
        UNION ALL SELECT '', level, pos // 8, list(hash ORDER BY pos), true FROM uppers WHERE n > 1 GROUP BY ALL
    ), folds AS (
        SELECT p.doc_id, p.leaf, p.g AS own, s.level AS height, s.pos AS place, p.g, false AS upper, 0 AS level, p.pos, p.n,
            coalesce(p.forged, p.leaf) AS node, '' AS proof
        FROM placed p JOIN subroots s ON p.g = s.g
        UNION ALL
        SELECT f.doc_id, f.leaf, f.own, f.height, f.place,
            CASE WHEN f.n = 1 THEN '' ELSE f.g END, f.upper OR f.n = 1,
            CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN f.place ELSE f.pos // 8 END,
            CASE WHEN f.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (f.n + 7) // 8 END,
            CASE WHEN f.n = 1 THEN f.node
                ELSE sha256(array_to_string(r.members[:f.pos % 8], '') || f.node || array_to_string(r.members[f.pos % 8 + 2:], '')) END,
            CASE WHEN f.n = 1 THEN f.proof
                ELSE f.proof || array_to_string(r.members[:f.pos % 8], '') || array_to_string(r.members[f.pos % 8 + 2:], '') END
        FROM folds f LEFT JOIN runs r ON f.n > 1 AND f.g = r.g AND f.upper = r.upper AND f.level = r.level AND f.pos // 8 = r.run
        WHERE f.n > 1 OR NOT f.upper
    )
    SELECT f.doc_id, f.leaf, s.hash AS subroot, u.hash AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = u.hash AS verified
    FROM folds f JOIN subroots s ON f.own = s.g JOIN (SELECT hash FROM uppers WHERE n = 1) u ON true
    WHERE f.upper AND f.n = 1
"""


def prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read_table(spark, sf_dir, "documents"))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_co_training": co_training,
    "op3_likelihood_ratio_rules": likelihood_ratio_rules,
    "op4_source_mix": source_mix,
    "op5_circulant_minhash": circulant_minhash,
    "op6_norm_sorted_search": norm_sorted_search,
    "op7_bit_plane_files": bit_plane_files,
    "op8_entropy_secrets": entropy_secrets,
    "op9_evidence_fusion": evidence_fusion,
    "op10_prefix_token_counts": prefix_token_counts,
    "op11_merkle_manifest": merkle_manifest,
    "op12_prefix_tree_join": prefix_tree_join,
    "op13_embedding_whitening": embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op5_circulant_minhash": CIRCULANT_MINHASH_SQL,
    "op6_norm_sorted_search": NORM_SORTED_SEARCH_SQL,
    "op11_merkle_manifest": MERKLE_MANIFEST_SQL,
    "op12_prefix_tree_join": PREFIX_TREE_JOIN_SQL,
}
