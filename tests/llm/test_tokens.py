"""Cached encoders and prefix counts against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanset.llm.token_counts import prefix_table, stored_counts, tokens_of_prefix, within_budget
from gleanset.llm.tokens import SpaceDropping, SpaceLeading, prefix_counts, vocabulary
from tests.llm import cases

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = st.sampled_from([
    "the", "Thiner", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "'re", "don't", "é", "Ünß", "İ", "日本", "½", "²", "4", "123", "!!!", "...", "&&&",
    "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", " ", "́", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "-----", "_x", ",", "ΑΣ ",
])
TEXT = st.one_of(st.lists(PARTS, max_size=25).map("".join), st.text(max_size=60))


@pytest.mark.parametrize("path, kind", [(WORD, SpaceDropping), (BYTE, SpaceLeading)])
@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_are_the_librarys(path, kind, text):
    encoder = vocabulary(path)
    assert isinstance(encoder, kind)
    assert encoder.ids(text) == encoder.plain_ids(text)


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_every_prefix_count(text):
    encoder = vocabulary(WORD)
    expected = [len(encoder.plain_ids(text[:i + 1])) // 4 for i in range(len(text))]
    assert prefix_counts(WORD).counts(text).tolist() == expected


def test_long_runs_cost_no_more_per_character():
    for text in ("a" * 20_000, "!" * 5_000, "xy" * 4_000, "日本語テキスト" * 1_000):
        counts = prefix_counts(WORD).counts(text)
        assert counts[-1] == len(vocabulary(WORD).plain_ids(text)) // 4
        assert counts[999] == len(vocabulary(WORD).plain_ids(text[:1000])) // 4


def test_stored_counts_answer_without_encoding(spark):
    docs = cases.documents(spark)
    table = prefix_table(docs, WORD)
    plain = {}
    for doc_id, text in cases.texts(docs):
        plain.setdefault(doc_id, []).append((len(text.encode()), len(vocabulary(WORD).plain_ids(text)) // 4))
    rows = within_budget(table, 100).collect()
    assert len(rows) == docs.count()
    for doc_id, own in plain.items():
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] == doc_id) == sorted(own)
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    long = next(r for r in rows if r["doc_id"] == 5)
    assert len(vocabulary(WORD).plain_ids(cases.LONG[:long["fitting_chars"]])) // 4 == 100
    first = {(r["doc_id"], r["n_tokens"]) for r in tokens_of_prefix(table, 30).collect()}
    assert (5, len(vocabulary(WORD).plain_ids(cases.LONG[:30])) // 4) in first and (3, 0) in first
    stored = next(r for r in table.collect() if r["doc_id"] == 9)
    assert stored_counts(stored["width"], stored["changes"])[-1] == stored["n_tokens"]


def test_empty_table(spark):
    assert within_budget(prefix_table(cases.empty(spark), WORD), 10).count() == 0


def test_checksum_is_of_little_endian_ids():
    ids = np.frombuffer(vocabulary(BYTE).ids("hello world"), "<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(vocabulary(BYTE).plain_ids("hello world"))
