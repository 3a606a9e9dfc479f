import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanset.llm.token_files import chunk_index, decode_block, decode_chunk, encode_chunk, read_documents, write_files
from gleanset.llm.tokens import vocabulary
from tests.llm import cases

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from([1, 8]), st.sampled_from([1, 7, 64]))
def test_round_trip(ids, bits, block):
    ids = np.array(ids, "<u4")
    payload = encode_chunk(ids, bits, block)
    assert decode_chunk(payload).tolist() == ids.tolist()
    for number in range(-(-len(ids) // block)):
        assert decode_block(payload, number).tolist() == ids[number * block:(number + 1) * block].tolist()


def test_high_planes_cost_nothing():
    small = np.arange(50_000, dtype="<u4") % 50_000
    assert len(encode_chunk(small, 8)) < 2.1 * len(small)
    with pytest.raises(ValueError):
        decode_chunk(b"x" * 40)


@pytest.mark.parametrize("bits", [1, 8])
def test_files_of_awkward_documents(spark, tmp_path, bits):
    docs = cases.documents(spark)
    folder = str(tmp_path / "planes")
    write_files(docs, BYTE, folder, bits, parts=3)
    rows = sorted(read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    expected = sorted(
        (doc_id is not None, doc_id or 0, vocabulary(BYTE).plain_ids(text) + b"\0\0\0\0") for doc_id, text in cases.texts(docs)
    )
    assert [r["doc_id"] for r in rows] == [d if there else None for there, d, _ in expected]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in rows) == expected
    at = 0
    for r in rows:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]
    assert chunk_index(spark, folder).agg({"n_ids": "sum"}).first()[0] == at


def test_empty_table(spark, tmp_path):
    write_files(cases.empty(spark), BYTE, str(tmp_path / "none"))
    assert read_documents(spark, str(tmp_path / "none")).count() == 0
