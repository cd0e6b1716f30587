import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import token_rans as op
from inkstone.llm.queries import tokenizer_path
from tests.llm.fixtures import documents, frame


@pytest.fixture(scope="module")
def encoder():
    return op.WordEncoder(tokenizer_path())


def whole(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, op.END_ID]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abÀÉéßﬀ'st ll\n\t.,-12<|>Í  Σσ", max_size=60))
def test_words_alone_give_the_ids_of_whole_texts(text):
    encoder = op._ENCODERS.setdefault("t", None) or op.WordEncoder(tokenizer_path())
    op._ENCODERS["t"] = encoder
    flat, n = op.encode_texts(encoder, pa.array([text, None, text]))
    want = whole(encoder, text)
    assert flat.tolist() == want + [op.END_ID] + want and n.tolist() == [len(want), 1, len(want)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 200000), st.integers(1, 400))
def test_blocks_round_trip(seed, n, kinds):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32) * 7
    seen, counts = np.unique(ids, return_counts=True)
    table = op.Table.of_counts(seen.astype(np.int64), counts)
    assert table.freq.sum() == 1 << op.SCALE_BITS
    data = op.encode_block(ids, table)
    assert np.array_equal(op.decode_block(data, table), ids)


def test_a_block_spans_many_checkpoints_and_is_near_its_entropy():
    rng = np.random.default_rng(1)
    ids = rng.geometric(0.05, 700_001).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    table = op.Table.of_counts(seen.astype(np.int64), counts)
    data = op.encode_block(ids, table)
    p = counts / counts.sum()
    assert len(data) < 1.03 * -(counts * np.log2(p)).sum() / 8
    assert op.HEAD.unpack_from(data)[4] > 1
    assert np.array_equal(op.decode_block(data, table), ids)


def test_damage_is_noticed():
    table = op.Table.of_counts(np.arange(5), np.arange(1, 6))
    data = bytearray(op.encode_block(np.arange(5, dtype=np.uint32), table))
    data[30] ^= 1
    with pytest.raises(ValueError):
        op.decode_block(bytes(data), table)


def test_packed_ids_round_trip():
    for ids in ([], [0], [1, 255, 256, 65535], [65536, 5], [2**32 - 1]):
        flat, n = np.array([*ids, 7], "<u4"), np.array([len(ids), 1])
        first, last = op.packed_ids(flat, n).to_pylist()
        assert op.unpack_ids(first, len(ids)).tolist() == ids and op.unpack_ids(last, 1).tolist() == [7]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = op.WordEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_word
    texts = ["Two  words, and more", "", None, "  é\n", "Two  words, and more"]
    flat, n = op.encode_texts(encoder, pa.array(texts))
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, op.END_ID] for t in texts]
    assert flat.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_forgetting_pieces_changes_nothing(encoder):
    forgetful, kept = op.WordEncoder(tokenizer_path()), op.REMEMBERED
    op.REMEMBERED = 5
    try:
        for _ in range(3):
            texts = pa.array([r[1] for r in documents()])
            assert all(np.array_equal(a, b) for a, b in zip(op.encode_texts(forgetful, texts), op.encode_texts(encoder, texts), strict=True))
    finally:
        op.REMEMBERED = kept


def test_files_return_every_document(spark, encoder):
    rows = documents()
    for block in (1 << 20, 500):
        got = sorted(((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in op.round_trip(frame(spark), tokenizer_path(), block).collect()))
        start, want = 0, []
        for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
            ids = whole(encoder, text)
            want.append((start, str(doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    assert op.round_trip(frame(spark, []), tokenizer_path()).count() == 0
