import struct
from pathlib import Path

import numpy as np
import pytest

from docloom.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
needs_model = pytest.mark.skipif(not Path(pieces.MODEL_PATH).exists(), reason="no model file")

TEXTS = ["", None, "Hello world", "  two  leading", "a\n\nb\tc", "日本語 und Grüße \U0001f600", "▁ marks ▁▁", "x" * 500, "a" + " " * 40 + "b", "<s> not </s> control <0x41>", "é e\u0301", "\x00 nul", " ", "trailing  "]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def small_model(more=(), kind=pieces.UNIGRAM):
    """A small model with byte fallback, written by hand."""
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    own += [(p, -float(k) / 3, 1) for k, p in enumerate(["▁", "▁the", "the", "▁a", "a", "b", "c", "ab", "bc", "abc", "t", "h", "e", "▁ab", "he", "th"], 1)] + list(more)
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in own)
    trainer = field(3, kind) + field(35, 1) + field(4, len(own))
    normalizer = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return body + field(2, trainer) + field(3, normalizer)


def lists(ids, sizes):
    ends = np.cumsum(sizes).tolist()
    return [ids[b - n : b].tolist() for b, n in zip(ends, sizes.tolist(), strict=True)]


def decoded(codec, ids):
    return codec.decode(np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64))


def checked(data, texts):
    """The codec, its ids by text and sentencepiece's, once parity is seen to say which are equal."""
    codec = pieces.Codec(data)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, sizes, agree = codec.encode(texts)
    got, want = lists(ids, sizes), other.encode([t or "" for t in texts])
    assert [e.ids for e in codec.tokenizer.encode_batch([codec.normalised(t or "") for t in texts])] == got
    assert agree.tolist() == [a == b for a, b in zip(got, want, strict=True)]
    return codec, got, want


def test_unigram_model_parity():
    codec, got, want = checked(small_model(), ["the abc", "abcabc the  the", "Zé", "", None, "tthhee bcbc"])
    assert codec.model.model_type == pieces.UNIGRAM and codec.model.byte_fallback
    assert got == want
    assert decoded(codec, got)[:3] == ["the abc", "abcabc the  the", "Zé"]


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
def test_pieces_that_users_define(kind):
    own = [("a▁b", 0.0, pieces.USER_DEFINED), ("cab", 0.0, pieces.USER_DEFINED), ("ca", 0.0, pieces.USER_DEFINED)]
    _, got, want = checked(small_model(own, kind), ["the a b", "cab ca", "abca bcab", "ab a c"])
    assert got == want


def test_parity_is_false_where_the_libraries_differ():
    codec = pieces.Codec(small_model())
    codec.other = sentencepiece.SentencePieceProcessor(model_proto=small_model([("abcab", 5.0, pieces.NORMAL)]))
    ids, sizes, agree = codec.encode(["the", "abcab the", "", "abc", "abcab"])
    assert agree.tolist() == [True, False, True, True, False]
    assert decoded(codec, lists(ids, sizes)) == ["the", "abcab the", "", "abc", "abcab"]


@needs_model
def test_bpe_model_parity():
    codec, got, want = checked(pieces.model_bytes(), TEXTS)
    more = [*got, [1, 13, 2], [0, 300, 0x41 + 3], [300, 0]]
    assert decoded(codec, more) == codec.other.decode(more)
    assert codec.model.model_type == pieces.BPE and codec.model.byte_fallback
    assert [a == b for a, b in zip(got, want, strict=True)][:6] == [True] * 6
    assert decoded(codec, got)[2:6] == TEXTS[2:6]


@needs_model
def test_decoding_is_that_of_the_tokenizers_decoder():
    from tokenizers import decoders

    codec, got, _ = checked(pieces.model_bytes(), TEXTS)
    codec.tokenizer.decoder = decoders.Sequence([decoders.Replace("▁", " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    assert decoded(codec, got) == codec.tokenizer.decode_batch(got, skip_special_tokens=False)
    with pytest.raises(ValueError):
        decoded(codec, [[1, 1 << 20]])


@needs_model
def test_round_trip(spark, edges, no_docs):
    rows = pieces.round_trips(edges).collect()
    assert len(rows) == 14 and set(edges.columns) <= set(rows[0].asDict())
    for r in rows:
        assert r.parity and r.n_tokens == len(r.ids) and r.decoded == (r.text or "")
    assert pieces.round_trips(no_docs).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [15043, None]), (4, [15043])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(nulls).collect()} == {1: None, 2: "", 3: None, 4: "discovery"}
