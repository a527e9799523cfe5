"""SentencePiece encoding against the library itself: whole documents, and small models of both kinds made by hand."""

import struct

import pytest
import sentencepiece

from barlight.llm import pieces as P
from barlight.llm.tables import read

TEXTS = ["", "a", "hello world", "  hello   world  ", "hello\nworld\tabc", "hello wörld \U0001f600", "　wide　", "lo lo lo hell", "\x00 nul", "ab" * 3000, "▁hello ▁"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """A protobuf message of (number, value): ints as varints, floats as fixed, bytes as they are."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model(kind, bytes_too, squeeze, prefix):
    found = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    found += [(f"<0x{i:02X}>", 0.0, P.BYTE) for i in range(256)] * bytes_too
    letters = "helowrdabc▁"
    words = ["he", "ll", "lo", "hel", "ell", "hell", "hello", "▁hell", "▁hello", "▁w", "or", "ld", "wor", "world", "▁world", "▁lo", "ab", "abc", "▁h", "▁he", "▁l"]
    found += [(w, -float(i + 1), P.NORMAL) for i, w in enumerate([*words, *letters])]
    out = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in found)
    out += message((2, message((3, kind), (4, len(found)), (35, int(bytes_too)))))
    return out + message((3, message((1, b"identity"), (3, int(prefix)), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("bytes_too", [True, False])
@pytest.mark.parametrize("kind", [P.UNIGRAM, P.BPE])
def test_small_models(kind, bytes_too, squeeze, prefix):
    data = model(kind, bytes_too, squeeze, prefix)
    other, coder = sentencepiece.SentencePieceProcessor(model_proto=data), P.Coder(data)
    for text in TEXTS:
        want = other.encode(text)
        assert coder.encode([text])[0] == want, text
        if bytes_too:
            assert coder.decode([want])[0] == other.decode(want), text


def test_whole_documents(spark):
    data = P.model_bytes()
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    docs = {r.doc_id: r.text or "" for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = P.op7_sentencepiece(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.ids == other.encode(docs[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip == (other.decode(r.ids) == docs[r.doc_id])


def test_odd_rows(spark):
    rows = [(1, None, 1, "i"), (2, "", 2, "i"), (3, "same", 3, "i"), (3, "same", 3, "i"), (None, "long " * 100_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, ids string")
    got = P.encoded(df, P.model_bytes())
    assert sorted(len(r.ids) for r in got.collect())[:2] == [0, 0] and all(r.round_trip for r in got.collect()) and got.select("row.*").columns == df.columns
    back = P.decoded(got.select("row", "ids"), P.model_bytes()).collect()
    assert all(r.decoded_text == (r["row"].text or "") for r in back)
    assert P.encoded(df.where("false"), P.model_bytes()).count() == 0
    with pytest.raises(FileNotFoundError, match="no SentencePiece model"):
        P.model_bytes("/nowhere/piece.model")
