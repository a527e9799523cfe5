"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file's protobuf is parsed here; pieces, scores, types and the normaliser's settings are rebuilt as a tokenizer:
the precompiled character map if there is one, white space as the marker U+2581 with or without a dummy prefix, pieces by
unigram scores or, for models of BPE type, by merges ranked by score, unknown characters as byte pieces. Parity with the
SentencePiece library is verified on PROBES whenever texts are to be encoded or decoded; tests verify it on whole documents.

As no piece has the marker after another sign (checked), words can be encoded one by one, which lets the library's cache
work; models with such pieces are encoded without this split. Batches are encoded by the library's threads.

Nulls: a null text counts as empty and has no tokens. Texts are never cut. Repeated rows get equal results, an empty table
an empty one. Other columns pass through.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.process import kept
from barlight.llm.tables import read, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Threads that encode the batches of a task.
THREADS = 2
#: Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

PROBES = ["", " ", "a", " a", "a ", "  two  spaces ", "line\nbreak\r\n\ttab", "Éléphant çà et là, œuvre", "Größe über Straße", "日本語 \U0001f600 ▁ mark", "<s> </s> <unk> <0x0A>", "x=1;y=[2,3]", "\x00\x07", "ABC" * 50, " nbsp　wide", "é combining"]


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    suffix: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, data[at : at + n]
            at += n


def parsed(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.types.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback, m.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score of the third first."""
    score = {p: s for p, s, t in zip(m.pieces, m.scores, m.types, strict=True) if t == NORMAL}
    out = []
    for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)):
        if t == NORMAL and len(p) > 1:
            out += [(-score[p], i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    return [(a, b) for _, _, _, a, b in sorted(out)]


def backend(data: bytes):
    """A tokenizer of the tokenizers library that encodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parsed(data)
    if m.suffix:
        raise ValueError("white space as a suffix is not supported")
    unk = m.types.index(UNKNOWN)
    if m.kind == BPE:
        tokenizer = Tokenizer(models.BPE({p: i for i, p in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[unk], fuse_unk=True, byte_fallback=m.byte_fallback))
    elif m.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram(list(zip(m.pieces, m.scores, strict=True)), unk, m.byte_fallback))
    else:
        raise ValueError(f"model type {m.kind} is not supported")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ "), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    if m.squeeze:  # at the end markers in the text itself go as well
        steps.append(normalizers.Replace(Regex(f"{MARKER}+$"), ""))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARKER in p.lstrip(MARKER) for p in m.pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix or m.squeeze else [])])
    return tokenizer


class Coder:
    """Encodes and decodes whole texts with a backend. Where words can be encoded one by one, each new word of a batch is
    encoded once, all of them in one multithreaded call; what words encode to is kept, up to KEPT of them."""

    KEPT = 300_000

    def __init__(self, data: bytes):
        from tokenizers import pre_tokenizers

        self.backend = backend(data)
        m = parsed(data)
        self.prefix = m.dummy_prefix
        self.simple = not m.charsmap and not m.squeeze
        self.split = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+").findall if self.backend.pre_tokenizer else None
        self.known: dict[str, bytes] = {}
        if self.split:
            self.words = backend(data)
            self.words.normalizer = normalizers_none()
            self.words.pre_tokenizer = pre_tokenizers.Sequence([])
        self.squeeze = m.squeeze
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARKER, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]

    def marked(self, text: str) -> str:
        """What the normaliser does if it has no character map and keeps runs of spaces."""
        return (MARKER if self.prefix else "") + text.replace(" ", MARKER)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of int32."""
        pack = lambda e: np.array(e.ids, np.int32).tobytes()
        if not self.split:
            return [pack(e) for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        normal = self.marked if self.simple else self.backend.normalizer.normalize_str
        words = [self.split(normal(x)) if x else [] for x in texts]
        if len(self.known) > self.KEPT:
            self.known.clear()
        new = list(set(chain.from_iterable(words)) - self.known.keys())
        self.known.update((w, pack(e)) for w, e in zip(new, self.words.encode_batch_fast(new, add_special_tokens=False), strict=True))
        return [b"".join(map(self.known.__getitem__, x)) for x in words]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """A text starts without the marker that was put before it; where spaces are squeezed, each piece loses one until there is
        text. Bytes that are no UTF-8 go through the backend itself."""
        out = []
        for x in ids:
            found = list(map(self.bytes.__getitem__, x))
            at = 0
            while at < len(found) and (self.squeeze or self.prefix and not at):
                found[at] = found[at].removeprefix(b" ")
                if found[at]:
                    break
                at += 1
            try:
                out.append(b"".join(found).decode())
            except UnicodeDecodeError:
                out.append(self.backend.decode(x, skip_special_tokens=False))
        return out


def normalizers_none():
    from tokenizers import normalizers

    return normalizers.Sequence([])


def built(data: bytes) -> Coder:
    return kept(data, lambda: Coder(data))


def verified(data: bytes) -> Coder:
    """A coder, after comparing it and its backend with the SentencePiece library on PROBES."""
    import sentencepiece

    coder, other = built(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text, ids, encoding in zip(PROBES, coder.encode(PROBES), coder.backend.encode_batch(PROBES, add_special_tokens=False), strict=True):
        want = other.encode(text)
        if not ids == encoding.ids == want or not coder.decode([want])[0] == coder.backend.decode(want, skip_special_tokens=False) == other.decode(want):
            raise ValueError(f"{text!r} is encoded as {ids} and, by the backend, as {encoding.ids}; the model has {want}")
    return coder


def encoded(df: DataFrame, data: bytes, text: str = "text", threads: int = THREADS, columns: list[str] | None = None) -> DataFrame:
    """row (all columns of df, or those named), ids, and round_trip: whether decoding gives the text again (models that normalise
    texts need not)."""
    small_batches(df.sparkSession, 500)
    verified(data)
    rows = df.select(F.struct(*(columns or ["*"])).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        coder = built(data)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packed = coder.packed(texts)
            again = coder.decode([np.frombuffer(x, np.int32).tolist() for x in packed])
            off = np.append(0, np.cumsum([len(x) // 4 for x in packed])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([a == b for a, b in zip(texts, again, strict=True)])], ["row", "ids", "round_trip"])

    return rows.mapInArrow(encode, schema)


def decoded(df: DataFrame, data: bytes, ids: str = "ids") -> DataFrame:
    """df with a column decoded_text: what the ids stand for (null ids: an empty text)."""
    verified(data)

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return pd.Series(built(data).decode([[] if x is None else list(x) for x in column]))

    return df.withColumn("decoded_text", decode(ids))


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read on the driver; tasks get its bytes."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise FileNotFoundError(f"no SentencePiece model at {path}; name one that the driver can read") from e


def op7_sentencepiece(spark, sf_dir, model: str = MODEL):
    out = encoded(read(spark, sf_dir, "documents"), model_bytes(model), columns=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
