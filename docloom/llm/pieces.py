"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is parsed here, and its normaliser, metaspace marker,
scores (unigram models) or merges in order of scores (BPE models), and byte
fallback are rebuilt as a ``tokenizers.Tokenizer``. It encodes in multithreaded
batches, and its ids are the result; every whole text is verified against the
sentencepiece library, and ``parity`` says whether the two agree.

Defined results: null and empty texts have no ids, and no ids decode to an empty
text; repeated rows are encoded each; a null list of ids, and a null within one,
decode to null; ids that the model doesn't have are an error; other columns pass
through, but for those named like a result.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A model is sent with each task; larger files are refused.
MOST_MODEL_BYTES = 64 << 20
THREADS = 2
MARK = "▁"
#: Piece types and model types of the SentencePiece protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: what an unknown piece decodes to.
UNKNOWN_SURFACE = " \u2047 ".encode()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; fixed-width and nested values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Pieces:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True


def parse_model(data: bytes) -> Pieces:
    found = Pieces([])
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            found.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            found.model_type, found.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            if own.get(24):
                raise ValueError("models with the marker as a suffix are not supported")
        elif number == 3:
            own = dict(fields(value))
            found.charsmap, found.dummy_prefix, found.squeeze_spaces = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
            if not own.get(5, 1):
                raise ValueError("models that don't escape spaces are not supported")
    if found.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {found.model_type} is neither unigram nor BPE")
    return found


def build(model: Pieces):
    """(tokenizer of normalised texts, normaliser or None) for a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.model_type == UNIGRAM:
        top = max((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        core = models.Unigram([(p, len(p.encode()) * top - 0.1 if kind == USER_DEFINED else s) for p, s, kind in model.pieces], unknown, model.byte_fallback)
    else:
        usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [(-score, vocab[p], k, (p[:k], p[k:])) for p, score, kind in model.pieces if p in usable for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE(vocab, [m[-1] for m in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(True, True), normalizers.Replace(Regex(" {2,}"), " ")]
    tokenizer = Tokenizer(core)
    if model.model_type == BPE:  # pieces that users defined are matched before any others, the longest first
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED])
    return tokenizer, normalizers.Sequence(steps) if steps else None


class Codec:
    """Encodes and decodes texts in one task."""

    def __init__(self, data: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = parse_model(data)
        self.tokenizer, self.normalizer = build(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        spelled = [self._spelled(piece, kind) for piece, _, kind in self.model.pieces]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.ends = np.cumsum([0, *map(len, spelled)])
        self.kinds = np.array([kind for _, _, kind in self.model.pieces])

    @staticmethod
    def _spelled(piece: str, kind: int) -> bytes:
        """What a piece stands for in a decoded text."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else UNKNOWN_SURFACE if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalised(self, text: str) -> str:
        """The text as pieces spell it."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts end to end, the number of each text's, and whether both libraries agree on a text."""
        mine = [e.ids for e in self.tokenizer.encode_batch_fast([self.normalised(t or "") for t in texts], add_special_tokens=False)]
        theirs = self.other.encode([t or "" for t in texts], num_threads=THREADS)
        (ids, sizes), (others, other_sizes) = _end_to_end(mine), _end_to_end(theirs)
        agree = sizes == other_sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        kept, compared = agree[row], np.repeat(agree, other_sizes)
        agree[row[kept][ids[kept] != others[compared]]] = False
        return ids, sizes, agree

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Pieces put together: markers as blanks, byte pieces as bytes, the blank that encoding put first taken off."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ends) - 1):
            raise ValueError("an id is none of the model's")
        begin = self.ends[ids]
        long = self.ends[ids + 1] - begin
        ends = np.cumsum(long)
        data = self.spelled[np.repeat(begin - ends + long, long) + np.arange(long.sum())].tobytes()
        starts = np.append(0, np.cumsum(sizes))
        cuts = np.append(0, ends)[starts].tolist()
        texts = [data[a:b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if not self.model.dummy_prefix:
            return texts
        unknown = np.append(self.kinds[ids] == UNKNOWN, False)[starts[:-1]].tolist()
        return [t if u else t.removeprefix(" ") for t, u in zip(texts, unknown, strict=True)]


def _end_to_end(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def model_bytes(path: str = MODEL_PATH) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MOST_MODEL_BYTES} bytes")
    return data


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.record_batch([*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns])


def _schema(df: DataFrame, *fields_: T.StructField) -> T.StructType:
    names = {f.name for f in fields_}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields_])


IDS = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("parity", T.BooleanType())
DECODED = T.StructField("decoded", T.StringType())


def _encoded(own: Codec, texts: pa.Array) -> dict[str, pa.Array]:
    ids, sizes, agree = own.encode(texts.to_pylist())
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
    return {"ids": lists, "n_tokens": pa.array(sizes), "parity": pa.array(agree)}


def _decoded(own: Codec, lists: pa.ListArray) -> dict[str, pa.Array]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    gone = ~np.asarray(lists.is_valid())
    gone[np.repeat(np.arange(len(sizes)), sizes)[np.asarray(flat.is_null())]] = True
    texts = own.decode(flat.fill_null(0).to_numpy().astype(np.int64), sizes)
    return {"decoded": pa.array(texts, pa.string(), mask=gone)}


def _mapped(rows: DataFrame, path: str, batch: int, work: Callable[[Codec, pa.RecordBatch], dict[str, pa.Array]], *made: T.StructField) -> DataFrame:
    data = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                yield _with(part, **work(own, part))

    return rows.mapInArrow(run, _schema(rows, *made))


def encode(docs: DataFrame, path: str = MODEL_PATH, batch: int = 200) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and ``parity``; columns of these names are replaced."""
    return _mapped(docs, path, batch, lambda own, part: _encoded(own, part.column("text")), *IDS)


def decode(rows: DataFrame, path: str = MODEL_PATH, column: str = "ids", batch: int = 200) -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids in ``column``."""
    return _mapped(rows, path, batch, lambda own, part: _decoded(own, part.column(column)), DECODED)


def round_trips(docs: DataFrame, path: str = MODEL_PATH, batch: int = 200) -> DataFrame:
    """Encode and decode ``docs`` in one pass: the columns of ``encode``, and ``decoded``."""

    def both(own: Codec, part: pa.RecordBatch) -> dict[str, pa.Array]:
        made = _encoded(own, part.column("text"))
        return made | _decoded(own, made["ids"])

    return _mapped(docs, path, batch, both, *IDS, DECODED)


def ids_digest(column: str = "ids"):
    """CRC-32 of the ids as decimal text, joined by blanks."""
    return F.crc32(F.array_join(F.col(column).cast("array<string>"), " "))
