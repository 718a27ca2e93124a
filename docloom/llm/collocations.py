"""Phrase collocation mining: hierarchical pair naming.

Texts are cut into pieces at ``.,;:!?`` and line ends, and pieces into words. Every
language is mined by itself. Phrases get names level by level: a frequent word has
an id, and a frequent phrase of k words is the pair of the ids of its first and
its last k-1 words, counted over all texts and named by a join. A pair's two ids
are its parent pointers: following the left ones gives a phrase's first words,
following the right ones its last, so the counts of every cut, and what a longer
phrase holds, are looked up by name and never searched in texts.

Texts are read once and kept as chunks of word numbers. At each level a chunk
sends its distinct pairs, with counts, to the buckets of their hashes; a bucket
adds them up, names those that are frequent enough and answers every chunk with
the names of what it sent. A pair that is rarer than ``least`` can be part of no
longer frequent phrase, so only named pairs are paired again: nothing is lost.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated
rows count each; a word of any length is a word; ties fall as ``mine`` says; an
empty table gives no rows; other columns than ``lang`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import staged
from docloom.llm.words import U64, _hashed, _LOWER, bucket_of, mixed, pack, runs, text_bytes, unpack

UNKNOWN = "und"
#: Bytes of texts in a chunk (a longer text is a chunk by itself), and tokens of the corpus for each bucket.
CHUNK_BYTES, BUCKET_TOKENS = 4 << 20, 1 << 20
#: Parts that a language's phrases are ranked in before the parts' firsts are ranked together.
RANK_PARTS = 16
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP[[9, 32]] = True
_GAP |= _BREAK
#: Bytes of an id below 2 ** 32, and of a wider one.
SHORT, LONG = 4, 8
#: A pair of ids and how often it stands in a chunk.
PAIR = np.dtype([("left", "<u8"), ("right", "<u8"), ("f", "<u4")])
NARROW = np.dtype([("left", "<u4"), ("right", "<u4"), ("f", "<u4")])
CHUNK = "chunk long, n long, seq binary, words array<struct<lang:string,word:string,f:long>>"
ASKED = "bucket int, chunk long, pairs binary"
NAMED = "chunk long, bucket int, ids binary, id long, left long, right long, f long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, the row of each, and whether a piece begins with it."""
    inside = ~_GAP[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    breaks = np.cumsum(_BREAK[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    first = np.ones(len(start), bool)
    first[1:] = (breaks[start[1:]] != breaks[end[:-1] - 1]) | (row[1:] != row[:-1])
    return start, end, row, first


def _chunk(number: int, table: pa.Table) -> pa.RecordBatch:
    """A chunk's words as numbers from 1 in order of first use, with a 0 between pieces, and the distinct words."""
    table = table.combine_chunks()
    data, offsets = text_bytes(table["text"].chunk(0))
    data = _LOWER[data]
    start, end, row, first = _words(data, offsets)
    lang = pc.dictionary_encode(table["lang"].chunk(0).fill_null(UNKNOWN))
    langs, of = lang.dictionary.to_pylist(), lang.indices.to_numpy()[row]
    numbers, distinct = pd.factorize(mixed(_hashed(data, start, end) + mixed(of.astype(U64) + U64(1))))
    at = np.zeros(len(distinct), np.int64)
    at[numbers[::-1]] = np.arange(len(numbers))[::-1]
    seq = np.zeros(len(start) + int(first.sum()), U64)
    seq[np.arange(len(start)) + np.cumsum(first)] = numbers + 1
    whole, counts = data.tobytes(), np.bincount(numbers, minlength=len(distinct))
    words = pa.array([whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
    listed = pa.StructArray.from_arrays([pa.array(langs, pa.string()).take(pa.array(of[at])), words, pa.array(counts)], ["lang", "word", "f"])
    listed = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), listed)
    return pa.record_batch([pa.array([number]), pa.array([len(start)]), pa.array([pack(seq, 4)], pa.binary()), listed], ["chunk", "n", "seq", "words"])


def chunks(docs: DataFrame) -> DataFrame:
    """All texts as stored chunks (``CHUNK``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if held and size + batch.nbytes > 4 * CHUNK_BYTES:  # a very long text stays by itself
                yield _chunk(number, pa.Table.from_batches(held))
                held, size, number = [], 0, number + 1
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield _chunk(number, pa.Table.from_batches(held))
                held, size, number = [], 0, number + 1
        if sum(b.num_rows for b in held):
            yield _chunk(number, pa.Table.from_batches(held))

    return staged(docs.select("lang", "text").mapInArrow(cut, CHUNK), "chunks")


def vocabulary(parts: DataFrame, least: int) -> DataFrame:
    """The frequent words with ids from 1, as a stored table: id, lang, word, f."""
    words = parts.select(F.explode("words").alias("w")).groupBy("w.lang", "w.word").agg(F.sum("w.f").alias("f")).where(F.col("f") >= least)
    own = staged(words.withColumn("at", F.monotonically_increasing_id()), "vocabulary")
    files = own.agg(F.max(F.shiftright("at", 33))).first()[0] or 0
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    return own.select((place * (files + 1) + F.shiftright("at", 33) + 1).alias("id"), "lang", "word", "f")


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").astype(U64, copy=False)


def named_words(parts: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Each chunk as the ids (of ``size`` bytes) of its words (0: not frequent, or between pieces), stored: chunk, seq."""

    def replaced(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        seq = unpack(left["seq"][0].as_py(), 4).astype(np.int64)
        ids = np.zeros(int(seq.max(initial=0)) + 1, U64)
        ids[right["pos"].to_numpy() + 1] = right["id"].to_numpy().astype(U64)
        return pa.table({"chunk": left["chunk"], "seq": pa.array([pack(ids[seq], size)], pa.binary())})

    asked = parts.select("chunk", F.posexplode("words").alias("pos", "w")).select("chunk", "pos", "w.lang", "w.word")
    answers = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "pos", "id")
    return staged(parts.select("chunk", "seq").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(replaced, "chunk long, seq binary"), "names")


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, the starts of their runs in it, and the runs' hashes, ascending."""
    own = mixed(mixed(left) + right)
    order = np.argsort(own, kind="stable")
    a, b = left[order], right[order]
    other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if len(order) and (other & (own[order][1:] == own[order][:-1])).any():  # two pairs of one hash
        order = np.lexsort((right, left, own))
        a, b = left[order], right[order]
        other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.concatenate([[0], np.flatnonzero(other) + 1]) if len(order) else np.zeros(0, np.int64)
    return order, at, own[order[at]]


def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where two ids stand side by side, and the ids."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    return at, seq[at], seq[at + 1]


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, one up to each of the ends (in items of ``data``)."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def asked(seqs: DataFrame, n_buckets: int, kind: np.dtype, size: int) -> DataFrame:
    """Each chunk's distinct pairs by bucket, in order of their hashes (``ASKED``)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["seq"], strict=True):
                _, left, right = _pairs(unpack(blob.as_py(), size))
                order, at, own = _distinct(left, right)
                if not len(at):
                    continue
                records = np.zeros(len(at), kind)
                records["left"], records["right"], records["f"] = left[order[at]], right[order[at]], np.diff(np.append(at, len(order)))
                bucket = bucket_of(own, n_buckets)
                first = runs(bucket)
                yield pa.record_batch([pa.array(bucket[first], pa.int32()), pa.array(np.full(len(first), chunk)), _blobs(records, np.append(first[1:], len(at)))], ["bucket", "chunk", "pairs"])

    return seqs.mapInArrow(ask, ASKED)


def named(asks: DataFrame, n_buckets: int, kind: np.dtype, least: int, answer: bool) -> DataFrame:
    """Names of the pairs that are frequent over all chunks, and each chunk's answers in the order asked (``NAMED``)."""

    def name(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table["pairs"].to_pylist()
        records = np.frombuffer(b"".join(blobs), kind)
        left, right = records["left"].astype(U64), records["right"].astype(U64)
        order, at, _ = _distinct(left, right)
        total = np.add.reduceat(records["f"][order].astype(np.int64), at)
        often = total >= least
        ids = np.zeros(len(at), U64)
        ids[often] = np.arange(int(often.sum()), dtype=U64) * U64(n_buckets) + U64(key[0].as_py() + 1)
        none = lambda n, t: pa.nulls(n, t)
        first, n = order[at][often], int(often.sum())
        out = [pa.table([none(n, pa.int64()), none(n, pa.int32()), none(n, pa.binary()), *(pa.array(x.astype(np.int64)) for x in (ids[often], left[first], right[first], total[often]))], NAMED_COLUMNS)]
        if answer:
            back = np.zeros(len(order), "<u8")
            back[order] = np.repeat(ids, np.diff(np.append(at, len(order))))
            m = len(blobs)
            out.append(pa.table([table["chunk"], table["bucket"], _blobs(back, np.cumsum([len(b) // kind.itemsize for b in blobs])), *(none(m, pa.int64()) for _ in range(4))], NAMED_COLUMNS))
        return pa.concat_tables(out)

    return asks.groupBy("bucket").applyInArrow(name, NAMED)


NAMED_COLUMNS = [c.split()[0] for c in NAMED.split(", ")]


def paired(seqs: DataFrame, answers: DataFrame, size: int, wider: int) -> DataFrame:
    """Each chunk with the ids (of ``wider`` bytes) of its pairs in the places of their first ids (of ``size``): chunk, seq."""

    def replace(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        seq = unpack(left["seq"][0].as_py(), size)
        places, a, b = _pairs(seq)
        order, at, _ = _distinct(a, b)
        own = _ids(right.sort_by("bucket")["ids"])
        if len(own) != len(at):
            raise RuntimeError("a chunk's answers don't fit what it asked")
        out = np.zeros(len(seq), U64)
        out[places[order]] = np.repeat(own, np.diff(np.append(at, len(order))))
        return pa.table({"chunk": left["chunk"], "seq": pa.array([pack(out, wider)], pa.binary())})

    return seqs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(replace, "chunk long, seq binary")


def _width(level: DataFrame) -> int:
    return SHORT if (level.agg(F.max("id")).first()[0] or 0) < 1 << 32 else LONG


def hierarchy(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """n of each lang (lang, n), and per level of words the named phrases: level 1 as (id, lang, word, f), others as (id, left, right, f)."""
    parts = chunks(docs)
    tokens = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = staged(parts.select(F.explode("words").alias("w")).groupBy("w.lang").agg(F.sum("w.f").alias("n")), "totals")
    words = vocabulary(parts, least)
    size = _width(words)
    seqs, levels, n_buckets = named_words(parts, words, size), [words], tokens // BUCKET_TOKENS + 1
    for k in range(2, longest + 1):
        kind = NARROW if size == SHORT else PAIR
        found = staged(named(asked(seqs, n_buckets, kind, size), n_buckets, kind, least, answer=k < longest), f"pairs{k}")
        levels.append(found.where("chunk IS NULL").select("id", "left", "right", "f"))
        if k < longest:
            wider = _width(levels[-1])
            seqs, size = paired(seqs, found.where("chunk IS NOT NULL").select("chunk", "bucket", "ids"), size, wider), wider
            seqs = staged(seqs, f"names{k}") if k + 1 < longest else seqs
    return totals, levels


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def _lowest_cut(k: int) -> Column:
    """The cut (score, j, l, r) of a phrase of ``k`` words: the lowest-scoring, and of equal ones that of the fewest first words."""

    def cut(j: Column) -> Column:
        left, right = F.get("heads", j - 1), F.get("tails", F.lit(k - 1) - j)
        return F.struct(score(F.col("a"), left, right).alias("score"), j.alias("j"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), cut))


def phrases(levels: list[DataFrame]) -> list[DataFrame]:
    """Per level: id, lang, phrase, last (word), a, and ``heads`` and ``tails``, the counts of its first and its last 1, 2, ... words."""
    f = F.col("f")
    own = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), f.alias("a"), F.array(f).alias("heads"), F.array(f).alias("tails"))
    out = [own]
    for k, pairs in enumerate(levels[1:], 2):
        heads = own.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        tails = own.select(F.col("id").alias("right"), "last", "tails")
        own = pairs.join(heads, "left").join(tails, "right").select(
            "id", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", f.alias("a"),
            F.concat("heads", F.array(f)).alias("heads"), F.concat("tails", F.array(f)).alias("tails"),
        )
        own = staged(own, f"phrases{k}") if k < len(levels) else own
        out.append(own)
    return out


def mine(docs: DataFrame, longest: int = 3, least: int = 10, first: int = 2000, share: int = 50) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each lang: lang, rank, phrase, a, l, r, n, score.

    Candidates stand ``least`` times or more. A candidate's score is that of its
    lowest-scoring cut, and of equal ones of the earliest. Candidates are dropped that a
    longer one holds and that stand elsewhere too seldom: the longer one has
    ``share`` percent of their count or more. (If any longer one has, one that is
    longer by one word has, so those are enough to look at.) Ranks go by
    score, then count, then the phrase's bytes.
    """
    totals, levels = hierarchy(docs, longest, least)
    found = None
    for k, own in enumerate(phrases(levels)):
        if not k:
            continue
        rows = own.withColumn("cut", _lowest_cut(k + 1))
        if k + 1 < len(levels):
            above = levels[k + 1]
            holds = above.select(F.col("left").alias("id"), "f").unionAll(above.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            rows = rows.join(holds, "id", "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
        rows = rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        found = rows if found is None else found.unionAll(rows)
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= first).drop("part")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
