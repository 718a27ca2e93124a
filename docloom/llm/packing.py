"""Packing: cutting-stock column generation.

Documents become token ids (an end id closes each) and are cut into pieces of a
sequence's capacity and one shorter tail. The tails' lengths are counted; a linear program over patterns
of lengths says how often to use which pattern, a knapsack program prices the
patterns (``cutting``), and the rounded pattern counts are dealt to documents by their rank among those of
equal length. Rank and plan give a document's sequence and offset by arithmetic, so no
task sees more than its own rows. The tails that rounding leaves are laid end to end and cut
at sequence ends. All patterns are exactly full and the last stretch is cut into powers
of two, so no sequence has padding.

Ids are the ``tokenizers`` library's. Byte-level BPE never joins across a change from
non-space to space or from an ASCII letter or digit to ASCII punctuation other than an
apostrophe, so texts are cut there, and the library encodes each distinct part of a chunk once; texts that hold a special
token are encoded whole.

Defined results: a null or empty text is the end id alone; repeated rows are packed
each (ties of rank fall by place in the stored token table, which changes no length);
null ids are kept; a very long text is pieces like any other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import staged
from docloom.llm.cutting import plan
from docloom.llm.words import text_bytes

CAPACITY, END = 1024, 0
#: Parts that the library gets as one text.
JOINED = 512
#: Bytes of texts handled at a time, distinct parts after which a worker forgets those that it kept, and rows of one length in a rank group.
CHUNK_BYTES, MOST_KEPT, GROUP_ROWS = 8 << 20, 500_000, 10_000
TOKENS = "doc_id long, doc_tokens long, blocks array<binary>, tail_tokens int, tail binary"
_SOLID, _ALNUM, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_SOLID[0x21:0x7F] = True
_ALNUM[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_PUNCT[0x21:0x7F] = ~_ALNUM[0x21:0x7F]
_PUNCT[0x27] = False


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text; it travels with the tasks, so executors need no file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


class Slots(dict):
    """Numbers of keys in order of first use; ``fresh`` has the keys that are new since it was emptied."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.fresh.append(key)
        self[key] = at = len(self)
        return at


class Encoder:
    """Ids of whole texts, with the ids of frequent parts kept."""

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """Kept parts have slots; a slot's ids are ``flat[start : start + size]``."""
        self.kept = Slots()
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has. Parts go to the library with a special token between them, which it never joins across; that is cheaper than one by one."""
        encode = lambda texts: [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.special or any(t in p for t in self.special for p in parts):
            found = encode([p.decode() for p in parts])
            size = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size
        between = self.special[0]
        found = encode([(between.join(parts[i : i + JOINED]) + between).decode() for i in range(0, len(parts), JOINED)])
        flat = np.fromiter(chain.from_iterable(found), "<u4")
        ends = np.flatnonzero(flat == self.library.token_to_id(between.decode()))
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _slots(self, parts: list[bytes]) -> np.ndarray:
        """A slot of each of the distinct parts; new ones are encoded."""
        if len(self.kept) > MOST_KEPT:
            self._forget()
        slots = np.fromiter(map(self.kept.__getitem__, parts), np.int64, len(parts))
        flat, size = self._encoded(self.kept.fresh)
        self.kept.fresh = []
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        return slots

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes where a part begins: those of rows, and within rows where no token can reach across."""
        cut = np.zeros(len(data) + 1, bool)
        before, here = data[:-1], data[1:]
        solid = _SOLID[before]
        solid[1:] |= (before[1:] >= 0x80) & (before[1:] < 0xC0) & (before[:-1] >= 0xC3) & (before[:-1] < 0xE0)  # two bytes of a letter, no space among them
        cut[1:-1] = (solid & (here == 0x20)) | (_ALNUM[before] & _PUNCT[here])
        whole = data.tobytes()
        for token in self.special:
            at = whole.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                cut[offsets[row] + 1 : offsets[row + 1]] = False
                at = whole.find(token, int(offsets[row + 1]))
        cut[offsets] = True
        return np.flatnonzero(cut)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's offsets among them."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        cuts = self._cuts(data, offsets)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
        which = self._slots(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        n = self.size[which]
        ends = np.cumsum(n)
        out = self.flat[np.arange(ends[-1]) + np.repeat(self.start[which] - (ends - n), n)]
        return out, np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]


@cache
def encoder(json: str) -> Encoder:
    return Encoder(json)


def tokens(docs: DataFrame, json: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids as full blocks and a tail (``TOKENS``), stored, with ``at``, a number of the row."""

    def cut(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, offsets = encoder(json).ids(table["text"].chunk(0))
        data = ids.tobytes()
        close, size = np.array([end], "<u4").tobytes(), 4 * capacity
        blocks, tails = [], []
        for a, b in zip((4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True):
            full = (b - a + 4) // size
            own = data[a:b] + close
            blocks.append([own[i : i + size] for i in range(0, full * size, size)])
            tails.append(own[full * size :])
        count = np.diff(offsets) + 1
        return pa.record_batch([table["doc_id"].chunk(0), pa.array(count, pa.int64()), pa.array(blocks, pa.list_(pa.binary())), pa.array(count % capacity, pa.int32()), pa.array(tails, pa.binary())], [c.split()[0] for c in TOKENS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if held and size + batch.nbytes > 4 * CHUNK_BYTES:  # a very long text stays by itself
                yield cut(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield cut(pa.Table.from_batches(held))
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield cut(pa.Table.from_batches(held))

    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS).withColumn("at", F.monotonically_increasing_id()), "tokens")


def ranked(tails: DataFrame, rows: int) -> DataFrame:
    """``tails`` with ``rank``, from 0, among the rows of equal ``tail_tokens``.

    A length's rows are dealt to groups of about ``GROUP_ROWS`` rows at most, and counts of the groups
    before are added, so a length with very many rows is no single task's.
    """
    group = F.pmod(F.xxhash64("at"), F.lit(rows // GROUP_ROWS + 1))
    dealt = tails.withColumn("group", group)
    before = Window.partitionBy("tail_tokens").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = tails.select("tail_tokens", group.alias("group")).groupBy("tail_tokens", "group").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("tail_tokens", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("tail_tokens", "group").orderBy("at")))
    return own.join(bases, ["tail_tokens", "group"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("base", "own", "group")


def ranges(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int, int]:
    """Where the ranks of each length go, the number of sequences of patterns, and the tokens left over.

    A range is (length, first rank, end of ranks, places in a sequence or 0 for what
    is left over, first sequence, offset). Patterns hold fewer than
    sqrt(2 * capacity) lengths each and are no more than lengths, so there are less than capacity ** 1.5 * 1.5 ranges.
    """
    used, out, sequences = dict.fromkeys(counts, 0), [], 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for size, places in sorted(pattern.items(), reverse=True):
            out.append((size, used[size], used[size] + places * times, places, sequences, offset))
            used[size] += places * times
            offset += places * size
        sequences += times
    left = 0
    for size in sorted(counts):
        if counts[size] > used[size]:
            out.append((size, used[size], counts[size], 0, 0, left))
            left += size * (counts[size] - used[size])
    return out, sequences, left


RANGE = "tail_tokens int, first long, stop long, places long, sequence long, offset long"


def _laid(base: int, left: int, capacity: int) -> Column:
    """Pieces (start, length, sequence_id, offset) of a tail at token ``g`` of those left over, cut where sequences end."""
    full = left - left % capacity
    ends = [full]  # and the last stretch in powers of two
    while ends[-1] < left:
        ends.append(ends[-1] + (1 << (left - ends[-1]).bit_length() - 1))
    g, size = F.col("g"), F.col("tail_tokens")
    last = F.array(*(F.lit(e).cast("long") for e in ends))
    following = (F.floor(g / capacity) + 1) * capacity
    cuts = F.array_distinct(F.concat(F.array(g), F.filter(F.concat(F.array(following), last), lambda c: (c > g) & (c < g + size) & ((c <= full) | F.array_contains(last, c))), F.array(g + size)))
    points = F.array_sort(cuts)

    def piece(i: Column) -> Column:
        at, stop = F.element_at(points, i), F.element_at(points, i + 1)
        whole = at < full
        passed = F.filter(last, lambda e: e <= at)
        sequence = F.when(whole, F.floor(at / capacity)).otherwise(full // capacity + F.size(passed) - 1)
        offset = F.when(whole, at % capacity).otherwise(at - F.array_max(passed))
        return F.struct((at - g).cast("long").alias("start"), (stop - at).cast("long").alias("length"), (sequence + base).cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    return F.transform(F.sequence(F.lit(1), F.size(points) - 1), piece)


def pack(docs: DataFrame, json: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Sequences are ``capacity`` ids long, or a smaller power of two, and have no padding; a document's
    tail shorter than ``capacity`` lies in one piece wherever the plan has a place for it.
    """
    spark = docs.sparkSession
    own = tokens(docs, json or tokenizer_json(), capacity, end)
    counts = {r[0]: r[1] for r in own.where("tail_tokens > 0").groupBy("tail_tokens").count().collect()}
    where, sequences, left = ranges(counts, capacity)
    plans = spark.createDataFrame(where, RANGE).groupBy("tail_tokens").agg(F.collect_list(F.struct("first", "stop", "places", "sequence", "offset")).alias("ranges"))
    placed = ranked(own.where("tail_tokens > 0").select("doc_id", "doc_tokens", "tail_tokens", "tail", "at"), sum(counts.values())).join(F.broadcast(plans), "tail_tokens")
    placed = placed.withColumn("r", F.get(F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["stop"])), 0)).drop("ranges")
    q, places, size = F.col("rank") - F.col("r.first"), F.greatest(F.col("r.places"), F.lit(1)), F.col("tail_tokens").cast("long")
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("length"), (F.col("r.sequence") + F.floor(q / places)).cast("long").alias("sequence_id"), (F.col("r.offset") + (q % places) * size).cast("long").alias("offset")))
    pieces = F.when(F.col("r.places") > 0, one).otherwise(_laid(sequences, left, capacity))
    laid = placed.withColumn("g", F.col("r.offset") + q * size).withColumn("p", F.explode(pieces))
    before = F.col("doc_tokens") - size
    tails = laid.select(
        "doc_id", (before + F.col("p.start")).alias("start"), F.col("p.length").alias("length"),
        F.expr("substring(tail, CAST(4 * p.start AS INT) + 1, CAST(4 * p.length AS INT))").alias("ids"), "doc_tokens", "p.sequence_id", "p.offset",
    )
    first = sequences + -(-left // capacity) + capacity.bit_length()
    blocks = own.where(F.size("blocks") > 0).select("doc_id", "doc_tokens", F.posexplode("blocks").alias("k", "ids"))
    full = blocks.select(
        "doc_id", (F.col("k").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids", "doc_tokens",
        (F.monotonically_increasing_id() + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return full.unionAll(tails)
