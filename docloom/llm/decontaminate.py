"""Benchmark decontamination: SimHash of item-sized windows.

Each benchmark item has a SimHash over its five-word shingles, weighted by how
often they occur in it. A document's windows of an item's length are
fingerprinted alike. A multi-index over the items' fingerprints of one length
(the 128 bits in blocks, of which one has at most radius / blocks wrong bits if
the whole has at most radius; a block's values with so many wrong bits are listed)
finds every item within the radius, and the exact weighted Jaccard similarity of
the shingles verifies what it finds. Two in five unrelated fingerprints meet in
some block and are compared whole.

Windows without a shingle of any item have similarity 0 and are not
fingerprinted. Of one document and item the best window is returned (the first
of equal ones). The items are taken in blocks of bounded size, each of which one
pass over the documents serves; what a pass finds is stored before the next
block is read, so the driver holds one block at a time.

Defined results: null and empty texts, and items without words, match nothing;
an item of fewer than five words is one shingle and matches documents of just
these words; in a document shorter than an item the window is the whole
document; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import staged, text_or_empty
from docloom.llm.words import U64, Words, mixed, shingle_hashes

BITS = 128
#: Similar texts (0.75 or more) have 22 of 128 bits wrong on average, with a deviation of 4.3.
RADIUS = 35
BLOCKS = 12
ITEM_BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
#: Windows of a document that are fingerprinted at a time.
STRETCH = 10_000
LEAKS = "doc_id long, item_id long, similarity double, start_word long, end_word long"


def signs(shingles: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each shingle."""
    bits = [(x[:, None] >> np.arange(64, dtype=U64)) & U64(1) for x in (shingles, mixed(shingles ^ U64(0xD6E8FEB86659FD93)))]
    return np.concatenate(bits, axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(n, 2): two halves of each fingerprint."""
    return (sums > 0).reshape(len(sums), 2, 64).astype(U64) @ (U64(1) << np.arange(64, dtype=U64))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _wrong(bits: int, most: int) -> np.ndarray:
    """All values of so many bits of which at most ``most`` are set."""
    return np.array([sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(bits), k)], np.int64)


class MultiIndex:
    """All stored fingerprints within ``RADIUS`` of asked ones."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        cuts = np.linspace(0, 64, BLOCKS // 2 + 1).astype(int).tolist()
        self.blocks = [(half, U64(a), U64((1 << (b - a)) - 1)) for half in range(2) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.tables = []
        for block in self.blocks:
            near = (self._values(prints, block)[:, None] ^ _wrong(int(block[2]).bit_length(), RADIUS // BLOCKS)).astype(np.int32)
            order = np.argsort(near, axis=None, kind="stable")
            self.tables.append((near.ravel()[order], (order // near.shape[1]).astype(np.int32)))

    @staticmethod
    def _values(prints: np.ndarray, block: tuple[int, np.uint64, np.uint64]) -> np.ndarray:
        half, shift, mask = block
        return ((prints[:, half] >> shift) & mask).astype(np.int64)

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the asked, place of the stored) of all pairs that meet in some block."""
        pairs = []
        for block, (near, stored) in zip(self.blocks, self.tables, strict=True):
            value = self._values(asked, block).astype(np.int32)
            begin = np.searchsorted(near, value)
            many = np.searchsorted(near, value, side="right") - begin
            at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs.append(np.repeat(np.arange(len(asked)), many) * len(self.prints) + stored[at])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the asked, place of the stored) of all pairs within the radius."""
        i, j = self.candidates(asked)
        keep = distance(asked[i], self.prints[j]) <= RADIUS
        return i[keep], j[keep]


@dataclass
class Items:
    """A block of items: shingle counts, and a multi-index for each number of shingles."""

    ids: list[int]
    counts: list[Counter]
    sizes: list[int]
    words: list[int]
    shingles: np.ndarray
    holders: dict[int, set[int]]
    indexes: dict[int, tuple[np.ndarray, MultiIndex]]
    seen: np.ndarray = field(repr=False)


def index_items(rows: list[tuple[int, str | None]], width: int) -> Items:
    ids, counts, sizes, words, prints = [], [], [], [], []
    found = Words(pa.array([t for _, t in rows], pa.string()))
    holders: dict[int, set[int]] = defaultdict(set)
    for k, (item, _) in enumerate(rows):
        own = found.hash[found.first[k] : found.first[k + 1]]
        shingles = shingle_hashes(own, width)
        if len(shingles):
            ids.append(item)
            counts.append(Counter(shingles.tolist()))
            sizes.append(len(shingles))
            words.append(len(own))
            prints.append(fingerprints(signs(shingles).sum(axis=0, keepdims=True))[0])
            for s in counts[-1]:
                holders[s].add(len(ids) - 1)
    by_size = defaultdict(list)
    for k, n in enumerate(words):
        by_size[n].append(k)
    indexes = {n: (np.array(at), MultiIndex(np.array([prints[k] for k in at], U64))) for n, at in by_size.items()}
    every = np.sort(np.array(list(holders), U64))
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(every & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return Items(ids, counts, sizes, words, every, dict(holders), indexes, seen)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (a.total() + b.total() - shared)


def leaks_in(words: np.ndarray, shingles: np.ndarray, hits: np.ndarray, items: Items, width: int, least: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, first word, word after the last) of one document whose shingles at ``hits`` some items hold."""
    starts_of: dict[int, list[np.ndarray]] = defaultdict(list)
    for p in hits.tolist():
        for k in items.holders[int(shingles[p])]:
            n = items.words[k]
            if n >= width and len(words) >= n:
                m = n - width + 1
                starts_of[n].append(np.arange(max(0, p - m + 1), min(p, len(shingles) - m) + 1))
            elif n >= width or n == len(words):
                starts_of[n].append(np.zeros(1, np.int64))
    best: dict[int, tuple[float, int, int]] = {}
    for n, parts in sorted(starts_of.items()):
        starts = np.unique(np.concatenate(parts))
        m = min(n - width + 1, len(shingles)) if n >= width else 1
        at, index = items.indexes[n]
        cuts = np.flatnonzero((np.diff(starts) > m) | (np.arange(1, len(starts)) % STRETCH == 0)) + 1
        for some in np.split(starts, cuts):
            low, high = int(some[0]), int(some[-1]) + m
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(shingles[low:high]), axis=0, dtype=np.int32)])
            i, j = index.within(fingerprints(sums[some - low + m] - sums[some - low]))
            for start, k in zip(some[i].tolist(), at[j].tolist(), strict=True):
                score = weighted_jaccard(Counter(shingles[start : start + m].tolist()), items.counts[k])
                if score >= least and score > best.get(k, (0.0,))[0]:
                    best[k] = (score, start, min(start + n, len(words)))
    for k, (score, start, end) in sorted(best.items()):
        yield items.ids[k], score, start, end


def _scan(items: Items, width: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            every = words.hash
            shingles = np.full(len(every), U64(width))
            for k in range(width):
                shingles[: max(0, len(every) - k)] = mixed(shingles[: max(0, len(every) - k)] * U64(0x9E3779B97F4A7C15) + every[k:])
            maybe = np.flatnonzero(items.seen[(shingles & U64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            short = words.counts() < width
            rows = set((np.searchsorted(words.first, maybe, side="right") - 1).tolist()) | set(np.flatnonzero(short & (words.counts() > 0)).tolist())
            out = []
            for r in sorted(rows):
                own = every[words.first[r] : words.first[r + 1]]
                mine = shingle_hashes(own, width)
                place = np.minimum(np.searchsorted(items.shingles, mine), len(items.shingles) - 1)
                hits = np.flatnonzero(items.shingles[place] == mine)
                if len(hits):
                    doc = batch.column(0)[r].as_py()
                    out += [(doc, *found) for found in leaks_in(own, mine, hits, items, width, least)]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "end_word"])

    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.75) -> DataFrame:
    """doc_id, item_id, similarity, start_word and end_word (exclusive) of documents that hold a benchmark item."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_or_empty()) + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text")
        items = index_items([(r.item_id, r.text) for r in own.collect()], width)
        if items.ids:
            found = rows.mapInArrow(_scan(items, width, least), LEAKS)
            found = staged(found, f"leaks{k}") if blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)
