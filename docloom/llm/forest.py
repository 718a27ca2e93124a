"""Approximate nearest neighbours: a hash-prefix forest.

A tree is an array of long hash strings (signs of random projections), sorted.
Points that share a prefix with a query are one stretch of it, so two binary
searches per tree find all that share any prefix length, and shorter prefixes
give longer stretches. All trees ascend together: one prefix length holds for a
query in every tree, and what the stretches hold is compared exactly, by cosine in
double precision.

A query first takes the longest prefix that gives it ``first`` hits or more over
all trees. How near the k-th point found there is tells how far to ascend: a point
as near shares a bit with the query with probability p (one less its angle over
pi), and is missed by every tree at length x with probability (1 - p^x)^trees. The
longest x at which that is ``miss`` or less is the query's last length; if it is
no shorter than the first one, the query is done. So where neighbours are much
nearer than the rest a small share of the points is compared, and where they
hardly are, most points have to be.

The index is stored once, in blocks of bounded size along the first tree's order
(cells that hold more than a block are split by hash), and each block sorts its
strings once a pass. Queries are sent to the blocks that hold one of their
prefixes, found by joining prefixes, and meet them in a stream: a task holds one
block and a batch of queries. Beyond ``TABLE`` bits, which hit counts are tabled
for, a block itself takes the longest prefix that gives ``k`` hits a tree there.
Equal vectors are one point of the index with their smallest ids, more than which
no query can return, so copies neither fill a block nor use up the hits.

Defined results: vectors that are null, empty, zero, or hold a null or a non-
finite component, and rows of null vec_id, take no part; vectors of different
lengths don't meet; of a vec_id with several vectors each is a point, one of them
(the smallest as an array) is asked for, and rows that share the query's vec_id
count as its own, so such an id is returned once at most, with its nearest (and
may take the place of farther ones); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import staged

BITS = 62
#: Hits are counted for all prefixes of up to so many bits.
TABLE = 12
#: Prefix lengths that queries are sent to blocks by: the longest that is no longer than the query's own.
ROUTES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48)
INDEX_BLOCK = 8192
QUERY_BATCH = 256
INDEX = "vector array<double>, ids array<long>, length int, strings array<long>"
PASS = "block long, is_query int, vector array<double>, ids array<long>, strings array<long>, level int"
FOUND = "query_id long, vec_id long, score double, level int, block long, compared long"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hash_strings(units: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(n, trees): hash strings as integers of ``BITS`` bits, first bit highest."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    planes = (np.random.default_rng([seed, t]).standard_normal((units.shape[1], BITS)) for t in range(trees))
    return np.stack([(units @ p > 0) @ weights for p in planes], axis=1)


def least_cosines(trees: int, miss: float) -> list[tuple[int, float]]:
    """(prefix length, the least cosine of which all trees miss a point with probability ``miss`` at most), lengths rising."""
    shared = 1 - miss ** (1 / trees)
    return [(x, math.cos(math.pi * (1 - shared ** (1 / x)))) for x in range(1, BITS + 1)]


def _stretch(array: np.ndarray, hashes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share the first ``level`` bits begin and end in a sorted array."""
    low = (hashes >> (BITS - level)) << (BITS - level)
    return np.searchsorted(array, low), np.searchsorted(array, low + ((np.int64(1) << (BITS - level)) - 1), side="right")


def _described(trees: int, seed: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for n in np.unique(lengths).tolist():  # one matrix for vectors of one length
                part = batch.take(pa.array(np.flatnonzero(lengths == n)))
                strings = hash_strings(_unit(_matrix(part.column(0))), trees, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, strings.size + 1, trees), pa.int32()), pa.array(strings.ravel()))
                yield pa.record_batch([*part.columns, lists], names=["vector", "ids", "length", "strings"])

    return describe


class Block:
    """A block of the index: vectors, ids, and the sorted strings of each tree."""

    def __init__(self, table: pa.Table):
        self.whole, self.ids = _matrix(table["vector"]), table["ids"].combine_chunks()
        self.unit = _unit(self.whole)
        strings = _matrix(table["strings"], np.int64).T
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.arrays = np.take_along_axis(strings, self.order, axis=1)

    def deepened(self, strings: np.ndarray, level: np.ndarray, least: int) -> np.ndarray:
        """Longer prefixes than ``TABLE`` for queries that have come to it: the longest that gives ``least`` hits here."""
        level = level.copy()
        left = np.flatnonzero(level == TABLE)
        for at in range(BITS, TABLE, -1):
            if not len(left):
                break
            hits = sum(np.subtract(*_stretch(a, strings[left, t], np.int64(at))[::-1]) for t, a in enumerate(self.arrays))
            level[left[hits >= least]] = at
            left = left[hits < least]
        return level

    def met(self, strings: np.ndarray, level: np.ndarray) -> np.ndarray:
        """(queries, points): whether they share a prefix of the query's length in some tree."""
        out = np.zeros((len(strings), len(self.whole)), bool)
        for t, array in enumerate(self.arrays):
            begin, end = _stretch(array, strings[:, t], level)
            for i in np.flatnonzero(end > begin).tolist():
                out[i, self.order[t, begin[i] : end[i]]] = True
        return out

    def nearest(self, vector: np.ndarray, unit: np.ndarray, some: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
        """The k nearest ids among the points ``some``, as (-cosine, id)."""
        near = self.unit[some] @ unit
        spare = k + 1
        if len(some) > spare:
            some = some[near >= np.partition(near, -spare)[-spare] - 1e-9]
        a, b = vector / np.abs(vector).max(), self.whole[some] / np.abs(self.whole[some]).max(axis=1, keepdims=True)
        score = (b * a).sum(axis=1) / np.sqrt((b * b).sum(axis=1) * (a * a).sum())
        return sorted((-s, v) for s, at in zip(score.tolist(), some.tolist(), strict=True) for v in self.ids[at].as_py() if v != own)[:k]


def _searched(trees: int, k: int, deepen: bool):
    """Rows sorted by (block, is_query): each block's points, then the queries sent to it, a batch at a time."""

    def search(at: int, block: Block, part: pa.RecordBatch) -> pa.RecordBatch:
        names, level = [x[0] for x in part.column("ids").to_pylist()], part.column("level").to_numpy().astype(np.int64)
        strings, whole = _matrix(part.column("strings"), np.int64), _matrix(part.column("vector"))
        if deepen:
            level = block.deepened(strings, level, k * trees)
        met, unit, out = block.met(strings, level), _unit(whole), []
        for i, own in enumerate(names):
            some = np.flatnonzero(met[i])
            out += [(own, v, -s, int(level[i]), at, len(some)) for s, v in block.nearest(whole[i], unit[i], some, own, k)] if len(some) else []
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["query_id", "vec_id", "score", "level", "block", "compared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: list[pa.RecordBatch] = []
        at, block = None, None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("is_query").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here, is_query = divmod(int(keys[a]), 2)
                if here != at:
                    at, points, block = here, [], None
                if not is_query:
                    points.append(batch.slice(a, b - a))
                elif points:
                    block = block or Block(pa.Table.from_batches(points))
                    for begin in range(a, b, QUERY_BATCH):
                        yield search(at, block, batch.slice(begin, min(QUERY_BATCH, b - begin)))

    return run


def _prefix(string: Column, level: Column) -> Column:
    """The first ``level`` bits of a string."""
    return F.expr(f"shiftrightunsigned({string}, CAST({BITS} - {level} AS INT))")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, an id once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Forest:
    """The stored index of a table of vectors."""

    def __init__(self, rows: DataFrame, k: int, trees: int, seed: int):
        self.k, self.trees, self.seed = k, trees, seed
        own = Window.partitionBy("vector").orderBy("vec_id")
        kept = rows.select("vec_id", "vector").distinct().withColumn("at", F.row_number().over(own)).where(F.col("at") <= k + 1)
        points = self.described(kept.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
        strings = staged(points, "strings")
        cell = F.expr(f"shiftrightunsigned(strings[0], {BITS - TABLE})")
        cells = strings.groupBy("length", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")
        places = cells.select("length", "cell", (before / INDEX_BLOCK).cast("long").alias("first"), F.ceil(F.col("n") / INDEX_BLOCK).alias("parts"))
        placed = strings.withColumn("cell", cell).join(places, ["length", "cell"])
        # an even part of a full cell, else the cells that begin in the same stretch
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("ids"), "parts") + F.col("cell") * (1 << 20) + (1 << 39)).otherwise(F.col("first"))
        self.index = staged(placed.select("vector", "ids", "length", "strings", (F.shiftleft(F.col("length").cast("long"), 40) + part).alias("block")), "index", drop=strings)

    def described(self, points: DataFrame) -> DataFrame:
        """(vector, ids) with lengths and strings."""
        return points.select(F.col("vector").cast("array<double>").alias("vector"), "ids", F.size("vector").alias("length")).mapInArrow(_described(self.trees, self.seed), INDEX)

    def first_levels(self, queries: DataFrame, first: int) -> DataFrame:
        """``queries`` with ``level``: the longest prefix, up to ``TABLE``, with ``first`` hits or more; 0 if there are fewer points."""
        strings = F.posexplode("strings").alias("tree", "string")
        base = self.index.select("length", strings).groupBy("length", "tree", F.expr(f"shiftrightunsigned(string, {BITS - TABLE})").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        levels = F.explode(F.sequence(F.lit(0), F.lit(TABLE))).alias("level")
        tabled = base.select("*", levels).groupBy("length", "tree", "level", F.expr(f"shiftrightunsigned(prefix, {TABLE} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
        asked = queries.select("query_id", "length", strings).select("*", levels).withColumn("prefix", _prefix("string", "level"))
        hits = asked.join(tabled, ["length", "tree", "level", "prefix"]).groupBy("query_id", "level").agg(F.sum("n").alias("hits")).where(F.col("hits") >= first)
        return queries.join(hits.groupBy("query_id").agg(F.max("level").alias("level")), "query_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))

    def search(self, queries: DataFrame, name: str, deepen: bool) -> DataFrame:
        """Each block's nearest points to ``queries`` (query_id, vector, length, strings, level) that share their prefixes."""
        route = F.lit(0)
        for r in ROUTES:
            route = F.when(F.col("level") >= r, F.lit(r)).otherwise(route)
        asked = queries.withColumn("route", route)
        routes = [r[0] for r in asked.select("route").distinct().collect()]
        strings = F.posexplode("strings").alias("tree", "string")
        there = self.index.select("length", "block", strings).select("*", F.explode(F.array(*map(F.lit, routes or [0]))).alias("route"))
        there = there.select("length", "block", "route", F.when(F.col("route") > 0, F.col("tree")).otherwise(0).alias("tree"), _prefix("string", "route").alias("prefix")).distinct()
        want = asked.select("query_id", "length", "route", strings).select("query_id", "length", "route", F.when(F.col("route") > 0, F.col("tree")).otherwise(0).alias("tree"), _prefix("string", "route").alias("prefix")).distinct()
        sent = want.join(there, ["length", "route", "tree", "prefix"]).select("query_id", "block").distinct()
        asks = sent.join(queries, "query_id").select("block", F.lit(1).alias("is_query"), "vector", F.array("query_id").alias("ids"), "strings", F.col("level").cast("int").alias("level"))
        points = self.index.select("block", F.lit(0).alias("is_query"), "vector", "ids", "strings", F.lit(0).alias("level"))
        met = points.unionByName(asks).repartition("block").sortWithinPartitions("block", "is_query")
        return staged(met.mapInArrow(_searched(self.trees, self.k, deepen), FOUND), name)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, trees: int = 32, first: int = 2048, miss: float = 0.05, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest found; ``embeddings`` has (vec_id, embedding)."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    forest = Forest(rows, k, trees, seed)
    named = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vector", F.array("vec_id").alias("ids"))
    queries = forest.described(named).withColumn("query_id", F.col("ids")[0])
    queries = staged(forest.first_levels(staged(queries, "asked"), first), "queries")
    found = forest.search(queries, "found", deepen=True)
    kth = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    last = F.lit(0)
    for x, least in least_cosines(trees, miss):
        last = F.when(F.col("kth") >= least, F.lit(x)).otherwise(last)
    used = queries.select("query_id", F.col("level").alias("asked_at")).join(found.groupBy("query_id").agg(F.max("level").alias("level")), "query_id", "left").join(kth, "query_id", "left")
    judged = staged(used.select("query_id", last.alias("last"), (last >= F.greatest("asked_at", F.coalesce("level", F.lit(0)))).alias("done")), "judged")
    again = queries.drop("level").join(judged.where("NOT done").select("query_id", F.col("last").alias("level")), "query_id")
    more = forest.search(again, "more", deepen=False)
    done = found.join(judged.where("done").select("query_id"), "query_id")
    return _ranked(done.unionByName(more), k)
