"""N-gram Jaccard join by count-vector R-trees.

A document's set is its distinct word shingles. Shingles are hashed into groups
(more for longer sets) and a set's counts per group are its point; two sets
share at most the sum of the smaller coordinates of their points, and an R-tree
node, which keeps the largest coordinates below it, bounds all of its points so.
Trees of two tiles of documents are walked together, and what the bound leaves
is verified on the sets themselves.

One tree over all points cannot prune (boxes of unrelated points in so many
dimensions cover everything), so points are first dealt to tiles: sets that are
similar share a shingle, or with ``SHARED`` - 1 more at least ``SHARED`` of
them, among the first quarter in any fixed order, here frequent shingles last,
then by hash. Equal sets are one class and stand for their copies. A set's tile
is that of its most frequent such shingle, cut into tiles of bounded size.

1. Each tile is walked with itself. What is linked there is one component.
2. Components that have a shingle in very many sets are dealt to tiles by one
   such shingle, each with one set that has it, and these tiles are walked; and
   again by other shingles while that joins components. So a large group of near
   copies shrinks by a tile's size a round, whatever its size is.
3. Tiles that share a shingle are walked together, but only with sets of
   different components: the pairs that could still join two. A component of more
   than a tile has tiles of its own, which don't meet one another.

A walk takes the documents that share so many shingles with the other tile's
documents of fitting sizes, and emits a row for each component that it joins to
another, so rows are in proportion to the sets.

Defined results: null and empty texts, and texts of white space, have no
shingles and no links; repeated rows and rows of null doc_id count like others;
copies link with each other; an empty table gives an empty result. ``docs`` has
to be a stored Parquet table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import numbered, staged, text_or_empty
from docloom.llm.words import U64, Words, bucket_of, dealt, mixed, pack, runs, shingle_hashes, tallied, unpack

#: Groups of short sets, and of the longest.
GROUPS, MOST_GROUPS = 256, 1 << 20
FANOUT = 8
#: A shingle in so many documents is put last in the order; of these, the most frequent ``MOST_FREQUENT`` are.
FREQUENT_IN = 200
MOST_FREQUENT = 1 << 18
#: Similar sets have so many shingles in common (fewer, if 0.75 of a set is less) among the first quarter and ``SHARED`` more.
SHARED = 3
TILE_DOCS = 256
#: Rows of one group that needs several tiles meet their number in so many places.
SALTS = 16
#: Components are joined by so many sets that stand for them while a round joins one in so many.
SPEAKERS, LEAST_JOINED = 4, 50
TILE_SHINGLES = 1 << 21
CHUNK_SHINGLES = 1_000_000
#: Links: 100 * overlap >= PERCENT * size of the union.
PERCENT = 75


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    words = Words(column)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(shingle_hashes(words.hash[a:b], width))


def groups_of(n: int) -> int:
    """The number of groups for a set of n shingles: a power of four times ``GROUPS``, two shingles a group at most."""
    groups = GROUPS
    while n > 2 * groups and groups < MOST_GROUPS:
        groups *= 4
    return groups


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & U64(groups_of(len(s)) - 1)).astype(np.int64), minlength=groups_of(len(s)))


def packed_point(p: np.ndarray) -> bytes:
    return p.astype(np.uint8 if p.max() < 256 else np.uint32).tobytes()


def unpacked_point(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == groups_of(n) else np.uint32)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(axis=0)


def linkable(overlap: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return (100 + PERCENT) * overlap >= PERCENT * (size_a + size_b)


class RTree:
    """A packed R-tree: level 0 holds the points, each later level boxes over ``FANOUT`` of the level below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, height: int):
        spread = np.argsort(points.var(axis=0))[-2:] if len(points) > FANOUT else [0, 0]
        self.order = np.lexsort((points[:, spread[0]], points[:, spread[1]], np.log2(sizes + 1.0).round(1)))
        top = points.max(initial=0)
        tops = points[self.order].astype(np.uint8 if top < 256 else np.uint32)
        least = sizes[self.order].astype(np.int64)
        self.levels = [(tops, least)]
        for _ in range(height):
            at = np.arange(0, len(tops), FANOUT)
            tops, least = np.maximum.reduceat(tops, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((tops, least))


def tree_height(n: int) -> int:
    return 0 if n <= 2 * FANOUT else 1 + tree_height(-(-n // FANOUT))


def tree_join(points_a: np.ndarray, sizes_a: np.ndarray, points_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of points whose bound allows a link, by walking two trees together: (place in a, place in b, bound)."""
    height = max(tree_height(len(sizes_a)), tree_height(len(sizes_b)))
    a, b = RTree(points_a, sizes_a, height), RTree(points_b, sizes_b, height)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][1])), np.arange(len(b.levels[-1][1])), indexing="ij"))
    for level in range(height, -1, -1):
        (top_a, least_a), (top_b, least_b) = a.levels[level], b.levels[level]
        step = max(64, (1 << 22) // top_a.shape[1])
        bound = np.concatenate([np.minimum(top_a[i[k : k + step]], top_b[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])
        keep = linkable(bound, least_a[i], least_b[j])
        i, j, bound = i[keep], j[keep], bound[keep]
        if level:
            below_a, below_b = len(a.levels[level - 1][1]), len(b.levels[level - 1][1])
            steps = np.arange(FANOUT)
            i = np.repeat(i[:, None] * FANOUT + steps, FANOUT, axis=1).ravel()
            j = np.tile(j[:, None] * FANOUT + steps, (1, FANOUT)).ravel()
            inside = (i < below_a) & (j < below_b)
            i, j = i[inside], j[inside]
    return a.order[i], b.order[j], bound


def _count_blobs(n: int, width: int):
    """Shingles of the lower half of all hashes, counted, by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blobs() -> Iterator[pa.RecordBatch]:
            keys, counts = tallied(np.concatenate(held))
            for b, at in dealt(bucket_of(keys << U64(1), n), n):
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pack(keys[at])]), pa.array([pack(counts[at], 5)])], names=["bucket", "key", "num"])

        for batch in batches:
            words = Words(batch.column(0))
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                h = shingle_hashes(words.hash[a:b], width)
                held.append(h[h < U64(1 << 63)])
                size += len(held[-1])
            if size >= CHUNK_SHINGLES:
                yield from blobs()
                held, size = [], 0
        if size:
            yield from blobs()

    return count


def _frequent_in(least: int):
    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x) for x in table["key"].to_pylist()])
        keys, counts = tallied(keys, np.concatenate([unpack(x, 5) for x in table["num"].to_pylist()]).astype(np.int64))
        at = counts >= least
        return pa.table([keys[at].astype(np.int64), counts[at]], names=["key", "num"])

    return merge


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that are put last; at most ``MOST_FREQUENT``. Which ones they are changes the cost, never the result."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text_or_empty())), F.lit(0))).first()[0]
    counted = texts.mapInArrow(_count_blobs(max(1, -(-size // (32 << 20))), width), "bucket int, key binary, num binary")
    found = counted.groupBy("bucket").applyInArrow(_frequent_in(FREQUENT_IN), "key long, num long")
    return np.sort(np.array([r.key for r in found.orderBy(F.desc("num"), "key").limit(MOST_FREQUENT).collect()], np.int64).astype(U64))


SETS = "rid long, doc_id long, n long, cls long, point binary, keys array<long>"
#: A task remembers so many classes, to give the keys of copies that stand near each other once.
MOST_SEEN = 1 << 18


def set_class(s: np.ndarray) -> int:
    """A hash of a set: equal for equal sets alone, but for chance."""
    return int(mixed(s ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64).astype(np.int64))


def _describe(frequent: np.ndarray, width: int):
    def keys_of(s: np.ndarray) -> np.ndarray:
        if len(frequent):
            last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
            s = np.concatenate([s[~last], s[last]])
        return s[: len(s) - -(-PERCENT * len(s) // 100) + SHARED].astype(np.int64)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), width))
            classes = [set_class(s) for s in sets]
            keys = []
            for c, s in zip(classes, sets, strict=True):
                keys.append(s[:0].astype(np.int64) if c in seen else keys_of(s))
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(c)
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
                    pa.array([packed_point(point(x)) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["rid", "doc_id", "n", "cls", "point", "keys"],
            )

    return describe


def _by_walk(walk: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], columns: tuple[str, ...]):
    """Rows sorted by (ta, tb), one walk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                out = walk({c: table[c].to_pylist() if c in ("point", "shingles") else table[c].to_numpy() for c in columns})
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            ta, tb = batch.column("ta").to_numpy(), batch.column("tb").to_numpy()
            at = np.concatenate([[0], np.flatnonzero((ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1, [len(ta)]]) if len(ta) else [0]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if (ta[a], tb[a]) != last:
                    yield from done()
                    held, last = [], (ta[a], tb[a])
                held.append(batch.slice(a, b - a))
        yield from done()

    return run


def _sides(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if g["ta"][0] == g["tb"][0]:
        every = np.arange(len(g["ta"]))
        return every, every
    return np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)


def _allowed(g: dict[str, np.ndarray], points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components in a walk that the bound leaves. Sets that may be similar have equal numbers of groups or neighbouring ones."""
    a, b = _sides(g)
    groups = np.array([len(p) for p in points])
    found = [(a[:0], b[:0], a[:0])]
    for own in np.unique(groups[a]).tolist():
        for other in (own // 4, own, own * 4):
            x, y, least = a[groups[a] == own], b[groups[b] == other], min(own, other)
            if len(x) and len(y):
                i, j, bound = tree_join(np.stack([folded(points[k], least) for k in x]), g["n"][x], np.stack([folded(points[k], least) for k in y]), g["n"][y])
                found.append((x[i], y[j], bound))
    i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = g["comp"][i] != g["comp"][j]
    if g["ta"][0] == g["tb"][0]:
        keep &= i < j
    return i[keep], j[keep], bound[keep]


def _bounded(g: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Of a walk, the documents that the bound leaves in some pair."""
    i, j, _ = _allowed(g, [unpacked_point(p, n) for p, n in zip(g["point"], g["n"].tolist(), strict=True)])
    left = np.unique(np.concatenate([i, j]))
    kept = ("ta", "tb", "side", "cls", "comp")
    return pa.record_batch([g[c][left] for c in kept], names=kept) if len(left) else None


def _verified(g: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """(a, b) for each component of a walk that links join to others: b is the least of them. A pair is verified unless it is joined already."""
    sets = [np.frombuffer(s, "<u8") for s in g["shingles"]]
    i, j, bound = _allowed(g, [point(x) for x in sets])
    order = np.argsort(-bound / (g["n"][i] + g["n"][j]), kind="stable")
    comps, of = np.unique(g["comp"], return_inverse=True)
    root, of = list(range(len(comps))), of.tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = find(of[a]), find(of[b])
        if ra != rb:
            both = np.sort(np.concatenate([sets[a], sets[b]]), kind="stable")
            if linkable(np.count_nonzero(both[1:] == both[:-1]), len(sets[a]), len(sets[b])):
                root[max(ra, rb)] = min(ra, rb)
    least = np.array([find(x) for x in range(len(root))], np.int64)
    moved = np.flatnonzero(least != np.arange(len(root)))
    return pa.record_batch([comps[moved], comps[least[moved]]], names=["a", "b"])


def _sets_of(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), width))
            if [set_class(s) for s in found] != batch.column(0).to_pylist():
                raise RuntimeError("the documents changed between the passes; join a stored table")
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], names=["cls", "shingles"])

    return sets


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b).

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by doubling, and contracts, which leaves at most half the nodes
    that had links; what a round makes is checkpointed.
    """
    links = links.where("a <> b").select("a", "b").checkpoint()
    roots = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")).checkpoint()
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("up")).where("up < at").checkpoint()
        while True:
            upper = up.select(F.col("at").alias("up"), F.col("up").alias("upper"))
            followed = up.join(upper, "up", "left").select("at", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")).checkpoint()
            up = followed.select("at", "up")
            if followed.where("moved").isEmpty():
                break
        moved = _renamed(_renamed(links, up, "a"), up, "b").where("a <> b")
        links = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
        roots = _renamed(roots, up, "root").checkpoint()
    return roots


def _renamed(df: DataFrame, up: DataFrame, column: str) -> DataFrame:
    new: Column = F.coalesce("up", column)
    return df.join(up.withColumnRenamed("at", column), column, "left").select(*(new.alias(c) if c == column else c for c in df.columns))


def _told(rows: DataFrame, by: str, facts: DataFrame) -> DataFrame:
    """``rows`` (cls and others) left joined with ``facts`` of few values of ``by``, each in ``SALTS`` places as a value may have very many rows."""
    every = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(SALTS)).cast("int")).join(every, [by, "salt"], "left").drop("salt")


def dealt_tiles(rows: DataFrame, by: str, seed: int) -> DataFrame:
    """``rows`` (cls, n and others) with ``cut``, the number of tiles that the rows of equal ``by`` need, null if one, and ``tile``."""
    need = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_DOCS, F.sum("n") / TILE_SHINGLES))
    cut = rows.groupBy(by).agg(need.alias("cut")).where("cut > 1")
    place = F.pmod(F.xxhash64("cls", F.lit(seed + 7)), F.coalesce("cut", F.lit(1)))
    return _told(rows, by, cut).select(*rows.columns, "cut", F.xxhash64(by, place, F.lit(seed)).alias("tile"))


def _enough(n: Column) -> Column:
    """So many keys a set has in common with a similar one."""
    return F.least(F.lit(SHARED), F.ceil(n * PERCENT / 100))


#: Whether a set of n shingles can be similar to one of ``least`` to ``most``.
FITS = f"least * {PERCENT} <= n * 100 AND most * 100 >= n * {PERCENT}"


class _Join:
    """The stored tables of one join: rows of documents, classes of equal sets with keys that others have, and their components."""

    def __init__(self, docs: DataFrame, width: int):
        self.width = width
        self.rows = numbered(docs.select("doc_id", "text")).select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
        frequent = frequent_shingles(docs.select("text"), width)
        self.sets = staged(self.rows.mapInArrow(_describe(frequent, width), SETS), "sets")
        full = self.sets.where("n > 0")
        self.classes = full.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"), F.first("n").alias("n")).withColumn("rid", F.col("first.rid"))
        keyed = full.select(F.explode("keys").alias("key"), "cls")
        shared = staged(keyed.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").select("key", "df"), "shared")
        self.keys = staged(keyed.join(shared, "key").distinct(), "keys", drop=shared)
        led = self.keys.groupBy("cls").agg(F.max(F.struct("df", "key")).getField("key").alias("leader")).join(self.classes.select("cls", "n", "rid"), "cls")
        placed = dealt_tiles(led, "leader", 0).select("rid", "cls", "tile", "n")
        self.members = staged(placed.join(self.sets.select("rid", "point"), "rid"), "members")

    def walked(self, part: DataFrame, name: str) -> DataFrame:
        """(a, b) joined components of the walks of ``part`` (ta, tb, side, cls, comp), bounded first and then verified."""
        walks = part.join(self.members.select("cls", "n", "point"), "cls")
        left = staged(_sorted_walks(walks).mapInArrow(_by_walk(_bounded, ("ta", "tb", "side", "cls", "comp", "n", "point")), "ta long, tb long, side int, cls long, comp long"), f"left_{name}")
        return self.verified(left, name)

    def verified(self, left: DataFrame, name: str) -> DataFrame:
        wanted = left.select("cls").distinct().join(self.members.select("cls", "rid"), "cls")
        texts = self.rows.select("rid", "text").join(wanted, "rid").select("cls", "text")
        found = texts.mapInArrow(_sets_of(self.width), "cls long, shingles binary")
        walks = left.join(found.join(self.members.select("cls", "n"), "cls"), "cls")
        return staged(_sorted_walks(walks).mapInArrow(_by_walk(_verified, ("ta", "tb", "side", "cls", "comp", "n", "shingles")), "a long, b long"), f"links_{name}")

    def within_tiles(self) -> DataFrame:
        """(cls, n, tile, comp): the components that links within a tile make."""
        met = staged(self.keys.select("key", "cls").join(self.members.select("cls", "tile", "n"), "cls"), "met")
        own = met.groupBy("key", "tile").agg(F.count(F.lit(1)).alias("docs"), F.min("n").alias("least"), F.max("n").alias("most")).where("docs > 1")
        counted = met.join(own, ["key", "tile"]).where(FITS).groupBy("tile", "cls").agg(F.count(F.lit(1)).alias("keys"), F.first("n").alias("n"))
        part = counted.where(F.col("keys") >= _enough(F.col("n"))).select(F.col("tile").alias("ta"), F.col("tile").alias("tb"), F.lit(0).alias("side"), "cls", F.col("cls").alias("comp"))
        links = self.walked(part, "within")
        comps = self.members.select("cls", "n", "tile", F.col("cls").alias("comp"))
        return staged(_moved(comps, links), "comps", drop=met)

    def contracted(self, comps: DataFrame) -> DataFrame:
        """Components joined by sets that stand for them, while a round joins one in ``LEAST_JOINED``.

        A component is dealt by the first of its hot keys in an order of the round,
        and up to ``SPEAKERS`` of its sets with that key speak for it: those of which
        hot keys are the largest share, as such sets are like most others.
        """
        hot = self.keys.where(F.col("df") > TILE_DOCS).select("key", "cls")
        if hot.isEmpty():
            return comps
        share = self.members.join(hot.groupBy("cls").agg(F.count(F.lit(1)).alias("hots")), "cls").select("cls", "n", (F.col("hots") / (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + SHARED)).alias("share"))
        hot = staged(hot.join(share, "cls"), "hot")
        for seed in itertools.count(1):
            split = F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(SPEAKERS)).alias("split")
            pick = F.min(F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), "key", (-F.col("share")).alias("order"), F.xxhash64("cls", F.lit(seed + 1)).alias("tie"), "cls", "n"))
            picks = staged(hot.join(comps.select("cls", "comp"), "cls").groupBy("comp", split).agg(pick.alias("p")).select("comp", "p.h", "p.key", "p.cls", "p.n"), "picks")
            led = picks.groupBy("comp").agg(F.min(F.struct("h", "key")).getField("key").alias("key"), F.sum("n").alias("n"))
            several = led.groupBy("key").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1")
            led = led.join(several.select("key"), "key", "left_semi").withColumn("cls", F.col("comp"))
            reps = staged(picks.select("comp", "cls").join(dealt_tiles(led, "key", seed).select("comp", "tile"), "comp"), "reps", drop=picks)
            n = reps.select("comp").distinct().count()
            links = self.verified(reps.select(F.col("tile").alias("ta"), F.col("tile").alias("tb"), F.lit(0).alias("side"), "cls", "comp"), f"round{seed}")
            joined = links.count()
            if joined:
                comps = staged(_moved(comps, links), "comps", drop=comps)
            if joined * LEAST_JOINED <= n:
                return comps

    def between(self, comps: DataFrame) -> DataFrame:
        """(a, b): links of components that links between different tiles make."""
        own = dealt_tiles(comps.withColumnRenamed("tile", "first"), "comp", 0)
        homes = own.select("cls", "comp", F.when(F.col("cut").isNotNull(), F.col("tile")).otherwise(F.col("first")).alias("tile"), "n")
        met = staged(self.keys.select("key", "cls").join(homes, "cls"), "homes", drop=self.keys)
        several = met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        met = staged(met.join(several, "key", "left_semi"), "mixed", drop=met)
        others = met.groupBy("key", F.col("tile").alias("other")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
        foreign = met.select("key", "comp").distinct().join(others, "key").where("lo < comp OR hi > comp").select("key", "comp", "other", "least", "most")
        pairs = met.join(foreign, ["key", "comp"]).where(f"tile <> other AND {FITS}")
        ends = (F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
        counted = pairs.groupBy(*ends, "cls", "comp").agg(F.count(F.lit(1)).alias("keys"), F.first("n").alias("n"))
        return self.walked(counted.where(F.col("keys") >= _enough(F.col("n"))).select("ta", "tb", "side", "cls", "comp"), "between")

    def result(self) -> tuple[DataFrame, DataFrame]:
        """All rows (rid, doc_id, n, cls), and of each class the row that stands for its component: ``first`` (no id, doc_id, rid)."""
        comps = self.contracted(self.within_tiles())
        roots = components(self.between(comps)).withColumnRenamed("node", "comp")
        rooted = _told(comps.select("cls", "comp"), "comp", roots).select("cls", F.coalesce("root", "comp").alias("root"))
        rooted = self.classes.select("cls", "first").join(rooted, "cls", "left").select("cls", F.col("first").alias("own"), F.coalesce("root", "cls").alias("root"))
        least = rooted.groupBy("root").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
        return self.sets, staged(_told(rooted, "root", least).select("cls", F.coalesce("first", "own").alias("first")), "components")


def _moved(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` with each component ``a`` of ``links`` (once each) as its ``b``."""
    return _told(comps, "comp", links.select(F.col("a").alias("comp"), F.col("b").alias("joined"))).select(*(F.coalesce("joined", "comp").alias(c) if c == "comp" else c for c in comps.columns))


def join_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    sets, component = _Join(docs, width).result()
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sets.where("n > 0").join(component, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id")).unionByName(empty)


def first_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that links connect to a row of a smaller doc_id (null ids last, then the first row)."""
    sets, component = _Join(docs, width).result()
    stay = sets.where("n = 0").select("rid").unionByName(component.select(F.col("first.rid").alias("rid"))).distinct()
    return numbered(docs, "__rid").join(stay.withColumnRenamed("rid", "__rid"), "__rid", "left_semi").select(*docs.columns)


def _sorted_walks(walks: DataFrame) -> DataFrame:
    return walks.repartition("ta", "tb").sortWithinPartitions("ta", "tb")
