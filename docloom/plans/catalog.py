"""The catalog: a table of documents and a log of their statuses, for any number of writers.

Both are parquet, in shards by the first two digits of the hash, with
which an id begins as well, so what looks for few documents reads few shards.
A document's status is the latest of its row and the log.

A commit is optimistic. A writer notes the shards' versions, looks what is there, and stages its
rows. Then it claims the next version of each shard; of several writers one gets it, and its rows' folder is
renamed into place at once. The others have lost that shard alone: they look again what
is there now and try the next version. So no hash gets in twice. A claim names what was staged, so when a writer dies between
claim and renaming, whoever comes next finishes its commit.

``compact`` folds a shard's commits and statuses into one new generation, by the same claims. Readers see one generation
or the other, whole; the one before stays until the next compaction, for those that still read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.metadata import variant
from docloom.functions.text import normalised_uuid
from docloom.operators.dedup import latest_status, repeated_hashes
from docloom.plans.claims import Claims, Head
from docloom.schemas import CATALOG, HOT_KEYS, MOST_CHARACTERS, STATUS_LOG, STATUSES, STORED, TYPES

SHARD, DIGITS = "shard", 2
#: Commits of a shard after which it is compacted, and shards that are worked on at a time.
MOST_COMMITS, AT_A_TIME = 32, 16
#: Rows of a page's range beyond which it is divided further.
MOST_TOGETHER = 10_000
#: Bytes of a row group: rows are sorted by hash, so a lookup reads the group whose range holds it.
GROUP_BYTES = 8 << 20
#: Rows of a file of a compacted shard, about: larger shards are divided by the hash's next digits, which the files' folders bear.
FILE_ROWS, PART = 1_000_000, "part"
DOCUMENTS, STATUS = "documents", "status"


def shard_of(hash_or_id: Column) -> Column:
    """The partition of a hash, or of an id that derives from it."""
    return F.substring(hash_or_id, 1, DIGITS)


def page_of(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in order of (upload_date, id), with the numbers of its rows and of all as ``total`` and ``total_available``.

    Rows are counted by ranges, first of days and then of ever less where a range that the page lies in
    has too many rows, so only the page's ranges are sorted, at any offset.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    inside, before, available = rows, 0, None
    for part in (F.date_trunc("day", "upload_date"), F.date_trunc("hour", "upload_date"), F.date_trunc("second", "upload_date"), F.col("upload_date"), F.substring("id", 1, 2), F.substring("id", 1, 4)):
        counts = inside.groupBy(part.alias("part")).count().orderBy(F.asc_nulls_first("part")).collect()
        here = sum(r["count"] for r in counts)
        available = here if available is None else available
        if here <= MOST_TOGETHER + limit:
            break
        at, ends = before, []
        for r in counts:
            if at < offset + limit and at + r["count"] > offset:
                before = before if ends else at
                ends.append(r.part)
            at += r["count"]
        if not ends:
            inside = inside.limit(0)
            break
        inside = inside.where((part >= F.lit(ends[0])) & (part <= F.lit(ends[-1])) if ends[0] is not None else part.isNull() | (part <= F.lit(ends[-1])))
        if len(ends) > 1:  # a page over several ranges is not divided further
            break
    page = inside.orderBy(F.asc_nulls_first("upload_date"), F.asc_nulls_first("id")).offset(offset - before).limit(limit)
    total = max(0, min(limit, available - offset))
    return page.withColumns({"total": F.lit(total).cast("long"), "total_available": F.lit(available).cast("long")})


def page_after(rows: DataFrame, limit: int = 100, upload_date=None, id_: str | None = None) -> DataFrame:
    """The next page in order of (upload_date, id) after a row, or the first one: its place is a key, so what is before is never sorted or counted."""
    if upload_date is not None:
        rows = rows.where((F.col("upload_date") > F.lit(upload_date)) | ((F.col("upload_date") == F.lit(upload_date)) & (F.col("id") > F.lit(id_))))
    return rows.orderBy("upload_date", "id").limit(limit)


def by_hash(rows: DataFrame, hash_: str) -> DataFrame:
    return rows.where(F.col("hash") == hash_).limit(1)


def by_id(rows: DataFrame, id_: str) -> DataFrame:
    """The row of an id in any usual spelling; none for what is no id."""
    return rows.where(F.col("id") == normalised_uuid(F.lit(id_))).limit(1)


def _as_stored(rows: DataFrame) -> DataFrame:
    own = rows.withColumn("metadata", variant(F.col("metadata")))
    return own.select(*CATALOG.names, *(F.try_variant_get("metadata", f"$.{k}", "string").alias(k) for k in HOT_KEYS))


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.to_json("metadata").alias(c) if c == "metadata" else c for c in CATALOG.names))


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    path: str

    @property
    def claims(self) -> Claims:
        return Claims(self.spark, f"{self.path}/claims")

    def create(self) -> None:
        """Make the folders where there are none."""
        for name in ("claims", "data", "staging"):
            self.claims.folder.make(f"{self.path}/{name}")

    def drop(self) -> None:
        for name in ("claims", "data", "staging"):
            self.claims.folder.delete(f"{self.path}/{name}")

    def heads(self, shards: Iterable[str] | None = None) -> dict[str, Head]:
        """The present versions of all shards, or of some, their commits finished."""
        claims = self.claims
        names = claims.shards() if shards is None else list(shards)
        with ThreadPoolExecutor(AT_A_TIME) as pool:
            found = dict(zip(names, pool.map(claims.head, names), strict=True))
            list(pool.map(lambda s: self._finish(claims, s, found[s]), names))
        return found

    def _finish(self, claims: Claims, shard: str, head: Head) -> None:
        """Put a claimed commit's rows in their place, if they aren't there yet."""
        if head.staged:
            claims.folder.move(f"{self.path}/staging/{head.staged}/{SHARD}={shard}", f"{self._generation(shard, head)}/{head.version:012d}.{head.kind}")

    def _generation(self, shard: str, head: Head) -> str:
        return f"{self.path}/data/{SHARD}={shard}/{head.generation:012d}"

    def _commits(self, heads: Mapping[str, Head], kind: str) -> list[str]:
        folder = self.claims.folder

        def of(shard: str) -> list[str]:
            at = self._generation(shard, heads[shard])
            return [f"{at}/{n}" for n in folder.names(at) if n.endswith(f".{kind}") and int(n.partition(".")[0]) <= heads[shard].version]

        with ThreadPoolExecutor(AT_A_TIME) as pool:
            return [p for found in pool.map(of, [s for s, h in heads.items() if h.version]) for p in found]

    def _read(self, kind: str, schema: T.StructType, heads: Mapping[str, Head], key: str | None = None) -> DataFrame:
        """Rows of some shards' versions; those that may hold a hash or id alone, if ``key`` is one."""
        paths = self._commits(heads, kind)
        if key is not None:
            paths = [p for at in paths for p in self._parts(at, key)]
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _parts(self, commit: str, key: str) -> list[str]:
        parts = [n for n in self.claims.folder.names(commit) if n.startswith(f"{PART}=")]
        return [f"{commit}/{n}" for n in parts if key[DIGITS:].startswith(n.partition("=")[2])] if parts else [commit]

    def log(self, heads: Mapping[str, Head] | None = None) -> DataFrame:
        return self._read(STATUS, STATUS_LOG, self.heads() if heads is None else heads)

    def stored_rows(self, heads: Mapping[str, Head] | None = None, key: str | None = None) -> DataFrame:
        """``rows`` with their metadata as VARIANT, and its ``HOT_KEYS`` as columns."""
        heads = self.heads() if heads is None else heads
        own = self._read(DOCUMENTS, STORED, heads, key)
        changed = self.log(heads).groupBy("id").agg(F.max_by("status", "ts").alias("__status"), F.max("ts").alias("__ts"))
        return own.join(changed, "id", "left").select(*(F.coalesce("__status", "status").alias(c) if c == "status" else F.coalesce("__ts", c).alias(c) if c == "updated_at" else c for c in STORED.names))

    def rows(self, heads: Mapping[str, Head] | None = None, key: str | None = None) -> DataFrame:
        """All documents, or those of some shards' versions (see ``heads``), with their present status; ``key``, a hash or an id without hyphens, spares what can't hold it."""
        return _as_text(self.stored_rows(heads, key))

    def with_metadata(self, name: str, value: str) -> DataFrame:
        """Documents whose metadata has a text or number under a key; a hot key is a column's filter, another one looks into the VARIANT."""
        found = F.col(name) if name in HOT_KEYS else F.try_variant_get("metadata", f"$.{name}", "string")
        return _as_text(self.stored_rows().where(found == value))

    def _commit(self, rows: DataFrame, key: str, kind: str, base: Mapping[str, Head], generations: int = 0, digits: int = 0) -> list[str]:
        """Stage rows, one file a shard (or one for each of its ``digits`` next digits), and claim the next version of each shard; the shards that another was first with."""
        claims, token = self.claims, uuid.uuid4().hex
        at = f"{self.path}/staging/{token}"
        by = {SHARD: shard_of(F.col(key))} | ({PART: F.substring(key, DIGITS + 1, digits)} if digits else {})
        rows.withColumns(by).repartition(*by).sortWithinPartitions(*by, key).write.option("parquet.block.size", str(GROUP_BYTES)).partitionBy(*by).parquet(at)
        staged = [n.partition("=")[2] for n in claims.folder.names(at) if n.startswith(f"{SHARD}=")]

        def one(shard: str) -> bool:
            last = base.get(shard, Head())
            head = Head(last.version + 1, last.generation + generations, token, kind)
            if not claims.take(shard, head):
                return False
            self._finish(claims, shard, head)
            return True

        with ThreadPoolExecutor(AT_A_TIME) as pool:
            won = dict(zip(staged, pool.map(one, staged), strict=True))
        claims.folder.delete(at)
        return sorted(s for s, done in won.items() if not done)

    def append(self, rows: DataFrame, base: Mapping[str, Head] | None = None) -> list[str]:
        """Add rows of hashes that the catalog doesn't have as of ``base``; return the shards that another writer was first with, of which nothing was added.

        Types, statuses and lengths are checked as they are written.
        """
        good = F.col("type").isin(*TYPES) & F.col("status").isin(*STATUSES)
        for name, most in MOST_CHARACTERS.items():
            good = good & F.col(name).isNotNull() & (F.length(name) <= most)
        checked = rows.withColumn("type", F.when(good, F.col("type")).otherwise(F.raise_error(F.lit("a catalog row has a wrong type or status, or a missing or too long text"))))
        lost = self._commit(_as_stored(checked), "hash", DOCUMENTS, self.heads() if base is None else base)
        self._keep_compact([s for s in base or self.claims.shards() if s not in lost])
        return lost

    def _keep_compact(self, shards: Iterable[str]) -> None:
        heads = self.heads(shards)
        full = [s for s, h in heads.items() if len(self.claims.folder.names(self._generation(s, h))) >= MOST_COMMITS]
        if full:
            self.compact(full)

    def compact(self, shards: Iterable[str] | None = None) -> list[str]:
        """Fold the commits and statuses of all shards, or of some, into new generations; return those that a writer was first with, left as they are."""
        base = {s: h for s, h in self.heads(shards).items() if h.version}
        rows = self.stored_rows(base)
        most, digits = rows.groupBy(shard_of(F.col("hash"))).count().agg(F.max("count")).first()[0] or 0, 0
        while most > FILE_ROWS * 16**digits:
            digits += 1
        lost = self._commit(rows, "hash", DOCUMENTS, base, generations=1, digits=digits)
        claims = self.claims
        for shard, head in base.items():
            if shard not in lost:
                claims.clear(shard, head.version + 1)
                for name in claims.folder.names(f"{self.path}/data/{SHARD}={shard}"):
                    if name.isdigit() and int(name) < head.generation:  # not the one before, which may still be read
                        claims.folder.delete(f"{self.path}/data/{SHARD}={shard}/{name}")
        return lost

    def find_by_hash(self, hash_: str) -> DataFrame:
        return by_hash(self.rows(self.heads([hash_[:DIGITS]]), hash_), hash_)

    def find_by_id(self, id_: str) -> DataFrame:
        key = (self.spark.range(1).select(normalised_uuid(F.lit(id_))).first()[0] or "").replace("-", "")
        return by_id(self.rows(self.heads([key[:DIGITS]] if key else []), key), id_)

    def exists(self, hash_: str) -> bool:
        return not self.find_by_hash(hash_).isEmpty()

    def document_path(self, hash_: str) -> str | None:
        row = self.find_by_hash(hash_).select("storage_path").first()
        return row[0] if row else None

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return page_of(self.rows(), limit, offset)

    def update_status(self, id_: str, status: str) -> bool:
        """Log a status; False if there is no such document."""
        if status not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}: {status}")
        while True:
            found = self.find_by_id(id_).select("id", F.lit(status).alias("status"), F.current_timestamp().alias("ts"))
            row = found.first()
            if row is None:
                return False
            shards = [row.id[:DIGITS]]
            if not self._commit(self.spark.createDataFrame([row], STATUS_LOG), "id", STATUS, self.heads(shards)):
                self._keep_compact(shards)
                return True

    def bring_in(self, rows: DataFrame) -> None:
        """Add those of some rows whose hashes the catalog doesn't have, whoever else writes meanwhile."""
        base = self.heads()
        lost = self.append(rows.join(self.rows(base).select("hash"), "hash", "left_anti"), base)
        while lost:
            base = self.heads(lost)
            lost = self.append(rows.where(shard_of(F.col("hash")).isin(lost)).join(self.rows(base).select("hash"), "hash", "left_anti"), base)

    def log_statuses(self, rows: DataFrame) -> None:
        """Log many statuses (id, status, ts) of documents that are there; ids of none are passed over."""
        wrong = F.raise_error(F.lit("a wrong status"))
        rows = rows.select("id", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(wrong).alias("status"), "ts")
        lost = None
        while lost is None or lost:
            base = self.heads(lost)
            own = rows if lost is None else rows.where(shard_of(F.col("id")).isin(lost))
            lost = self._commit(own.join(self._read(DOCUMENTS, STORED, base).select("id"), "id", "left_semi").select(*STATUS_LOG.names), "id", STATUS, base)
        self._keep_compact(self.claims.shards())

    def statuses(self) -> DataFrame:
        return latest_status(self.log())

    def check(self) -> DataFrame:
        """Hashes that stand in more than one row; there are none unless files were put in by hand."""
        return repeated_hashes(self.rows())
