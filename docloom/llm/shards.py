"""Sharding: two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets with seeded
hashes; pass two Fisher-Yates shuffles each bucket and writes it. The buckets in
order are one global random permutation, and shards are equal stretches of it,
so shard sizes differ by at most one row (the ``rows`` law).

Defined results: a null text counts as no bytes; null keys, repeated rows and
ties are ordinary records (the scatter hashes a record's place, not its
content, so copies cannot gather in one bucket); an empty table gives empty
shards; input columns named like an output column (``shard``, ``slot``) are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import numbered, shared_dir, text_or_empty

BUCKET, PLACE = "__bucket", "__place"
SHARD_COLUMNS = ("shard", "slot")


def scatter(docs: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """Pass one: a uniform bucket for each record, with its place.

    ``docs`` has to be a stored Parquet table: a record's place in it, by file, is
    what is hashed, so however the files are split a record is dealt as before.
    """
    return numbered(docs, PLACE).withColumn(BUCKET, F.pmod(F.xxhash64(F.lit(seed), PLACE), F.lit(n_buckets)).cast("int"))


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket, as a two-level prefix sum: (__at, __rows, __before)."""
    counts = counts.withColumn("__super", F.expr(f"{BUCKET} div 1024"))
    inner = Window.partitionBy("__super").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__super").rowsBetween(Window.unboundedPreceding, -1)
    supers = counts.groupBy("__super").agg(F.sum("__rows").alias("__all")).select("__super", F.coalesce(F.sum("__all").over(outer), F.lit(0)).alias("__base"))
    return counts.withColumn("__inner", F.coalesce(F.sum("__rows").over(inner), F.lit(0))).join(supers, "__super").select(F.col(BUCKET).alias("__at"), "__rows", (F.col("__inner") + F.col("__base")).alias("__before"))


def _shuffled(rows: int, n_shards: int, seed: int, names: list[str]):
    def fisher_yates(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names).append_column("shard", pa.array([], pa.int32())).append_column("slot", pa.array([], pa.int64()))
        before, expected = right["__before"][0].as_py(), right["__rows"][0].as_py()
        if expected != left.num_rows:
            raise RuntimeError("the input changed between the passes; shuffle a stored table")
        order = np.argsort(left[PLACE].to_numpy(), kind="stable")  # a shuffle brings a bucket's records in any order
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)
        place = before + np.arange(left.num_rows, dtype=np.int64)
        shard = place * n_shards // rows
        slot = place - -(-shard * rows // n_shards)
        return left.select(names).take(pa.array(order)).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return fisher_yates


def external_shuffle(docs: DataFrame, n_shards: int = 16, seed: int = 17, bucket_bytes: int = 16 << 20, path: str | None = None) -> DataFrame:
    """Shuffle ``docs`` and write it in ``n_shards`` folders ``shard=N`` under ``path``; return the written table.

    The result has the columns of ``docs``, ``shard`` (int) and ``slot`` (long,
    gapless from 0 in each shard, in the shuffled order).
    """
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c not in SHARD_COLUMNS])
    path = path or f"{shared_dir(spark)}/shards"
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_or_empty()) + 1), F.lit(0))).first()
    dealt = scatter(docs, max(1, -(-size // bucket_bytes)), seed)
    offsets = bucket_offsets(dealt.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__rows")))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = dealt.groupBy(BUCKET).cogroup(offsets.groupBy("__at")).applyInArrow(_shuffled(rows, n_shards, seed, docs.columns), schema)
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)
