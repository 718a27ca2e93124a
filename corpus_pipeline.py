"""A corpus pipeline of five stages, each on all that the one before it kept.

1. quality: documents that the rule ensemble rejects go.
2. ngram_jaccard: one document of each group of near copies stays, that of the smallest doc_id.
3. decontamination: documents that hold a benchmark item go.
4. secrets: spans of secrets are cut out of the texts; no document goes.
5. sentencepiece: the documents as token ids.

Every stage takes and returns documents with their columns (the last: doc_id,
source, n_tokens and ids), and none drops a document for its length, its order
or its other columns. Documents of null doc_id are kept like others; of a group of
near copies without any doc_id the first row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard, pieces, quality, secrets
from docloom.llm.common import numbered, prepare, read_table, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores 0.5 or more. Labels that are held out (see ``quality.held_out``) aren't learnt."""
    prepare(spark)
    labels = read_table(spark, sf_dir, "labels").where(quality.learnable()).select("doc_id", F.col("quality").alias("label"))
    own = {c: f"__own_{c}" for c in docs.columns if c in (*quality.STATISTICS, "score", "predicted")}
    found = quality.with_statistics(docs.withColumnsRenamed(own))
    learnt = staged(found.select("doc_id", *quality.STATISTICS).join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    return quality.scored(found, quality.fit(learnt, labels)).where("predicted = 1").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of links at Jaccard 0.75 on five-word shingles."""
    prepare(spark)
    return jaccard.first_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window that is 0.75 similar to an item of ``benchmark``."""
    prepare(spark)
    rows = numbered(docs, "__rid")
    leaking = decontaminate.leaks(rows.select(F.col("__rid").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    return rows.join(leaking.select(F.col("doc_id").alias("__rid")).distinct(), "__rid", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut secrets out of the texts; ``n_chars`` is counted anew."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    prepare(spark)
    return pieces.encode(docs).select("doc_id", *(c for c in ("source",) if c in docs.columns), "n_tokens", "ids")


STAGES = [
    ("quality", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Trained scores, fingerprints and token ids are beyond SQL; the tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
