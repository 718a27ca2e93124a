"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow random-forest trees are grown on statistics of labelled texts; every
path from a root is a conjunctive rule. Lasso logistic regression on the rules
leaves few weights, and the rules with weights are compiled into one Spark
column expression, so scoring is an expression over the statistics.

Growing and fitting use at most ``MOST_TRAINING`` labelled rows (those of the
smallest hashes of doc_id); the statistics cover all texts and whole texts.

Defined results: null and empty texts have statistics 0 and are scored like
others; rows without a label, or a null one, aren't learnt from; repeated rows
are scored each, and repeated labels count each; with labels of one kind or
none the score is their smoothed share; other columns pass through ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import staged
from docloom.llm.words import U64, Words, mixed, runs, text_bytes

MOST_TRAINING = 20_000
TREES = 20
DEPTH = 3
LASSO = 0.003
STATISTICS = (
    "st_chars", "st_words", "st_word_length", "st_upper", "st_digit", "st_symbol", "st_bang", "st_stop", "st_comma",
    "st_newline", "st_wide", "st_distinct_words", "st_distinct_pairs", "st_top_word", "st_short_words",
)

#: (feature, is at most the threshold, threshold), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


def _is(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER, _DIGIT, _BANG, _STOP, _COMMA, _NEWLINE = _is(bytes(range(65, 91))), _is(b"0123456789"), _is(b"!"), _is(b".?"), _is(b",;:"), _is(b"\n")
_LETTER = _is(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(192, 256)))
_SYMBOL = _is(b"#$%&*+/<=>@[\\]^_`{|}~")
_WIDE, _CHARACTER = _is(bytes(range(192, 256))), ~_is(bytes(range(128, 192)))


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of different keys and how often the commonest occurs."""
    own = np.sort(mixed(keys) & ~U64(0xFFFF) | row.astype(U64))
    at = runs(own)
    times = np.diff(np.append(at, len(own)))
    of = (own[at] & U64(0xFFFF)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, times)
    return np.bincount(of, minlength=rows), top


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of up to 65536 texts."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(table[data], dtype=np.int64))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    words = Words(column)
    n = words.counts()
    row = np.repeat(np.arange(rows), n)
    per = lambda x, of: x / np.maximum(of, 1)
    chars, letters = count(_CHARACTER), count(_LETTER)
    length = words.end - words.start
    follows = np.flatnonzero(row[1:] == row[:-1])
    pairs = mixed(words.hash[follows] * U64(0x9E3779B97F4A7C15) + words.hash[follows + 1])
    different, top = _distinct(words.hash, row, rows)
    different_pairs, _ = _distinct(pairs, row[follows], rows)
    found = (
        np.log1p(chars), np.log1p(n), per(np.bincount(row, length, rows), n), per(count(_UPPER), letters), per(count(_DIGIT), chars),
        per(count(_SYMBOL), chars), per(count(_BANG), n), per(count(_STOP), n), per(count(_COMMA), n), per(count(_NEWLINE), n), per(count(_WIDE), chars),
        per(different, n), per(different_pairs, np.maximum(n - 1, 0)), per(top, n), per(np.bincount(row, length <= 3, rows), n),
    )
    return dict(zip(STATISTICS, (x.astype(np.float64) for x in found), strict=True))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``STATISTICS`` of ``text``; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in STATISTICS]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = statistics(part.column("text"))
                yield pa.record_batch([*(part.column(c) for c in kept), *map(pa.array, found.values())], names=[*kept, *found])

    return docs.select(kept).mapInArrow(run, schema)


def _paths(node, names: tuple[str, ...], path: Rule = ()) -> Iterator[Rule]:
    """The conjunctions that lead to each node below the root."""
    if path:
        yield path
    if node.subtreeDepth():
        feature, threshold = names[node.split().featureIndex()], node.split().threshold()
        yield from _paths(node.leftChild(), names, (*path, (feature, True, threshold)))
        yield from _paths(node.rightChild(), names, (*path, (feature, False, threshold)))


def holds(rule: Rule) -> Column:
    """A rule as a column: 1.0 where it holds, else 0.0."""
    out = F.lit(True)
    for feature, at_most, threshold in rule:
        out = out & ((F.col(feature) <= threshold) if at_most else (F.col(feature) > threshold))
    return F.when(out, 1.0).otherwise(0.0)


@dataclass
class Rules:
    """Weighted rules, and the intercept."""

    weights: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, from the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.lit(weight) * holds(rule)
        return 1 / (1 + F.exp(-total))


def fit(statistics_: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, seed: int = 5) -> Rules:
    """Learn ``label`` (0 or 1) of (doc_id, label) from (doc_id, STATISTICS)."""
    rows = statistics_.join(labels.where("label IN (0, 1)").select("doc_id", F.col("label").cast("double").alias("label")), "doc_id")
    training = staged(rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "label", *STATISTICS).limit(most), "training")
    n, ones = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Rules([], float(np.log((ones + 1) / (n - ones + 1))))
    features = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(training).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(features)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), STATISTICS)})
    if not rules:
        return Rules([], float(np.log((ones + 1) / (n - ones + 1))))
    held = training.select(array_to_vector(F.array(*map(holds, rules))).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=100, tol=1e-4).fit(held)
    return Rules([(rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w], float(lasso.intercept))


def learnable(mod: int = 3, rest: int = 1) -> Column:
    """Whether labels of a row may be learnt: the CRC-32 of its doc_id as text leaves another remainder."""
    return ~held_out(mod, rest)


def held_out(mod: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def scored(statistics_: DataFrame, rules: Rules) -> DataFrame:
    """With ``score`` and ``predicted`` (1 if the score is at least 0.5)."""
    return statistics_.withColumn("score", rules.score()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
