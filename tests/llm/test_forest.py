import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_and_share_compared_on_clusters(spark, table, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((400, 64))
    rows = [(i, (centres[i % 400] + 0.15 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(8000)]
    monkeypatch.setattr(forest, "INDEX_BLOCK", 1000)
    compared = {}

    def counted(df, name, **kwargs):
        out = staged(df, name, **kwargs)
        if name in ("found", "more"):
            compared[name] = out.select("query_id", "block", "compared").distinct().agg(F.sum("compared")).first()[0] or 0
        return out

    staged = forest.staged
    monkeypatch.setattr(forest, "staged", counted)
    assert recall(spark, table, rows, np.array([v for _, v in rows])) >= 0.97
    share = (compared["found"] + compared["more"]) / (160 * 8000)
    assert share < 0.3, (compared, share)


def recall(spark, table, rows, vectors):
    """Share of the true nearest that are found with the query's own parameters; scores and ranks are checked."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {}
    for r in forest.nearest(table([(*r, 0) for r in rows], SCHEMA, "embeddings", 3), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(got) == len([i for i, _ in rows if i % 50 == 0])
    hits = 0
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        near = unit @ unit[q]
        near[q] = -2
        hits += len({v for v, _ in found.values()} & set(np.argsort(-near)[:5].tolist()))
        assert [s for _, (_, s) in sorted(found.items())] == sorted((s for _, s in found.values()), reverse=True)
        assert all(s == pytest.approx(near[v], abs=1e-6) for v, s in found.values())
    return hits / (5 * len(got))


def test_recall_on_vectors_without_near_neighbours(spark, table):
    vectors = np.random.default_rng(5).standard_normal((6000, 64)).astype(np.float32)
    assert recall(spark, table, [(i, v.tolist()) for i, v in enumerate(vectors)], vectors.astype(float)) >= 0.9


def test_dense_points_are_searched_deeper(spark, table, monkeypatch):
    """A third of all points in one narrow cone: more than a table's prefix holds."""
    monkeypatch.setattr(forest, "INDEX_BLOCK", 500)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    vectors = np.concatenate([centre + 0.01 * rng.standard_normal((2000, 32)), rng.standard_normal((2000, 32))]).astype(np.float32)
    assert recall(spark, table, [(i, v.tolist()) for i, v in enumerate(vectors)], vectors.astype(float)) >= 0.9


def test_least_cosines():
    steps = forest.least_cosines(32, 0.05)
    assert [x for x, _ in steps] == list(range(1, 63)) and all(a < b for (_, a), (_, b) in zip(steps, steps[1:], strict=False))
    rng = np.random.default_rng(7)
    x, least = steps[4]
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = least * a + np.sqrt(1 - least**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    s, t = (forest.hash_strings(y, 32, 11) >> (forest.BITS - x) for y in (a, b))
    assert np.mean(~np.any(s == t, axis=1)) < 0.1


def test_copies_ties_and_unusable_vectors(spark, table):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(40)] + [(0, same, 0), (50, [3.0, 2.0, 1.0], 0), (60, None, 0), (61, [], 0), (62, [0.0, 0.0, 0.0], 0), (63, [1.0, None, 1.0], 0), (64, [nan, 1.0, 1.0], 0), (65, [inf, 1.0, 1.0], 0), (None, same, 0), (100, [1.0, 1.0], 0), (101, [1.0, 0.5], 0), (150, [0.0] * 3, 0)]
    got = {}
    for r in forest.nearest(table(rows, SCHEMA, "embeddings"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 50, 100]
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(got[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert got[100] == [(1, 101)]


def test_an_id_with_several_vectors_and_clashing_columns(table):
    rows = [(0, [1.0, 0.0], 1, 2, "q"), (0, [0.0, 1.0], 1, 2, "q"), (1, [1.0, 0.1], 1, 2, "q"), (1, [0.1, 1.0], 1, 2, "q"), (2, [0.5, 0.5], 1, 2, "q")]
    df = table(rows, "vec_id long, embedding array<float>, rank int, block long, strings string", "embeddings")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 3)) for r in forest.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.995), (0, 2, 2, 0.707)]


def test_empty_table(spark, table):
    assert forest.nearest(table([], SCHEMA, "embeddings", 1), F.col("vec_id") % 50 == 0).count() == 0
