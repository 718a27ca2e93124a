import random

import numpy as np
import pytest

from docloom.llm import jaccard
from docloom.llm.words import U64

from .conftest import words


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, table, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(jaccard, "TILE_DOCS", 16)
    monkeypatch.setattr(jaccard, "FREQUENT_IN", 20)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(draw(60))
    texts = near_copies(rng, draw(80), 90, 4) + near_copies(rng, draw(1500), 12, 30) + near_copies(rng, draw(12), 20, 1)
    texts += [" ".join(draw(rng.randint(0, 60))) + " " + passage for _ in range(60)] + [" ".join(draw(rng.randint(1, 9))) for _ in range(40)]
    texts += texts[:30] + ["", " ", None, "same", "Same", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in jaccard.join_documents(table(rows, "doc_id long, text string", parts=3)).select("doc_id", "n_shingles", "component_id").collect())
    want = [(i, n, i if n == 0 else c) for i, n, c in brute(rows)]
    assert got == want


def test_work_in_a_group_of_near_copies_grows_with_its_size(table, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_DOCS", 16)
    monkeypatch.setattr(jaccard, "FREQUENT_IN", 20)
    rows = {}

    def counted(df, name, **kwargs):
        out = staged(df, name, **kwargs)
        if name.startswith(("left", "links")):
            rows[name[:4]] = rows.get(name[:4], 0) + out.count()
        return out

    staged = jaccard.staged
    monkeypatch.setattr(jaccard, "staged", counted)
    seen = {}
    for n in (400, 1200):
        rng = random.Random(n)
        texts = near_copies(rng, [f"w{i}" for i in range(90)], n, 2) + [f"{i} " + " ".join(f"w{j}" for j in range(40)) for i in range(10)]
        got = jaccard.join_documents(table(list(enumerate(texts)), "doc_id long, text string", f"documents{n}")).collect()
        assert {r.component_id for r in got} == {0, n}
        seen[n] = dict(rows)
        rows.clear()
    assert all(seen[1200][k] <= 3.5 * seen[400][k] for k in ("left", "link")), seen
    assert seen[1200]["link"] < 1250 and seen[1200]["left"] < 2 * 1250, seen


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(5)
    base = rng.poisson(1.0, (40, 64))
    a, b = (np.maximum(0, base[rng.integers(0, 40, m)] + rng.integers(-1, 2, (m, 64)) * (rng.random((m, 64)) < 0.1)) for m in (300, 200))
    na, nb = a.sum(axis=1), b.sum(axis=1)
    i, j, bound = jaccard.tree_join(a, na, b, nb)
    shared = np.minimum(a[:, None], b[None]).sum(axis=2)
    want = {(x, y) for x, y in zip(*np.nonzero(jaccard.linkable(shared, na[:, None], nb[None])), strict=True)}
    assert {(x, y) for x, y in zip(i, j, strict=True)} == want and want
    assert np.array_equal(bound, shared[i, j])


def test_points_bound_overlaps_when_folded():
    rng = np.random.default_rng(6)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(U64)) for n in (3000, 700))
    b = np.unique(np.concatenate([b, a[:500]]))
    p, q = jaccard.point(a), jaccard.point(b)
    assert len(p) > len(q) and p.sum() == len(a)
    assert np.minimum(jaccard.folded(p, len(q)), q).sum() >= len(np.intersect1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[300] == got[200] == 200


def test_edges(edges, no_docs):
    got = jaccard.join_documents(edges).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[5] == [(4, 5)] * 2 and by[6] == [(4, 5)] and by[7][0][1] == 7 == by[8][0][1] and by[1] == [(0, 1)] and by[2] == [(0, 2)]
    assert jaccard.join_documents(no_docs).count() == 0
    kept = jaccard.first_documents(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 9, 10, 11]


def test_first_documents_stay_when_files_are_dealt_anew(spark, table, redealt, monkeypatch):
    texts = [" ".join(f"w{(i // 2) * 100 + j}" for j in range(20)) for i in range(60)]
    docs = table(list(enumerate(texts)), "doc_id long, text string", parts=5)
    monkeypatch.setattr(jaccard, "staged", redealt(jaccard.staged))
    assert sorted(r.doc_id for r in jaccard.first_documents(docs).collect()) == list(range(0, 60, 2))
