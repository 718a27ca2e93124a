import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import decontaminate
from docloom.llm.words import U64

from .conftest import words


def shingles(w):
    return [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []


def brute(docs, items, least=0.75):
    found = {}
    for i, t in docs:
        w = words(t)
        own = shingles(w)
        for item, text in items:
            v = words(text)
            want = Counter(shingles(v))
            if not want or not own or (len(v) < 5 and len(w) != len(v)):
                continue
            m = len(v) - 4 if len(v) >= 5 and len(w) >= len(v) else len(own)
            best = (0, 0)
            for a in range(len(own) - m + 1):
                x = Counter(own[a : a + m])
                shared = sum((x & want).values())
                if (j := shared / (x.total() + want.total() - shared)) > best[0]:
                    best = (j, a)
            if best[0] >= least:
                found[i, item] = best
    return found


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(draw(rng.randint(15, 70)))) for k in range(30)] + [(90, "one two"), (91, None), (92, ""), (93, "a b a b a b a b a b a b")]
    docs = []
    for i in range(150):
        w = draw(rng.randint(0, 300))
        if i % 3 == 0:
            own = words(items[i % 30][1])
            for _ in range(i % 7):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "One  TWO"), (503, "one two three"), (504, items[3][1].upper()), (505, " ".join(words(items[4][1])[:-2])), (506, "x " + items[93 - 60][1] + " y"), (506, "x " + items[93 - 60][1] + " y")]
    return docs, items


def test_finds_what_brute_force_finds(spark, table, planted, monkeypatch):
    docs, items = planted
    want = brute(docs, items)
    benchmark = table(items, "item_id long, text string", "benchmark", 1)
    for size in (decontaminate.ITEM_BLOCK_BYTES, 1000):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", size)
        rows = decontaminate.leaks(table(docs, "doc_id long, text string", f"documents{size}"), benchmark).collect()
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in rows}
        assert {k: (pytest.approx(j), a) for k, (j, a) in want.items()} == got
        assert len(rows) == len(want) + 1 and len(want) > 10


def test_multi_index_guarantees_the_radius_and_prunes():
    rng = np.random.default_rng(8)
    stored = rng.integers(0, 2**63, (200, 2)).astype(U64) * U64(2) + rng.integers(0, 2, (200, 2)).astype(U64)
    asked = stored[rng.integers(0, 200, 600)]
    for k in range(600):
        for b in rng.choice(128, rng.integers(0, 50), replace=False).tolist():
            asked[k, b // 64] ^= U64(1) << U64(b % 64)
    index = decontaminate.MultiIndex(stored)
    i, j = index.within(asked)
    want = {(a, b) for a, b in zip(*np.nonzero(decontaminate.distance(asked[:, None], stored[None]) <= decontaminate.RADIUS), strict=True)}
    assert {(a, b) for a, b in zip(i, j, strict=True)} == want and len(want) > 200
    others = rng.integers(0, 2**63, (500, 2)).astype(U64) * U64(2)
    share = len(index.candidates(others)[0]) / (500 * 200)
    assert 0.3 < share < 0.45


def test_similar_windows_are_within_the_radius():
    rng = np.random.default_rng(9)
    far = []
    for _ in range(2000):
        m = int(rng.integers(11, 60))
        shared = -(-6 * m // 7)  # of m shingles each, for a similarity of 0.75 at least
        own = rng.integers(0, 2**63, 2 * m).astype(U64)
        a, b = own[:m], np.concatenate([own[:shared], own[m : 2 * m - shared]])
        x, y = (decontaminate.fingerprints(decontaminate.signs(s).sum(axis=0, keepdims=True)) for s in (a, b))
        far.append(int(decontaminate.distance(x, y)[0]))
    assert np.mean(np.array(far) > decontaminate.RADIUS) < 0.005 and 15 < np.mean(far) < 23


def test_edges(spark, table, edges, no_docs):
    benchmark = table([(1, "a b c d e f g h"), (2, None)], "item_id long, text string", "benchmark", 1)
    assert sorted(r.doc_id for r in decontaminate.leaks(edges, benchmark).collect()) == [5, 5, 6]
    assert decontaminate.leaks(no_docs, benchmark).count() == 0
    assert decontaminate.leaks(edges, table([], "item_id long, text string", "nothing", 1)).count() == 0
