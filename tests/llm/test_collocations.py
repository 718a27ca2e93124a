import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import collocations

from .conftest import lowered


def brute(docs, longest=3, least=10, first=2000, share=50):
    """(lang, rank, phrase, a, l, r, n, score), by counting every phrase of every piece."""
    by = {}
    for lang, text in docs:
        own = by.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in by.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        n = sum(a for g, a in f.items() if len(g) == 1)
        held = {g[i:j] for g, a in often.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and 100 * a >= share * f[g[i:j]]}
        kept = []
        for g, a in often.items():
            if g not in held:
                score, j = min((1_000_000 * a * a // (f[g[:j]] * f[g[j:]]), j) for j in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), f[g[:j]], f[g[j:]]))
        out |= {(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)}
    return out


def rows(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def prose(seed, n, words=12):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice([f"W{int(rng.paretovariate(0.9)) % words}", "é", " "]) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " ! "]) for _ in range(60))) for _ in range(n)]


@pytest.mark.parametrize("longest, first, chunk, tokens", [(3, 2000, 8 << 20, 1 << 20), (4, 7, 900, 500)])
def test_matches_plain_counting(table, monkeypatch, longest, first, chunk, tokens):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "BUCKET_TOKENS", tokens)
    docs = prose(1, 90)
    got = collocations.mine(table(docs, "lang string, text string", parts=3), longest, first=first)
    assert rows(got) == brute(docs, longest, first=first)
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def test_a_hot_pair_and_overlaps(table):
    docs = [("en", "a " * 5000)] + [("en", "a a b")] * 30 + [("de", "a a")] * 9
    got = rows(collocations.mine(table(docs, "lang string, text string"), 3))
    assert got == brute(docs) and max(r[3] for r in got) == 4998


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(9_000_000_000_001, 9_000_000_000_003, 9_100_000_000_000), (3_000_000_000, 3_000_000_001, 3_000_000_000), (10, 21_000, 1), (7, 7, 7)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("*", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    assert [r.score for r in df.collect()] == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_pairs_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(collocations, "mixed", lambda x: x % np.uint64(3))
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 9, 500, np.uint64), rng.integers(0, 9, 500, np.uint64)
    order, at, _ = collocations._distinct(left, right)
    counts = np.diff(np.append(at, 500))
    assert {(int(left[order[i]]), int(right[order[i]])): int(c) for i, c in zip(at, counts, strict=True)} == Counter(zip(left.tolist(), right.tolist(), strict=True)) and len(at) == len(set(zip(left.tolist(), right.tolist(), strict=True)))


def test_wide_ids(table, monkeypatch):
    docs = prose(2, 40)
    monkeypatch.setattr(collocations, "SHORT", collocations.LONG)
    monkeypatch.setattr(collocations, "NARROW", collocations.PAIR)
    assert rows(collocations.mine(table(docs, "lang string, text string"))) == brute(docs)


def test_edges(edges, no_docs):
    docs = [(r.lang, r.text) for r in edges.collect()]
    assert rows(collocations.mine(edges, least=2)) == brute(docs, least=2)
    assert rows(collocations.mine(no_docs)) == set()
