import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import katz

from .conftest import words


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        tokens = [[*words(t), "\n"] for t in texts]
        self.one = Counter(w for t in tokens for w in t)
        self.two = Counter(p for t in tokens for p in zip(["\b", *t[:-1]], t, strict=True))
        spectrum = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
        self.d1, self.d2 = katz.good_turing(spectrum(self.one)), katz.good_turing(spectrum(self.two))
        self.n = self.one.total()
        disc = sum(self.cut(v, self.d1) for v in self.one.values())
        self.divisor, self.unknown = (self.n, (self.n - disc) / self.n) if self.n - disc > 1e-9 else (self.n + 1, 1 / (self.n + 1))
        self.after = defaultdict(dict)
        for (h, w), v in self.two.items():
            self.after[h][w] = v

    @staticmethod
    def cut(v, d):
        return v * (d[v] if v <= katz.K else 1)

    def p1(self, w):
        return self.cut(self.one[w], self.d1) / self.divisor if w in self.one else self.unknown

    def p(self, h, w):
        if h not in self.after:
            return self.p1(w)
        total, disc = sum(self.after[h].values()), sum(self.cut(v, self.d2) for v in self.after[h].values())
        divisor, left = (total + 1, 1) if total - disc < 1e-9 * total else (total, total - disc)
        if w in self.after[h]:
            return self.cut(self.after[h][w], self.d2) / divisor
        return left / divisor / (1 - sum(map(self.p1, self.after[h]))) * self.p1(w)

    def score(self, text):
        t = [*words(text), "\n"]
        return sum(math.log10(self.p(h, w)) for h, w in zip(["\b", *t[:-1]], t, strict=True))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=odds / odds.sum()))
    return [(i, draw(int(rng.integers(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "new words only"), (None, "w1 w2"), (3, "w1 W1 w1")]


def test_scores_and_sums_to_one(spark, table, corpus):
    docs = table(corpus, "doc_id long, text string")
    train = [t for i, t in corpus if i is None or i < 100]
    model = katz.fit(docs.where("doc_id IS NULL OR doc_id < 100"), bucket_bytes=1000)
    assert model.counts.buckets > 3 and len(model.counts.salted) > 3
    assert all("/bucket=" in f for table_ in (model.unigrams, model.bigrams) for f in table_.inputFiles())
    brute = Brute(train)
    for h in [*brute.after, "never seen"]:
        assert sum(brute.p(h, w) for w in brute.one) + brute.p(h, "\0") == pytest.approx(1, abs=1e-9)
    got = katz.score(docs, model).collect()
    assert len(got) == len(corpus)
    left = sorted((i if i is not None else -1, len(words(t)) + 1, brute.score(t), sum(w in brute.one for w in words(t)) + 1) for i, t in corpus)
    for r, (i, n, score, known) in zip(sorted(got, key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.score)), left, strict=True):
        assert (r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known) == (i, n, known)
        assert r.score == pytest.approx(score, rel=1e-9)
    base = next(r for r in got if r.doc_id == 501).base_score
    assert base == pytest.approx(math.log10((brute.one["\n"] + 1) / (brute.n + len(brute.one) + 1)))


def test_edges(edges, no_docs):
    model = katz.fit(edges)
    got = katz.score(edges, model).collect()
    assert len(got) == 14 and all(r.score < 0 for r in got)
    assert katz.score(no_docs, katz.fit(no_docs)).count() == 0
    assert all(r.score == 0 and r.n_known == 0 for r in katz.score(edges, katz.fit(no_docs)).collect())


def test_rows_keep_their_numbers_when_files_are_dealt_anew(spark, table, redealt, monkeypatch):
    rows = [(i, " ".join(f"w{i * j % 23}" for j in range(i + 1))) for i in range(40)]
    docs = table(rows, "doc_id long, text string", parts=5)
    model = katz.fit(docs)
    score = lambda: sorted((r.doc_id, r.n_tokens, round(r.score, 9)) for r in katz.score(docs, model).collect())
    want = score()
    monkeypatch.setattr(katz, "staged", redealt(katz.staged))
    assert score() == want and len(want) == 40


def test_discounts():
    d = katz.good_turing([1000, 400, 220, 140, 100, 75])
    assert np.all((d[1:] > 0) & (d[1:] <= 1)) and np.all(np.diff(d[1:]) > 0)
    assert np.all(katz.good_turing([0] * 6)[1:] > 0)


def test_asks_do_not_grow_with_the_buckets():
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"word{i}" for i in range(20_000)])
    texts = [" ".join(vocabulary[np.minimum(rng.zipf(1.2, 300), 20_000) - 1]) for _ in range(2000)]
    batch = pa.record_batch([pa.array(texts), pa.array(np.arange(2000) + (5 << 40))], names=["text", "rid"])
    none, ones = np.zeros(0, np.int64), np.ones(katz.K + 1)

    def size(n):
        c = katz.Counts(n, 600_000, 20_000, none.astype(np.uint64), none, ones, ones, 1e-9, 1.0, none.astype(np.uint64))
        asks = [(kind, b.num_rows and sum(len(b.column(name)[0].as_py()) for name in ("key", "len", "other", "num", "doc"))) for kind, make in (("bigram", katz._bigram_asks), ("word", katz._word_asks)) for b in make(c)(iter([batch]))]
        return {kind: sum(x for k, x in asks if k == kind) for kind in ("bigram", "word")}

    few, many = size(43), size(2500)
    assert all(many[k] <= 2 * few[k] for k in few), (few, many)
