import math
import random

import pyarrow as pa
import pytest

from docloom.llm import quality


def test_statistics():
    found = quality.statistics(pa.array(["A b b!", None, "é\n9 #"]))
    of = lambda name: found[name].tolist()
    assert of("st_upper") == [pytest.approx(1 / 3), 0, 0] and of("st_bang") == [pytest.approx(1 / 3), 0, 0]
    assert of("st_distinct_words") == [1.0, 0, 1.0] and of("st_digit") == [0, 0, pytest.approx(1 / 5)]
    assert of("st_symbol") == [0, 0, pytest.approx(1 / 5)] and of("st_newline") == [0, 0, pytest.approx(1 / 3)]
    twice = quality.statistics(pa.array(["x y x y x y", "b b b b"]))
    assert twice["st_distinct_words"].tolist() == [pytest.approx(1 / 3), 0.25] and twice["st_top_word"].tolist() == [0.5, 1.0]


@pytest.fixture
def labelled(spark, table):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["the", "river", "town", "old", "walks", "and", "sees."]) + rng.choice(["", "s", "ed", "ly", "ing"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "###", "$$$", "CLICK"]) for _ in range(80))
    rows = [(i, (good if i % 4 else bad)(), "x", 1) for i in range(400)]
    docs = table([*rows, (1000, None, "x", 1), (1001, "", "x", 1), (None, good(), "x", 1)], "doc_id long, text string, lang string, score int")
    labels = table([(i, int(bool(i % 4))) for i, *_ in rows] + [(1000, None), (5000, 1)], "doc_id long, label int", "labels")
    return docs, labels


def test_rules_generalise(labelled):
    docs, labels = labelled
    found = quality.with_statistics(docs.drop("score"))
    rules = quality.fit(found, labels.where(quality.learnable()))
    assert 0 < len(rules.weights) < 120 and all(w for _, w in rules.weights)
    got = quality.scored(found, rules).select("doc_id", "score", "predicted", quality.held_out().alias("held_out")).collect()
    assert len(got) == 403
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 100 and all(r.predicted == int(bool(r.doc_id % 4)) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_compiled_score_matches_plain_python(labelled):
    docs, labels = labelled
    found = quality.with_statistics(docs.drop("score"))
    rules = quality.fit(found, labels)
    got = quality.scored(found, rules).collect()
    for r in got:
        total = rules.intercept + sum(w for rule, w in rules.weights if all((r[f] <= t) == at_most for f, at_most, t in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12) and r.predicted == int(r.score >= 0.5)
    # and the statistics themselves, by hand
    for r in got[:40]:
        text = r.text or ""
        words = text.lower().split(" ") if text else []
        assert r.st_words == pytest.approx(math.log1p(len(words))) and r.st_chars == pytest.approx(math.log1p(len(text)))
        assert r.st_distinct_words == pytest.approx(len(set(words)) / max(1, len(words)))
        assert r.st_distinct_pairs == pytest.approx(len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1))
        assert r.st_top_word == pytest.approx(max(map(words.count, words), default=0) / max(1, len(words)))


def test_very_long_texts(table):
    long = "word " * 400_000 + "end"
    got = quality.with_statistics(table([(1, long), (2, "word end")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].st_words == pytest.approx(math.log1p(400_001)) and got[0].st_top_word == pytest.approx(400_000 / 400_001) and got[1].st_distinct_words == 1


def test_one_kind_of_label_and_none(labelled, no_docs):
    docs, labels = labelled
    found = quality.with_statistics(docs)
    only = quality.fit(found, labels.where("label = 1"))
    assert not only.weights and {r.predicted for r in quality.scored(found, only).collect()} == {1}
    none = quality.fit(found, labels.where("label = 7"))
    assert {round(r.score, 9) for r in quality.scored(found, none).collect()} == {0.5}
    assert quality.scored(quality.with_statistics(no_docs), none).count() == 0


def test_edges(edges):
    assert quality.with_statistics(edges).count() == 14
