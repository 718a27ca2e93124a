import random
import shutil

import pytest

from docloom.llm import pieces

from .conftest import lowered

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(10)
    stems = ["river", "town", "old", "walk", "and", "see", "light", "door", "green", "hill", "stone", "bird"]
    draw = lambda n: [rng.choice(stems) + rng.choice(["", "s", "ed", "ly", "ing"]) for _ in range(n)]
    item = " ".join(draw(40))
    base = draw(150)
    near = list(base)
    near[70] = "changed"
    texts = {i: " ".join(draw(100)) + "." for i in range(200)}
    texts |= {i: " ".join(rng.choice(["BUY!!", "NOW!!", "###", "$$$"]) for _ in range(100)) for i in range(200, 260)}
    texts |= {300: " ".join(base), 301: " ".join(near), 302: " ".join(base), 303: " ".join(draw(50)) + " " + item + " " + " ".join(draw(50)), 304: " ".join(draw(60)) + " token=abcdefghij0123456789 " + " ".join(draw(60))}
    rows = [(i, t, "en", "s", len(t), "more") for i, t in texts.items()] + [(None, " ".join(draw(90)), "en", "s", 1, "more"), (None, " ".join(draw(91)), None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return texts, tmp_path


def test_stages_drop_what_they_should_and_nothing_else(spark, corpus, tmp_path_factory):
    texts, path = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "ngram_jaccard", "decontamination", "secrets", "sentencepiece"]
    docs = spark.read.parquet(str(path / "documents.parquet"))
    ids = {}
    work = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(path)).write.parquet(str(work / name))
        before, docs = docs, spark.read.parquet(str(work / name))
        ids[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
        if name != "sentencepiece":
            assert docs.columns == before.columns
    clean = [-1, -1, *range(200)]
    assert ids["quality"] == [*clean, 300, 301, 302, 303, 304]
    assert ids["ngram_jaccard"] == [*clean, 300, 303, 304]
    assert ids["decontamination"] == ids["secrets"] == ids["sentencepiece"] == [*clean, 300, 304]
    secret = {r.doc_id: r for r in spark.read.parquet(str(work / "secrets")).collect()}
    assert "abcdefghij" not in secret[304].text and "[SECRET]" in secret[304].text and secret[304].n_chars == len(secret[304].text)
    assert secret[0].text == texts[0]
    back = {r.doc_id: r.decoded for r in pieces.decode(docs).collect()}
    assert back[0] == texts[0] and lowered(back[300]) == lowered(texts[300])


def test_empty_tables(spark, corpus, no_docs):
    _, path = corpus
    for table in ("documents", "labels", "benchmark"):
        own = spark.read.parquet(str(path / f"{table}.parquet"))
        schema = own.schema
        shutil.rmtree(path / f"{table}.parquet")
        spark.createDataFrame([], schema).write.parquet(str(path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(path)).count() == 0
