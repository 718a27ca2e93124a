import itertools
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: doc_id, text, and columns whose names the operators use themselves.
EDGES = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, spans string, ids string, n long, rid long, key string, bucket int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lowered(text))


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Documents of every awkward kind, as a stored table."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "A B C d e f g h"), (7, long), (8, long + " end"), (9, "x" * 3000), (None, "no id here at all today"), (None, None), (10, "é ü   ß \U0001f600 end"), (11, "tab\tand\x0bmore\x0cwords\rhere")]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, 2, "x", "y", 3, 4, "k", 5) for i, t in texts]
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    spark.createDataFrame(rows, EDGES).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], EDGES).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def table(spark, tmp_path):
    """Store rows as a table."""

    def store(rows, schema, name="documents", parts=2):
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
        return spark.read.parquet(str(tmp_path / f"{name}.parquet"))

    return store


@pytest.fixture
def redealt(spark):
    """Have each staged table followed by other splits of files, as when executors come or go."""
    name, deals = "spark.sql.files.minPartitionNum", itertools.cycle(["5", "4", "3"])

    def wrap(staged):
        def stage(*args, **kwargs):
            out = staged(*args, **kwargs)
            spark.conf.set(name, next(deals))
            spark.conf.set("spark.sql.files.openCostInBytes", "1000")
            return out

        spark.conf.set(name, "1")
        return stage

    yield wrap
    spark.conf.unset(name)
    spark.conf.unset("spark.sql.files.openCostInBytes")
