import os
import uuid

import duckdb
import pytest

from docloom import queries
from docloom.queries import ORACLES, QUERIES
from docloom.work import work_dir

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "events")


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return own


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    want = duck.execute(ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert len(want.description) == len(columns)
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall()) and got


@pytest.mark.parametrize("name", ["folder_scan", "ingest_run", "packed_round_trip", "storage_scan"])
def test_query_on_a_cluster(spark, duck, monkeypatch, name):
    """The work folder is shared by all executors, so a store in it is not refused."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://x")
    test_query_matches_duckdb(spark, duck, name)


def test_work_folder_is_the_same_to_all_tasks(spark, monkeypatch, tmp_path):
    """Executors have working folders of their own: with a relative path each wrote to and listed another folder, and storage_scan had no rows."""
    relative = os.path.relpath(tmp_path, spark._jvm.System.getProperty("user.dir"))
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: relative)
    assert os.path.dirname(work_dir(spark)) in (f"file:{tmp_path}", f"file://{tmp_path}")


def test_storage_scan_without_the_setting(spark, duck, monkeypatch):
    """Spark refuses to change spark.checkpoint.dir in a running session, so a folder isn't kept there."""
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir" else get(self, key, *default))
    test_query_matches_duckdb(spark, duck, "storage_scan")


def test_storage_scan_lacks_no_file_unseen(spark, duck, monkeypatch, tmp_path):
    """A content that can't be written (a folder has its name) is an error, not a row less."""
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    monkeypatch.setattr(queries, "work_dir", lambda spark: at)
    name = duck.execute(f"SELECT min(name) FROM ({ORACLES['storage_scan']})").fetchone()[0]
    os.makedirs(f"{at}/storage/abstracts/{name}/in the way")
    with pytest.raises(OSError, match=name[:64]):
        queries.storage_scan(spark, SF_DIR)


@pytest.mark.parametrize("bad", ["missing", "loop"])
def test_storage_scan_s_listing_fails_as_such(spark, monkeypatch, tmp_path, bad):
    """A store that can't be listed, or something in it, was passed over: a failure looked like a result."""
    at = f"{tmp_path}/{uuid.uuid4().hex}"
    if bad == "loop":
        os.makedirs(f"{at}/storage/abstracts/deep")
        os.symlink("loop", f"{at}/storage/abstracts/deep/loop")
        monkeypatch.setattr(queries, "work_dir", lambda spark: at)
    else:
        monkeypatch.setattr(queries, "_filed", lambda spark, sf_dir: f"{at}/missing")
    with pytest.raises(OSError, match=f"1 folders or files can't be listed, the first is .*/{bad}: "):
        queries.storage_scan(spark, SF_DIR)
