import dataclasses
import hashlib
import io
import json
import os
import random
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docloom.__main__ import main
from docloom.config import Settings
from docloom.operators import batch, headers, stats, validity
from docloom.plans import catalog as cat
from docloom.plans import routes, storage
from docloom.plans.catalog import Catalog
from docloom.plans.claims import HadoopFolder, Head
from docloom.plans.extract import extract, extracted, write_extracts
from docloom.plans.ingest import ingest
from docloom.schemas import CATALOG
from docloom.sources import files, markdown, pdf
from docloom.sources.listing import NO_FILE, list_folder
from docloom.sources.systems import refuse_unshared
from docloom.streaming.landing import ingest_landing


def reader(content):
    """Pages divided by form feeds; a file that begins with ``bad`` cannot be read."""
    if content.startswith(b"bad"):
        raise ValueError("not a document")
    return [[("Text", part.decode(), None)] if part else [] for part in content.split(b"\f")]


@pytest.fixture
def place(tmp_path):
    landing = tmp_path / "landing"
    (landing / "deep").mkdir(parents=True)
    for name, content in {"a.pdf": "first document", "b.PDF": "first document", "c.pdf": "short", "d.pdf": "bad file here", "e.pdf": "x" * 200, "f.txt": "no pdf at all", "deep/g.pdf": "another document"}.items():
        (landing / name).write_text(content)
    return landing, Settings(storage_dir=str(tmp_path / "storage"), catalog_dir=str(tmp_path / "catalog")), tmp_path


class Small(Settings):
    max_file_size = 100


def taken(spark, found, own, work):
    blocks = pdf.read_blocks(found.where(F.col("length") <= own.max_file_size), reader)
    rows = ingest(spark, found, validity.valid_light(blocks.where("error IS NULL")), own, str(work)).collect()
    return {r.original_filename: r for r in sorted(rows, key=lambda r: not r.is_duplicate)}  # a duplicate bears the first one's name


def test_a_folder_end_to_end(spark, place):
    landing, base, tmp = place
    own = Small(storage_dir=base.storage_dir, catalog_dir=base.catalog_dir)
    found = files.scan_directory(spark, str(landing), "abstract", metadata='{"k": 1}')
    got = taken(spark, found, own, tmp / "w1")
    assert got["a.pdf"].message == "Document successfully ingested"
    assert got["c.pdf"].message == got["d.pdf"].message == "Processing failed: Invalid or corrupted PDF file"
    assert got["e.pdf"].message == "Processing failed: File size 200 bytes exceeds maximum 100 bytes" and got["e.pdf"].document_id is None
    assert len(got) == 4
    catalog = Catalog(spark, own.catalog_dir)
    row = catalog.rows().first()
    assert catalog.rows().count() == 1 and json.loads(row.metadata)["k"] == 1 and json.loads(row.metadata)["source_type"] == "directory_scan"
    assert open(row.storage_path).read() == "first document" and "/abstracts/" in row.storage_path

    again = taken(spark, files.scan_directory(spark, str(landing), "publication", recursive=True), own, tmp / "w2")
    assert again["a.pdf"].is_duplicate and again["a.pdf"].type == "abstract" and again["a.pdf"].message == "Document already exists"
    assert not again["g.pdf"].is_duplicate and catalog.rows().count() == 2 and catalog.check().count() == 0
    assert catalog.exists(row.hash) and catalog.document_path(row.hash) == row.storage_path and catalog.document_path("x") is None
    assert catalog.update_status(row.id.upper(), "processing_failed") and not catalog.update_status("12345678123456781234567812345678", "ingested")
    assert catalog.find_by_id("urn:uuid:" + row.id).first().status == "processing_failed" and catalog.find_by_id("none").count() == 0
    page = catalog.page(1, 1).collect()
    assert len(page) == 1 and (page[0].total, page[0].total_available) == (1, 2)
    assert catalog.rows(catalog.heads([row.hash[:2]])).where(F.col("hash") == row.hash).count() == 1 and catalog.rows(catalog.heads(["zz"])).count() == 0
    assert catalog.find_by_hash(row.hash).inputFiles() and all(f"/shard={row.hash[:2]}/" in f for f in catalog.find_by_hash(row.hash).inputFiles())
    stored = stats.service_stats(files.scan_storage(spark, own.storage_dir).where("path LIKE '%.pdf'"), own.max_file_size_mb * 1048576, 3).first()
    assert stored.storage.total_files == 2 and stored.max_file_size_mb == 100
    catalog.drop()


def test_every_file_of_a_folder_is_answered(spark, place):
    """Empty, hidden, oversize and unreadable files too; an oversize one is never read (3 GiB would not fit)."""
    landing, base, tmp = place
    own = Small(storage_dir=base.storage_dir, catalog_dir=base.catalog_dir)
    (landing / "empty.pdf").write_bytes(b"")
    (landing / ".hidden.pdf").write_text("a hidden document")
    (landing / "_also.PDF").write_text("another hidden one")
    (landing / "deep/none.pdf").write_bytes(b"")
    with (landing / "huge.pdf").open("wb") as f:
        f.truncate(3 << 30)
    answer, results = routes.ingest_directory(spark, str(landing), "abstract", own, recursive=True, reader=reader)
    names = [n for _, _, files in os.walk(landing) for n in files if n.lower().endswith(".pdf")]
    got = {r.file.rpartition("/")[2]: r for r in results.collect()}
    assert sorted(got) == sorted(names) and results.count() == len(names) == 11
    assert json.loads(answer.toJSON().first()) == {"message": "Directory processing complete", "directory": str(landing), "total_files": 11, "successful": 11, "failed": 0}
    invalid, large = "Processing failed: Invalid or corrupted PDF file", "Processing failed: File size {} bytes exceeds maximum 100 bytes"
    assert got["empty.pdf"].response.message == got["none.pdf"].response.message == got["c.pdf"].response.message == got["d.pdf"].response.message == invalid
    assert got["huge.pdf"].response.message == large.format(3 << 30) and got["e.pdf"].response.message == large.format(200)
    assert got[".hidden.pdf"].response.status == got["_also.PDF"].response.status == "ingested"
    listed = {r.path.removeprefix("file:"): r.length for r in files.scan_storage(spark, str(landing)).collect()}
    assert listed == {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, found in os.walk(landing) for n in found}
    assert files.pdf_listing(spark, [("data", "in", str(landing))]).first().pdf_count == 9
    one = routes.ingest_local(spark, str(landing / "empty.pdf"), "abstract", own, reader=reader).first()
    assert one.document.message == invalid


def test_errors_of_single_files(spark, place, monkeypatch):
    """A file that can't be read is an error and not a success; one that can't be stored has failed; the others go on."""
    landing, own, tmp = place
    found = files.scan_directory(spark, str(landing), "abstract").withColumn("error", F.when(F.col("name") == "a.pdf", "OSError: input/output error"))
    found = found.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
    results = stats.directory_results(routes.take_in(found, own, reader))
    got = {r.file.rpartition("/")[2]: r for r in results.collect()}
    assert (got["a.pdf"].success, got["a.pdf"].error, got["a.pdf"].response) == (False, "OSError: input/output error", None)
    assert got["b.PDF"].success and got["b.PDF"].response.message == "Document successfully ingested"
    row = stats.directory_answer(results, "x").first()
    assert (row.total_files, row.successful, row.failed) == (5, 4, 1)
    (tmp / "storage/publications" / f"{hashlib.sha256(b'another document').hexdigest()}_g.pdf" / "in the way").mkdir(parents=True)
    again = {r.path.rpartition("/")[2]: r for r in routes.take_in(files.scan_directory(spark, str(landing / "deep"), "publication"), own, reader).collect()}
    assert again["g.pdf"].status == "processing_failed" and again["g.pdf"].message.startswith("Processing failed: ") and again["g.pdf"].document_id is None
    assert Catalog(spark, own.catalog_dir).rows().count() == 2


def test_what_can_t_be_listed_is_answered(spark, place, capsys, monkeypatch):
    """A folder that can't be listed, a link that leads nowhere and a pipe are errors of their own, beside the other files."""
    landing, own, tmp = place
    (landing / "deep/loop").symlink_to("loop")  # looking at it fails, so it may be a folder
    (landing / "gone.pdf").symlink_to("nowhere")
    os.mkfifo(landing / "pipe.pdf")
    answer, results = routes.ingest_directory(spark, str(landing), "abstract", own, recursive=True, reader=reader)
    got = {r.file.rpartition("/")[2]: r for r in results.collect()}
    bad = {"loop": "OSError: ", "gone.pdf": "FileNotFoundError: ", "pipe.pdf": NO_FILE}
    assert sorted(got) == sorted(["a.pdf", "b.PDF", "c.pdf", "d.pdf", "e.pdf", "g.pdf", *bad])
    assert all((r.success, r.response) == (False, None) and r.error.startswith(bad[n]) if n in bad else r.success for n, r in got.items())
    row = answer.first()
    assert (row.total_files, row.successful, row.failed) == (9, 6, 3)
    found, counts = extract(routes.extract_inputs(spark, str(landing)), dataclasses.replace(own, reader="lenient"), str(tmp / "x"), lambda content: [[]])
    assert {r.path.rpartition("/")[2] for r in found.where("error IS NOT NULL").collect()} == {"gone.pdf", "pipe.pdf"} and (counts["successful"], counts["failed"]) == (5, 2)
    places = [("data", "in", str(landing)), ("data", "deep", str(landing / "deep"))]
    assert {r.name: (r.exists, r.pdf_count, r.error) for r in files.pdf_listing(spark, places).collect()} == {"in": (True, 7, None), "deep": (True, 1, None)}
    monkeypatch.setattr(files, "_status", lambda spark, path: spark._jvm.org.apache.hadoop.fs.FileStatus(0, True, 1, 1, 0, spark._jvm.org.apache.hadoop.fs.Path(path)))  # removed since
    gone = {r.name: (r.exists, r.pdf_count, r.error) for r in files.pdf_listing(spark, [*places, ("data", "gone", str(landing / "gone"))]).collect()}["gone"]
    assert gone[:2] == (False, None) and gone[2].startswith("FileNotFoundError: ")
    with pytest.raises(OSError, match="loop: "):
        files.scan_storage(spark, str(landing))
    assert list_folder(spark, str(landing / "deep")).count() == 1  # nothing below was asked for
    with pytest.raises(OSError, match="none: "):
        landed(spark, landing / "none", own, tmp, [])
    (landing / "deep/loop").unlink()
    assert files.scan_storage(spark, str(landing)).count() == 7  # what isn't a file is not counted
    monkeypatch.setenv("STORAGE_DIR", str(tmp / "new"))
    assert main(["stats"]) == 0 and json.loads(capsys.readouterr().out)["storage"]["total_files"] == 0
    (tmp / "new/abstracts/loop").symlink_to("loop")
    assert main(["stats"]) == 1 and capsys.readouterr().out == ""


def test_names_stay_in_the_store_and_contents_with_their_names(spark, place):
    landing, own, tmp = place
    names = ["a.pdf", "a.pdf", "../../../../evil/own.pdf", "/etc/passwd.pdf", "s3://x/y.pdf", "b\\c\n\x01.pdf", "..pdf", "n" * 250 + ".pdf"]
    sent = [(n, f"content number {k}".encode()) for k, n in enumerate(names)]
    sent.append(("m" * 260 + ".pdf", b"a name that is too long"))
    got = routes.take_in(files.uploads(spark, sent, "abstract"), own, reader).collect()
    assert len(got) == len(sent)
    for r in got:
        k = int(r.path.rpartition(":")[2])
        if k == len(names):
            assert r.message == "Processing failed: the file name has more than 255 characters" and r.document_id is None
            continue
        assert r.original_filename == names[k] and r.storage_path.startswith(own.storage_dir + "/abstracts/") and ".." not in r.storage_path.removeprefix(own.storage_dir).split("/")
        held = open(r.storage_path, "rb").read()
        assert held == sent[k][1] and hashlib.sha256(held).hexdigest() in r.storage_path
    assert sum(len(f) for _, _, f in os.walk(tmp / "storage")) == len(names) and not (tmp / "evil").exists()
    with pytest.raises(ValueError):
        refuse_unshared(type("S", (), {"sparkContext": type("C", (), {"master": "spark://x"})()})(), "/local/folder")
    with pytest.raises(ValueError):
        storage.FileStore(spark, f"{tmp}/{'d' * 400}").bootstrap()
    bad = spark.createDataFrame([(f"{own.storage_dir}/abstracts/../../x", bytearray(b"x"), hashlib.sha256(b"x").hexdigest()), (f"{own.storage_dir}/abstracts/y", bytearray(b"x"), "0")], "storage_path string, content binary, hash string")
    errors = {r.storage_path[-1]: r.error for r in storage.written(bad, own.storage_dir).collect()}
    assert "outside" in errors["x"] and "changed" in errors["y"]


def test_packed_contents(spark, place, monkeypatch):
    landing, own, tmp = place
    monkeypatch.setattr(storage, "PACK_BYTES", 60)
    own = dataclasses.replace(own, packed=True)
    got = {r.original_filename: r for r in routes.take_in(files.scan_directory(spark, str(landing), "abstract", recursive=True), own, reader).collect()}
    assert got["a.pdf"].storage_path.startswith(f"{own.storage_dir}/packs#")
    store = storage.PackStore(spark, own.storage_dir)
    held = {bytes(r.content) for r in store.read(store.index()).collect()}
    assert held == {b"first document", b"x" * 200, b"another document"} and {hashlib.sha256(c).hexdigest() for c in held} == {r.hash for r in store.index().collect()}
    assert stats.storage_stats(store.sizes()).first().total_size_bytes == 230 and store.read(spark.createDataFrame([("00",)], "hash string")).count() == 0
    before = sorted(os.listdir(tmp / "storage/packs"))
    assert not routes.take_in(files.scan_directory(spark, str(landing), "abstract"), own, reader).where("NOT is_duplicate AND status = 'ingested'").count()
    assert sorted(os.listdir(tmp / "storage/packs")) == before
    (tmp / "storage/packs" / f".{'0' * 32}.pack.part").write_bytes(b"a task died here")
    (tmp / "storage/packs" / f"{'1' * 32}.pack").write_bytes(b"and here, before the index")
    assert store.read(store.index()).count() == 3 and store.vacuum() == 2 and sorted(os.listdir(tmp / "storage/packs")) == before


def test_two_writers_bring_no_hash_in_twice(spark, place):
    landing, own, tmp = place
    for k in range(40):
        (landing / f"own{k}.pdf").write_text(f"document number {k // 2}")
    other = tmp / "other"
    shutil.copytree(landing, other)
    for k in range(10):
        (other / f"new{k}.pdf").write_text(f"only here {k}")

    def run(folder):
        return routes.take_in(files.scan_directory(spark, str(folder), "abstract"), own, reader).collect()

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(run, (landing, other))
    catalog = Catalog(spark, own.catalog_dir)
    rows = {r.id: r for r in catalog.rows().collect()}
    assert catalog.check().count() == 0 and len(rows) == catalog.rows().count() == 20 + 10 + 2
    assert (len(first), len(second)) == (45, 55)
    answered = [r for r in (*first, *second) if r.status == "ingested"]
    assert sum(not r.is_duplicate for r in answered) == len(rows)
    for r in answered:
        assert (rows[r.document_id].storage_path, rows[r.document_id].original_filename) == (r.storage_path, r.original_filename) and os.path.exists(r.storage_path)
    assert sum(len(f) for _, _, f in os.walk(tmp / "storage")) == len(rows)


def catalog_row(n, day=1):
    digest = hashlib.sha256(str(n).encode()).hexdigest()
    at = datetime(2024, 1, day, tzinfo=timezone.utc)
    return (str(uuid.UUID(digest[:32])), f"{n}.pdf", f"/s/{n}", "abstract", at, digest, "ingested", "{}", at, at)


def test_commits_are_claimed_once_and_finished_by_others(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.create()
    frame = lambda *ns: spark.createDataFrame([catalog_row(n) for n in ns], CATALOG)
    base = catalog.heads([f"{k:02x}" for k in range(256)])
    assert catalog.append(frame(1, 2), base) == []
    taken = sorted({r.hash[:2] for r in catalog.rows().collect()})
    assert catalog.append(frame(1, 3), base) == [h for h in taken if h == catalog_row(1)[5][:2]]
    assert catalog.rows().count() == 3 and catalog.check().count() == 0
    shard = catalog_row(4)[5][:2]
    claims, head = catalog.claims, catalog.heads([shard])[shard]
    cat._as_stored(frame(4)).withColumn("shard", F.lit(shard)).write.partitionBy("shard").parquet(f"{catalog.path}/staging/abc")
    assert claims.take(shard, Head(head.version + 1, head.generation, "abc", "documents"))  # and its writer dies
    assert catalog.exists(catalog_row(4)[5]) and not os.path.exists(f"{catalog.path}/staging/abc/shard={shard}")
    assert not claims.take(shard, Head(head.version + 1, head.generation, "def", "documents"))
    claims.clear(shard, head.version + 1)
    assert head.version == 0 or not claims.take(shard, Head(head.version, head.generation, "late", "documents"))


def test_folders_by_hadoop(spark, tmp_path):
    own = HadoopFolder(spark, f"file://{tmp_path}")
    own.make(f"{tmp_path}/a/b")
    assert own.put_if_absent(f"{tmp_path}/a/b/1", "first") and not own.put_if_absent(f"{tmp_path}/a/b/1", "second")
    assert own.read(f"{tmp_path}/a/b/1") == "first" and own.read(f"{tmp_path}/none") == "" and own.names(f"{tmp_path}/none") == []
    assert own.move(f"{tmp_path}/a/b", f"{tmp_path}/c/d") and not own.move(f"{tmp_path}/a/b", f"{tmp_path}/c/e")
    assert [n for n in own.names(f"{tmp_path}/c/d") if not n.startswith(".")] == ["1"]
    own.delete(f"{tmp_path}/c")
    assert own.names(f"{tmp_path}/c") == []


def test_a_file_system_that_only_spark_reads(spark, place):
    landing, own, tmp = place
    (landing / "empty.pdf").write_bytes(b"")
    (landing / ".hidden.pdf").write_text("a hidden document")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{landing}")
    got = {r.name: (bytes(r.content) if r.content is not None else None, r.error) for r in files.scan_directory(spark, "viewfs://shelf/in", "abstract", most=100).collect()}
    hidden = got.pop(".hidden.pdf")
    assert hidden[0] is None and hidden[1]
    assert got == {"a.pdf": (b"first document", None), "b.PDF": (b"first document", None), "c.pdf": (b"short", None), "d.pdf": (b"bad file here", None), "e.pdf": (None, None), "empty.pdf": (b"", None)}
    deep = {r.path for r in files.scan_storage(spark, "viewfs://shelf/in").collect()}
    assert "viewfs://shelf/in/deep/g.pdf" in deep and len(deep) == 9


def test_compaction_keeps_readers_and_bounds_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cat, "MOST_COMMITS", 4)
    catalog = Catalog(spark, str(tmp_path))
    catalog.create()
    n = next(k for k in range(1000) if catalog_row(k)[5].startswith("00"))
    same = [k for k in range(20000) if catalog_row(k)[5].startswith("00")][:11]
    assert catalog.append(spark.createDataFrame([catalog_row(n)], CATALOG)) == []
    states = []
    for k in same[1:]:
        assert catalog.append(spark.createDataFrame([catalog_row(k)], CATALOG)) == []
        assert catalog.update_status(catalog_row(k)[0], "processing_failed")
        states.append(catalog.rows().groupBy("status").count().collect())
        shard = f"{catalog.path}/data/shard=00"
        assert all(len(os.listdir(f"{shard}/{g}")) <= 5 for g in os.listdir(shard)) and len(os.listdir(shard)) <= 2
    assert [{r.status: r["count"] for r in s} for s in states] == [{"ingested": 1, "processing_failed": k} for k in range(1, 11)]
    assert catalog.compact() == []
    assert catalog.check().count() == 0 and catalog.rows().count() == 11 and catalog.log().count() == 0
    found = catalog.find_by_hash(catalog_row(same[1])[5])
    assert found.count() == 1 and len(found.inputFiles()) == 1
    held = catalog.rows()
    assert catalog.compact() == [] and held.count() == 11  # planned before, read after


def test_metadata_in_the_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.create()
    given = ['{"source_type": "upload", "n": 1, "deep": {"a": [1, 2.5, "x", null, true]}}', '{"source_type": "local_file", "n": "1"}', '{"n": 2}']
    rows = [(*catalog_row(k)[:7], m, *catalog_row(k)[8:]) for k, m in enumerate(given)]
    assert catalog.append(spark.createDataFrame(rows, CATALOG)) == []
    for _ in range(2):
        assert {r.original_filename: json.loads(r.metadata) for r in catalog.rows().collect()} == {f"{k}.pdf": json.loads(m) for k, m in enumerate(given)}
        assert {r.original_filename for r in catalog.with_metadata("n", "1").collect()} == {"0.pdf", "1.pdf"}
        hot = catalog.with_metadata("source_type", "upload")
        assert [r.original_filename for r in hot.collect()] == ["0.pdf"] and "EqualTo(source_type,upload)" in hot._jdf.queryExecution().executedPlan().toString()
        assert catalog.compact() == []


def test_a_lookup_opens_as_few_files_in_a_large_catalog(spark, tmp_path, monkeypatch):
    """Files opened don't grow with the catalog, by hash or by id, and answers stay."""
    monkeypatch.setattr(cat, "FILE_ROWS", 3)
    catalog = Catalog(spark, str(tmp_path))
    catalog.create()
    rows = [r for r in map(catalog_row, range(3000)) if r[5].startswith("0")]
    assert catalog.append(spark.createDataFrame(rows[:100], CATALOG)) == [] and catalog.compact() == []
    catalog.bring_in(spark.createDataFrame(rows[60:], CATALOG))
    assert catalog.compact() == []
    assert len(catalog.rows().inputFiles()) > 80 and catalog.rows().count() == len(rows) and catalog.check().count() == 0
    for r in rows[::40]:
        for found in (catalog.find_by_hash(r[5]), catalog.find_by_id(r[0].upper())):
            assert len(found.inputFiles()) == 1 and [(f.id, f.hash, f.original_filename) for f in found.collect()] == [(r[0], r[5], r[1])]
    assert catalog.update_status(rows[7][0], "processing_failed") and catalog.find_by_id(rows[7][0]).first().status == "processing_failed"
    assert catalog.find_by_hash("ff" * 32).count() == 0


@pytest.mark.parametrize("together", [10_000, 3])
def test_pages(spark, monkeypatch, together):
    monkeypatch.setattr(cat, "MOST_TOGETHER", together)
    rows = [catalog_row(n, 1 + n % 3 if n < 60 else 9) for n in range(150)]
    df = spark.createDataFrame(rows, CATALOG)
    order = sorted((r[4], r[0]) for r in rows)
    for limit, offset in ((100, 0), (7, 0), (7, 13), (5, 70), (40, 55), (10, 145), (10, 150), (10, 500), (0, 3), (3, 149)):
        page = cat.page_of(df, limit, offset).collect()
        assert [(r.upload_date.replace(tzinfo=timezone.utc), r.id) for r in page] == order[offset : offset + limit]
        assert all((r.total, r.total_available) == (len(page), 150) for r in page)
    seen, last = [], (None, None)
    while page := cat.page_after(df, 40, *last).collect():
        seen += [r.id for r in page]
        last = page[-1].upload_date, page[-1].id
    assert seen == [i for _, i in order]


def test_a_batch_is_noted_and_taken_in_as_one(spark, place):
    landing, own, _ = place
    (landing / "deep/many.pdf").write_text("Abstract: one thing\fanother thing")
    got = {r.original_filename: r for r in routes.take_in(files.scan_directory(spark, str(landing / "deep"), "abstract"), own, reader).collect()}
    assert {n: (r.is_batch, r.status) for n, r in got.items()} == {"many.pdf": (True, "ingested"), "g.pdf": (False, "ingested")}


def test_routes_and_their_answers(spark, place, tmp_path):
    landing, own, _ = place
    up = routes.ingest_upload(spark, "u.pdf", b"first document", "abstract", own, reader=reader).first()
    assert up.success and up.document.original_filename == "u.pdf" and (up.message, up.source) == ("Document ingested successfully", "upload")
    local = routes.ingest_local(spark, str(landing / "a.pdf"), "abstract", own, reader=reader).first()
    assert local.document.is_duplicate and local.document.document_id == up.document.document_id and local.file_path == str(landing / "a.pdf")
    bad = routes.ingest_upload_batch(spark, "v.pdf", b"bad file", "abstract", own, reader=reader).first()
    assert (bad.total_processed, bad.failed, bad.errors) == (1, 1, ["Batch processing failed: Invalid or corrupted PDF file"])
    good = routes.ingest_local_batch(spark, str(landing / "deep/g.pdf"), "publication", own, reader=reader).first()
    assert (good.total_processed, good.successful, good.failed, good.duplicates, len(good.documents)) == (1, 1, 0, 0, 1)
    (tmp_path / "none").mkdir()
    answer, results = routes.ingest_directory(spark, str(tmp_path / "none"), "abstract", own, reader=reader)
    assert json.loads(answer.toJSON().first()) == {"message": "No PDF files found in directory", "directory": str(tmp_path / "none"), "files_processed": 0} and results.count() == 0


def test_extraction_reads_once_and_measures(spark, place, capsys, monkeypatch):
    landing, own, tmp = place
    made = []

    def make(options):
        made.append(options)
        return lambda content: pdf.Document(reader(content), {"producer": "stub", "pages": 99, "use_llm": None})

    pdf.register("stub", make)
    own = Settings(storage_dir=own.storage_dir, catalog_dir=own.catalog_dir, reader="stub", use_llm=True)
    found, measured = extract(routes.extract_inputs(spark, str(landing)), own, str(tmp / "x"))
    got = {r.path.rpartition("/")[2]: r for r in found.collect()}
    assert made[0]["use_llm"] is True and made[0]["output_format"] == "markdown" and len(got) == 5
    told = json.loads(got["a.pdf"].metadata)
    assert (told["producer"], told["pages"], told["processor"], told["use_llm"]) == ("stub", 1, "stub", True)
    assert got["d.pdf"].error == "ValueError: not a document" and got["d.pdf"].text is None and got["d.pdf"].metadata == "{}"
    counts = stats.extract_stats(found).first()
    assert measured == counts.asDict()
    assert (counts.successful, counts.failed) == (4, 1) and counts.total_time > 0 and counts.start_time == min(r.started for r in got.values())
    for name, value in (("DOCLOOM_READER", "stub"), ("CATALOG_DIR", own.catalog_dir)):
        monkeypatch.setenv(name, value)
    assert main(["extract", str(landing / "a.pdf"), str(tmp / "out")]) == 0
    assert f"Saved: {tmp}/out/a.md" in capsys.readouterr().out and json.loads((tmp / "out/a.json").read_text())["producer"] == "stub"
    assert main(["extract", str(landing), str(tmp / "out")]) == 1 and main(["extract", str(landing / "zz.pdf"), str(tmp / "out")]) == 1
    monkeypatch.setenv("STORAGE_DIR", own.storage_dir)
    capsys.readouterr()
    assert main(["ingest", "--file", str(landing / "a.pdf"), "--type", "abstract"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["message"] == "Document successfully ingested" and lines[1]["successful"] == 1
    with pytest.raises(ValueError):
        pdf.reader_of(Settings(reader="unheard of"))


def test_health(spark):
    from docloom.config import is_healthy

    assert is_healthy(spark) and Settings().session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_sources_refuse_what_they_should(spark, place):
    landing, _, _ = place
    for ask in (lambda: files.scan_directory(spark, str(landing / "none"), "abstract"), lambda: files.scan_directory(spark, str(landing / "a.pdf"), "abstract"), lambda: files.scan_file(spark, str(landing / "f.txt"), "abstract"), lambda: files.scan_file(spark, str(landing / "z.pdf"), "abstract"), lambda: files.scan_directory(spark, str(landing), "book"), lambda: files.uploads(spark, [("x.txt", b"")], "abstract")):
        with pytest.raises(files.SourceError):
            ask()
    assert files.uploads(spark, [("x.PDF", b"abc")], "abstract").first().length == 3
    listing = {r.name: (r.exists, r.pdf_count) for r in files.pdf_listing(spark, [("data", "in", str(landing)), ("data", "gone", str(landing / "gone"))]).collect()}
    assert listing == {"in": (True, 5), "gone": (False, 0)}


def test_batch_detection(spark):
    pages = {"single": ["Abstract: one"], "word": ["x", "Methods here"], "late": ["a b", "a b", "a b", "Methods"], "two": ["a", "b"], "differ": ["a b c", "d e f", "g"], "same": ["a b c", "a b c", "g"]}
    df = spark.createDataFrame([(k, n, t) for k, v in pages.items() for n, t in enumerate(v)], "path string, page_no int, text string")
    assert {r.path: r.is_batch for r in batch.is_batch(df).collect()} == {"single": False, "word": True, "late": False, "two": False, "differ": True, "same": False}
    blocks = df.select("path", "page_no", F.lit(0).alias("block_no"), F.lit("Text").alias("block_type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    assert {r.path: r.is_batch for r in batch.is_batch_layout(blocks).collect()} == {"single": False, "word": False, "late": False, "two": False, "differ": True, "same": False}


def test_page_text_and_headers(spark):
    rows = [("p", 0, 0, "Text", "First block text", None), ("p", 0, 1, "Text", None, "<p>Second block HTML</p>"), ("p", 1, 0, "PageHeader", None, "<h1> A <b>head</b></h1>"), ("p", 1, 1, "PageHeader", None, "Text that appears at the top of a page, like a page title."), ("p", 2, 0, "Text", None, "<p>LOUD WORDS</p><p>SHORT</p><p>quiet words</p>")]
    blocks = spark.createDataFrame(rows, "path string, page_no int, block_no int, block_type string, text string, html string").withColumn("error", F.lit(None).cast("string"))
    assert batch.page_texts(blocks).where("page_no = 0").first().text == "First block text Second block HTML"
    html = blocks.groupBy("path", "page_no").agg(F.max("html").alias("html"))
    text = headers.header_text(headers.page_headers(blocks, html)).first().header_text
    assert text == "\n--- Page 2 Header ---\nA head\n---\n\n\n--- Page 3 Header ---\nLOUD WORDS\n---\n\n"
    bad = spark.createDataFrame([("q", "boom")], "path string, error string")
    out = {r.path: r for r in extracted(blocks.unionByName(bad, allowMissingColumns=True), Settings()).collect()}
    assert out["p"].text.startswith(text + "\n\n{0}" + "-" * 48) and json.loads(out["p"].metadata)["pages"] == 3
    assert out["q"].text is None and out["q"].metadata == "{}" and out["q"].error == "boom"


def test_extract_sink_and_markdown(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "two"), ("d", 0, "one\n\nmore"), ("d", 2, None)], "path string, page_no int, text string")
    rendered = markdown.render_pages(pages, "path")
    write_extracts(rendered.select(F.lit("/in/d.pdf").alias("path"), F.col("markdown").alias("text"), F.lit('{"a" : 1}').alias("metadata")), str(tmp_path / "out"))
    back = markdown.split_pages(markdown.read_markdown(spark, str(tmp_path / "out/d.md")))
    assert [(r.page_no, r.text) for r in back.orderBy("page_no").collect()] == [(0, "one\n\nmore"), (1, "two"), (2, "")]
    assert json.loads((tmp_path / "out/d.json").read_text()) == {"a": 1}
    line = spark.createDataFrame([("# TPS1234 Poster Session, Fri, 8 AM\n\nx NCT01234567",), ("nothing",)], "text string")
    assert [tuple(r)[1:] for r in markdown.session_lines(line).collect()] == [("1234", True, "Poster Session, Fri, 8 AM", "NCT01234567"), ("", False, "", "")]


def test_split_markdown_gives_the_whole_text_s_pages(spark, tmp_path):
    rng = random.Random(8)
    parts = ["{", "}", "-", "-" * 47, "-" * 48, "-" * 49, "{1", "2}", "{12}", "\n", "é", "text ", "{3}" + "-" * 48, "{44}" + "-" * 50, "{99999999999}" + "-" * 48]
    for k in range(4):
        (tmp_path / f"{k}.md").write_text("".join(rng.choice(parts) for _ in range(400)) if k else "no mark at all", encoding="utf-8")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "other.txt").write_text("{0}" + "-" * 48)
    whole = [(m.start(), int(m[1])) for m in markdown.MARK.finditer((tmp_path / "1.md").read_bytes())]
    want = set()
    for name in ("0.md", "1.md", "2.md", "3.md"):
        data = (tmp_path / name).read_bytes()
        marks = list(markdown.MARK.finditer(data))
        want |= {(name, int(m[1]) if int(m[1]) < 1 << 31 else None, data[m.end() : n.start() if n else None].decode().strip("\n"), m.start()) for m, n in zip(marks, [*marks[1:], None][: len(marks)], strict=True)}
    for size in (1, 7, 50, 1 << 20):
        for name in ("0.md", "1.md", "2.md", "3.md") if size < 50 else ():
            data = (tmp_path / name).read_bytes()
            own = [(name, n if n < 1 << 31 else None, t.decode().strip("\n"), at) for a in range(0, len(data), size) for n, t, at in markdown.pages_in(io.BytesIO(data[a:]), a, min(a + size, len(data)))]
            assert len(own) == len(set(own)) and set(own) == {w for w in want if w[0] == name}
    for size in (500, 1 << 20):
        df = markdown.read_pages(spark, str(tmp_path), split_bytes=size)
        rows = [(r.path.rpartition("/")[2], r.page_no, r.text, r.start) for r in df.collect()]
        assert len(rows) == len(want) and set(rows) == want and len(whole) > 3
    assert markdown.read_pages(spark, str(tmp_path / "1.md"), split_bytes=100).rdd.getNumPartitions() > 10
    together = markdown.read_pages(spark, str(tmp_path), split_bytes=50, task_bytes=2000)
    assert {(r.path.rpartition("/")[2], r.page_no, r.text, r.start) for r in together.collect()} == want and together.count() == len(want) and together.rdd.getNumPartitions() < 30
    small = markdown.READ_BYTES
    try:
        markdown.READ_BYTES = 5
        data = (tmp_path / "2.md").read_bytes()
        assert [(at, n) for n, _, at in markdown.pages_in(io.BytesIO(data), 0, len(data))] == [(m.start(), int(m[1])) for m in markdown.MARK.finditer(data)]
    finally:
        markdown.READ_BYTES = small
    with pytest.raises(Exception, match="none.md"):
        markdown.read_pages(spark, str(tmp_path / "none.md")).count()


def landed(spark, landing, own, tmp, seen):
    check = lambda f: validity.valid_light(pdf.read_blocks(f, reader).where("error IS NULL"))
    ingest_landing(spark, str(landing), "abstract", own, str(tmp / "work"), check, lambda df, n: seen.append({r.path.rpartition("/")[2]: (r.message, r.is_duplicate) for r in df.collect()})).awaitTermination()


def test_landing_stream(spark, place):
    landing, own, tmp = place
    (landing / "empty.pdf").write_bytes(b"")
    (landing / ".hidden.pdf").write_text("a hidden document")
    seen = []
    landed(spark, landing, own, tmp, seen)
    assert seen[0] == {"empty.pdf": ("Processing failed: Invalid or corrupted PDF file", False), ".hidden.pdf": ("Document successfully ingested", False)}
    assert sorted(n for s in seen for n in s) == [".hidden.pdf", "a.pdf", "b.PDF", "c.pdf", "d.pdf", "e.pdf", "empty.pdf"]
    (landing / "h.pdf").write_text("first document")
    seen.clear()
    landed(spark, landing, own, tmp, seen)
    assert seen == [{"h.pdf": ("Document already exists", True)}]


def test_a_killed_batch_gives_the_same_answers(spark, place, monkeypatch):
    landing, own, tmp = place
    append, seen = Catalog.append, []

    def killed(self, rows, base=None):
        append(self, rows, base)
        raise RuntimeError("killed after the catalog was written")

    monkeypatch.setattr(Catalog, "append", killed)
    with pytest.raises(Exception, match="killed"):
        landed(spark, landing, own, tmp, seen)
    assert seen == [] and Catalog(spark, own.catalog_dir).rows().count() == 2
    monkeypatch.setattr(Catalog, "append", append)
    landed(spark, landing, own, tmp, seen)
    (got,) = seen
    assert got["a.pdf"] == ("Document successfully ingested", False) and got["b.PDF"] == ("Document already exists", True) and got["e.pdf"][0] == "Document successfully ingested"
    assert Catalog(spark, own.catalog_dir).rows().count() == 2 and Catalog(spark, own.catalog_dir).check().count() == 0


def test_summary_and_command_line(spark, capsys):
    rows = [("i", "a.pdf", "p", "abstract", "ingested", "m", False), ("i", "b.pdf", "p", "abstract", "ingested", "m", True), (None, "c.pdf", "", "abstract", "processing_failed", "why", False)]
    from docloom.schemas import RESPONSE

    s = stats.batch_summary(spark.createDataFrame(rows, RESPONSE), collect=True).first()
    assert (s.total_processed, s.successful, s.failed, s.duplicates, s.errors, len(s.documents)) == (3, 2, 1, 1, ["why"], 3)
    assert main(["info"]) == 0 and json.loads(capsys.readouterr().out)["name"] == "docloom"
    assert main(["ingest", "--file", "x.pdf", "--type", "abstract", "--metadata", "{bad"]) == 1
