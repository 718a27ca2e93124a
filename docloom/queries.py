"""Driver queries of the ingestion operators over the test tables, with DuckDB SQL for each.

The tables hold no PDF files, so documents stand in for files: a document is a
file ``doc_<id>.pdf`` whose content is its text and whose pages are its lines;
English ones are publications, others abstracts; its source is its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions import metadata as meta
from docloom.functions import text as fn
from docloom.operators import batch, dedup, headers, stats, validity
from docloom.plans import catalog as cat
from docloom.plans import extract, ingest
from docloom.plans.storage import FileStore, PackStore, written
from docloom.sources import files as sources
from docloom.sources import markdown
from docloom.work import stored, work_dir

STORE = "/store"
#: The production limit, and one that many documents go over.
MOST_BYTES, SMALL = Settings().max_file_size, 3000
LAYOUT_KEYWORDS = ("the ", "Please")
KEYWORDS = ("License", "The ", "de la")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, with their hash; the content itself is needed no further."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf"))
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", F.lit("/landing"), "source", name).alias("path"), name.alias("name"), F.octet_length(text).cast("long").alias("length"),
        F.when(F.col("lang") == "en", "publication").otherwise("abstract").alias("type"),
        F.to_json(F.struct(F.col("lang"), F.col("source"))).alias("metadata"), F.sha2(text, 256).alias("hash"), text.alias("text"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))


def _catalog(files: DataFrame) -> DataFrame:
    """A catalog as left by a run over the publications."""
    first = dedup.first_wins(files.where("type = 'publication'"), "path").where("is_first")
    return first.select(
        ingest.document_id(F.col("hash")).alias("id"), F.col("name").alias("original_filename"), F.concat_ws("/", F.lit(STORE), fn.storage_folder(F.col("type")), F.concat_ws("_", "hash", "name")).alias("storage_path"),
        "type", F.lit("ingested").alias("status"), "hash",
    )


def content_hash(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", "hash", F.substring("hash", 1, 8).alias("hash_prefix"))


def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(_files(spark, sf_dir)).select("doc_id", "hash", "is_first", F.col("first").alias("first_path"))


def dedup_vs_catalog(spark, sf_dir):
    files = _files(spark, sf_dir)
    found = dedup.against_catalog(files, _catalog(files))
    return found.select("doc_id", F.col("known").isNotNull().alias("is_known"), F.col("known.id").alias("known_id"), F.col("known.original_filename").alias("known_name"), F.col("known.type").alias("known_type"))


def new_documents(spark, sf_dir):
    files = _files(spark, sf_dir)
    return dedup.unknown_only(files, _catalog(files)).select("doc_id", "hash")


def orphan_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    stored = files.select(F.concat_ws("/", F.lit(STORE), fn.storage_folder(F.col("type")), F.concat_ws("_", "hash", "name")).alias("path"), "length")
    return dedup.orphans(stored, _catalog(files))


def valid_files(spark, sf_dir):
    return validity.valid_light(_lines(spark, sf_dir))


def valid_layout(spark, sf_dir):
    """Conversations as files, each fifth without pages."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 5 != 0, F.col("turn")).alias("page_no"))
    return validity.valid_layout(turns, "conv_id")


def size_check(spark, sf_dir):
    """The size check's message of every document under a small limit; null if it passes."""
    length = F.col("length")
    return _files(spark, sf_dir).select("doc_id", F.when(validity.too_large(length, SMALL), validity.size_message(length, SMALL)).alias("message"))


def _outcome(spark, sf_dir):
    files = _files(spark, sf_dir)
    seen = ingest.checked(files, validity.valid_light(_lines(spark, sf_dir)), MOST_BYTES)
    return ingest.resolved(seen, _catalog(files.where(F.col("length") <= MOST_BYTES)), FileStore(spark, STORE).path())


def ingest_responses(spark, sf_dir):
    return _outcome(spark, sf_dir).select("path", "document_id", "original_filename", "storage_path", "type", "status", "message", "is_duplicate")


def batch_summary(spark, sf_dir):
    return stats.batch_summary(_outcome(spark, sf_dir))


def _with_errors(spark, sf_dir):
    """Outcomes of which every tenth stands for one that an exception ended."""
    return _outcome(spark, sf_dir).drop("error").withColumn("error", F.when(F.col("path").endswith("7.pdf"), "OSError: unreadable"))


def directory_summary(spark, sf_dir):
    return stats.directory_summary(_with_errors(spark, sf_dir))


def directory_results(spark, sf_dir):
    found = stats.directory_results(_with_errors(spark, sf_dir))
    return found.select("file", "success", F.col("response.document_id").alias("document_id"), F.col("response.message").alias("message"), "error")


def directory_answer(spark, sf_dir):
    return stats.directory_answer(stats.directory_results(_with_errors(spark, sf_dir)), "/landing")


def storage_stats(spark, sf_dir):
    return stats.storage_stats(_files(spark, sf_dir).select("path", "length"))


def service_stats(spark, sf_dir):
    own = stats.service_stats(_files(spark, sf_dir).select("path", "length"), 100 * 1024 * 1024, 3)
    return own.select("storage.*", "max_file_size_mb", "retry_attempts")


def pdf_count_by_folder(spark, sf_dir):
    files = _files(spark, sf_dir).select(F.element_at(F.split("path", "/"), -2).alias("folder"))
    folders = files.distinct().unionByName(spark.createDataFrame([("empty",)], "folder string"))
    return stats.counts_by_folder(files, folders)


def folder_preview(spark, sf_dir):
    files = _files(spark, sf_dir).select(F.element_at(F.split("path", "/"), -2).alias("folder"), "name")
    return stats.preview(files, "folder", "name")


def _dated(spark, sf_dir):
    own = _catalog(_files(spark, sf_dir))
    return own.withColumn("upload_date", F.timestamp_seconds(F.conv(F.substring("hash", 1, 6), 16, 10).cast("long")))


def list_documents(spark, sf_dir):
    return cat.page_of(_dated(spark, sf_dir), 100, 50).select("id", "original_filename", "total", "total_available")


def find_by_hash(spark, sf_dir):
    own = _catalog(_files(spark, sf_dir))
    return cat.by_hash(own, own.agg(F.min("hash")).first()[0]).select("id", "hash", "original_filename")


def find_by_id(spark, sf_dir):
    """Every row by its id, spelled as a URN in capitals."""
    own = _catalog(_files(spark, sf_dir))
    asked = own.select(F.concat(F.lit("URN:UUID:{"), F.upper("id"), F.lit("}")).alias("asked"))
    return asked.withColumn("id", fn.normalised_uuid(F.col("asked"))).join(own, "id").select("asked", "id", "original_filename")


def latest_status(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts", "event_id")
    return dedup.latest_status(log, "event_id")


def metadata_extract(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", meta.is_object(F.col("props")).alias("is_object"), meta.field(F.col("props"), "k", "int").alias("k"))


def metadata_merge(spark, sf_dir):
    """A key of the left object alone (k), one of the right alone (user), and one of both (kind)."""
    left = meta.merged(F.col("props"), F.to_json(F.struct(F.upper("event_type").alias("kind"))))
    own = meta.merged(left, F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))))
    return _table(spark, sf_dir, "events").select("event_id", meta.field(own, "k", "int").alias("k"), meta.field(own, "kind").alias("kind"), meta.field(own, "user", "long").alias("user"))


def metadata_variant(spark, sf_dir):
    """The merge of ``metadata_merge`` on VARIANT values, and the types that they keep."""
    left = meta.merged_variants(meta.variant(F.col("props")), F.to_variant_object(F.struct(F.upper("event_type").alias("kind"))))
    own = meta.merged_variants(left, F.to_variant_object(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))))
    rows = _table(spark, sf_dir, "events").select("event_id", own.alias("own"))
    return rows.select("event_id", F.variant_get("own", "$.k", "int").alias("k"), F.variant_get("own", "$.kind", "string").alias("kind"), F.variant_get("own", "$.user", "long").alias("user"), F.schema_of_variant(F.variant_get("own", "$.user", "variant")).alias("user_type"))


def metadata_or_empty(spark, sf_dir):
    """Metadata that is an object, missing, or an array."""
    given = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "[1]")
    return _table(spark, sf_dir, "events").select("event_id", meta.parsed(given).alias("metadata"), meta.metadata_error(given).alias("error"))


def is_batch(spark, sf_dir):
    return batch.is_batch(_lines(spark, sf_dir), "path", KEYWORDS)


def is_batch_standard(spark, sf_dir):
    return batch.is_batch(_lines(spark, sf_dir))


def _blocks(spark, sf_dir):
    """Conversations as files of a header and of pages with one block each, text or markup; each tenth can't be read."""
    turns = _table(spark, sf_dir, "conversations").withColumn("bad", F.col("conv_id") % 10 == 7)
    header = F.struct(F.lit(0).alias("block_no"), F.lit("PageHeader").alias("block_type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("<h1>Conversation "), F.col("conv_id").cast("string"), F.lit("</h1>")).alias("html"))
    body = F.struct(F.lit(1).alias("block_no"), F.lit("Text").alias("block_type"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.concat(F.lit("<p> "), "text", F.lit(" </p>")).alias("html"))
    blocks = turns.where("NOT bad").select("conv_id", F.col("turn").cast("int").alias("page_no"), F.explode(F.when(F.col("turn") == 0, F.array(header, body)).otherwise(F.array(body))).alias("b")).select("conv_id", "page_no", "b.*")
    failed = turns.where("bad").select("conv_id", F.lit("ValueError: unreadable").alias("error")).distinct()
    told = F.when((F.col("page_no") == 0) & (F.col("block_no") == 0), F.to_json(F.struct(F.lit("a reader").alias("producer"), F.lit("none").alias("processor"))))
    return blocks.withColumn("metadata", told).unionByName(failed, allowMissingColumns=True).withColumns({"path": F.col("conv_id").cast("string"), "started": F.col("conv_id").cast("double"), "elapsed": F.lit(0.5)})


def extracts(spark, sf_dir):
    found = extract.extracted(_blocks(spark, sf_dir), Settings())
    return found.select("path", "text", "error", *(meta.field(F.col("metadata"), name).alias(name) for name in ("pages", "processor", "producer")))


def extract_stats(spark, sf_dir):
    return stats.extract_stats(extract.extracted(_blocks(spark, sf_dir), Settings()))


def is_batch_layout(spark, sf_dir):
    return batch.is_batch_layout(_blocks(spark, sf_dir).where("error IS NULL"), keywords=LAYOUT_KEYWORDS)


def page_difference(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("page_no"), "text")
    return batch.is_batch(turns, "conv_id", ())


def turn_similarity(spark, sf_dir):
    """Each turn's similarity with the first one of its conversation."""
    turns = _table(spark, sf_dir, "conversations")
    opening = turns.where("turn = 0").select("conv_id", F.substring("text", 1, 200).alias("opening"))
    own = fn.jaccard(fn.first_words(F.substring("text", 1, 200)), fn.first_words(F.col("opening")))
    return turns.join(opening, "conv_id").select("conv_id", "turn", F.round(own, 9).alias("similarity"))


def page_counts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_no"))
    return validity.page_counts(turns, "conv_id")


def strip_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.strip_html(F.col("html")).alias("text"))


def _page_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("page_no"), "html")


def _no_blocks(spark):
    return spark.createDataFrame([], "page_id long, page_no int, block_no int, block_type string, html string")


def _heading_blocks(spark, sf_dir):
    """Headings of level one as header blocks."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit("<h1>(.*?)</h1>"), F.lit(1))).alias("block_no", "html")
    return _page_html(spark, sf_dir).select("page_id", "page_no", found).withColumn("block_type", F.lit("PageHeader"))


def page_headers(spark, sf_dir):
    """The fallback: paragraphs in capitals."""
    found = headers.page_headers(_no_blocks(spark), _page_html(spark, sf_dir), "page_id")
    return found.select("page_id", F.posexplode("headers").alias("n", "header"))


def header_text(spark, sf_dir):
    found = headers.page_headers(_heading_blocks(spark, sf_dir), _page_html(spark, sf_dir), "page_id")
    return headers.header_text(found, "page_id")


def block_text(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    blocks = turns.select("conv_id", F.lit(0).alias("page_no"), F.col("turn").alias("block_no"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.concat(F.lit("<p> "), "text", F.lit(" </p>")).alias("html"))
    return batch.page_texts(blocks, "conv_id").select("conv_id", "text")


def paginated_split(spark, sf_dir):
    """Conversations as paginated markdown, split again."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("page_no"), "text")
    return markdown.split_pages(markdown.render_pages(turns, "conv_id")).select("conv_id", "page_no", "text")


def _contents(spark, sf_dir):
    return _files(spark, sf_dir).withColumn("content", F.col("text").cast("binary"))


def ingest_run(spark, sf_dir):
    """Publications are taken in, then all documents: contents checked, packed and catalogued, and the second run's answers."""
    at = work_dir(spark)
    own = Settings(storage_dir=f"{at}/storage", catalog_dir=f"{at}/catalog", packed=True, storage_mounted=True)
    files, valid = _contents(spark, sf_dir), validity.valid_light(_lines(spark, sf_dir))
    ingest.ingest(spark, files.where("type = 'publication'"), valid, own, f"{at}/first")
    return ingest.ingest(spark, files, valid, own, f"{at}/second").select("path", "document_id", "original_filename", "type", "status", "message", "is_duplicate")


def catalog_round_trip(spark, sf_dir):
    """All documents in two commits, the second against versions that the first has overtaken; statuses logged, and all compacted."""
    catalog = cat.Catalog(spark, work_dir(spark))
    catalog.create()
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    firsts = dedup.first_wins(_files(spark, sf_dir), "path").where("is_first")
    dated = {c: at for c in ("upload_date", "created_at", "updated_at")}
    rows = firsts.select(ingest.document_id(F.col("hash")).alias("id"), F.col("name").alias("original_filename"), F.lit("/s").alias("storage_path"), "type", "hash", F.lit("ingested").alias("status"), "metadata").withColumns(dated)
    before = catalog.heads()
    catalog.append(rows.where("type = 'publication'"), before)
    lost = catalog.append(rows, before)
    catalog.bring_in(rows.where(cat.shard_of(F.col("hash")).isin(lost)))
    catalog.log_statuses(rows.where("hash < '4'").select("id", F.lit("processing_failed").alias("status"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("ts")))
    catalog.compact()
    return catalog.rows().select("id", "hash", "original_filename", "type", "status")


def packed_round_trip(spark, sf_dir):
    """All contents packed and read again by ranges."""
    store = PackStore(spark, f"{(at := work_dir(spark))}/storage", mounted=True)
    store.bootstrap()
    files = _contents(spark, sf_dir)
    store.write(files.dropDuplicates(["hash"]).select("hash", "content"), at)
    back = store.read(files).select("hash", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("found"))
    return files.select("doc_id", "hash").join(back, "hash").select("doc_id", "length", "found")


def _filed(spark, sf_dir):
    """Every content as a file of a store; the store's folder. One that couldn't be written is an error: a listing would lack it unseen."""
    store = FileStore(spark, f"{(at := work_dir(spark))}/storage", mounted=True)
    store.bootstrap()
    files = _contents(spark, sf_dir).dropDuplicates(["hash"])
    done = store.write(files.withColumn("name", F.lit("x.pdf")).withColumn("type", F.lit("abstract")).withColumn("storage_path", store.path()).select("hash", "storage_path", "content"), at)
    if lost := done.where("error IS NOT NULL").first():
        raise OSError(f"{lost.hash} was not written: {lost.error}")
    return store.base


def storage_scan(spark, sf_dir):
    """Stored files as a listing finds them, empty ones too."""
    return sources.scan_storage(spark, _filed(spark, sf_dir)).select(fn.basename(F.col("path")).alias("name"), "length")


def folder_scan(spark, sf_dir):
    """Stored files as a folder's scan reads them."""
    found = sources.scan_directory(spark, _filed(spark, sf_dir), "abstract", recursive=True)
    return found.select("name", "length", F.sha2("content", 256).alias("hash"), meta.field(F.col("metadata"), "source_type").alias("source_type"), "error")


def dedup_vs_repeated_catalog(spark, sf_dir):
    """A catalog that has every hash twice gives every file one answer still."""
    files = _files(spark, sf_dir)
    own = _catalog(files)
    found = dedup.against_catalog(files, own.unionByName(own.withColumn("id", F.concat(F.lit("0"), "id")).withColumn("original_filename", F.lit("other"))))
    return found.select("doc_id", F.col("known.id").alias("known_id"), F.col("known.original_filename").alias("known_name"))


def list_after(spark, sf_dir):
    """The page after the 20th row, by its key."""
    rows = _dated(spark, sf_dir)
    last = cat.page_of(rows, 1, 19).first()
    return cat.page_after(rows, 100, last.upload_date if last else None, last.id if last else None).select("id", "original_filename")


def paginated_ranges(spark, sf_dir):
    """Conversations as files of paginated markdown, read by ranges of 1,000 bytes."""
    at = work_dir(spark)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("page_no"), "text")
    texts = markdown.render_pages(turns, "conv_id").select(F.concat(F.lit(f"{at}/md/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("storage_path"), F.col("markdown").cast("binary").alias("content"))
    stored(written(texts), f"{at}/written")
    pages = markdown.read_pages(spark, f"{at}/md", split_bytes=1000, task_bytes=100_000)
    return pages.select(fn.stem(F.col("path")).cast("long").alias("conv_id"), "page_no", "text")


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, dedup_first_wins, dedup_vs_catalog, new_documents, orphan_files, valid_files, valid_layout, size_check, directory_results, directory_answer, metadata_or_empty, extracts, extract_stats, is_batch_layout, ingest_responses, batch_summary, directory_summary,
        storage_stats, service_stats, pdf_count_by_folder, folder_preview, list_documents, find_by_hash, find_by_id, latest_status, metadata_extract,
        metadata_merge, is_batch, is_batch_standard, page_difference, turn_similarity, page_counts, strip_html, page_headers, header_text, block_text, paginated_split,
        ingest_run, catalog_round_trip, packed_round_trip, storage_scan, folder_scan, dedup_vs_repeated_catalog, list_after, paginated_ranges, metadata_variant,
    )
}

_WS = fn.WHITE_SPACE
FILES = f"""files AS (SELECT doc_id, '/landing/' || source || '/doc_' || lpad(doc_id::VARCHAR, 12, '0') || '.pdf' AS path, 'doc_' || lpad(doc_id::VARCHAR, 12, '0') || '.pdf' AS name,
  octet_length(encode(coalesce(text, '')))::BIGINT AS length, CASE WHEN lang = 'en' THEN 'publication' ELSE 'abstract' END AS type, source, sha256(coalesce(text, '')) AS hash, coalesce(text, '') AS text FROM documents)"""


def _uuid(h: str) -> str:
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def _stored(alias: str = "") -> str:
    return f"'{STORE}/' || CASE WHEN {alias}type = 'abstract' THEN 'abstracts' ELSE 'publications' END || '/' || {alias}hash || '_' || {alias}name"


def _catalog_sql(where: str = "true") -> str:
    return f"""catalog AS (SELECT {_uuid('hash')} AS id, name AS original_filename, {_stored()} AS storage_path, type, 'ingested' AS status, hash FROM files
  WHERE type = 'publication' AND {where} QUALIFY row_number() OVER (PARTITION BY hash ORDER BY path) = 1)"""


def _set(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[{_WS}]+'), lambda w: w <> '')[1:50])"


def _similarity(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _batch_sql(source: str, key: str, keywords: tuple[str, ...], searched: str = "text") -> str:
    any_of = " OR ".join(f"contains({searched}, '{k}')" for k in keywords) or "false"
    return f"""heads AS (SELECT {key}, count(*) AS pages, coalesce(bool_or(page_no < 3 AND ({any_of})), false) AS keyword,
  {_set("substr(coalesce(max(text) FILTER (page_no = 0), ''), 1, 200)")} AS a, {_set("substr(coalesce(max(text) FILTER (page_no = 1), ''), 1, 200)")} AS b FROM {source} GROUP BY {key})
SELECT {key}, pages, CASE WHEN pages <= 1 THEN false WHEN keyword THEN true WHEN pages > 2 THEN len(a) = 0 OR len(b) = 0 OR {_similarity('a', 'b')} < 0.3 ELSE false END AS is_batch FROM heads"""


LINES = "lines AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no FROM files)"
VALID = f"valid AS (SELECT path, coalesce(length(trim(max(text) FILTER (page_no = 0), '{_WS}')) >= 10, false) AS valid FROM lines GROUP BY path)"
OUTCOME = f"""{FILES}, {LINES}, {VALID}, {_catalog_sql(f"length <= {MOST_BYTES}")},
checked AS (SELECT f.*, 'Processing failed: ' || CASE WHEN length > {MOST_BYTES} THEN 'File size ' || length || ' bytes exceeds maximum {MOST_BYTES} bytes'
  WHEN NOT valid THEN 'Invalid or corrupted PDF file' END AS failure FROM files f JOIN valid USING (path)),
good AS (SELECT *, first_value(path) OVER w AS first, first_value(name) OVER w AS first_name, first_value(type) OVER w AS first_type FROM checked WHERE failure IS NULL WINDOW w AS (PARTITION BY hash ORDER BY path)),
outcome AS (SELECT g.path, coalesce(c.id, {_uuid('g.hash')}) AS document_id, coalesce(c.original_filename, first_name) AS original_filename,
  coalesce(c.storage_path, '{STORE}/' || CASE WHEN first_type = 'abstract' THEN 'abstracts' ELSE 'publications' END || '/' || g.hash || '_' || first_name) AS storage_path, coalesce(c.type, first_type) AS type, 'ingested' AS status,
  CASE WHEN c.id IS NULL AND g.path = first THEN 'Document successfully ingested' ELSE 'Document already exists' END AS message, NOT (c.id IS NULL AND g.path = first) AS is_duplicate FROM good g LEFT JOIN catalog c USING (hash)
UNION ALL SELECT path, NULL, name, '', type, 'processing_failed', failure, false FROM checked WHERE failure IS NOT NULL)"""
STORAGE = "count(*) AS total_files, coalesce(sum(length), 0)::BIGINT AS total_size_bytes, round_even(coalesce(sum(length), 0)::BIGINT / 1048576, 2) AS total_size_mb"
CAPITALS = f"""(SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<p>([^<]+)</p>', 1), lambda p: trim(p, '{_WS}')), lambda p: length(p) > 5 AND upper(p) = p AND lower(p) <> p) AS headers FROM pages)"""
BARE = f"trim(regexp_replace({{}}, '<[^>]+>', '', 'g'), '{_WS}')"
BLOCKS = f"""pages AS (SELECT conv_id, conv_id::VARCHAR AS path, turn AS page_no, CASE WHEN turn % 2 = 0 THEN text END AS own, coalesce(CASE WHEN turn = 0 THEN 'Conversation ' || conv_id || ' ' ELSE '' END
  || CASE WHEN turn % 2 = 0 AND text <> '' THEN trim(text, '{_WS}') ELSE nullif({BARE.format("'<p> ' || text || ' </p>'")}, '') END, CASE WHEN turn = 0 THEN 'Conversation ' || conv_id ELSE '' END) AS text FROM conversations)"""
EXTRACTS = f"""WITH {BLOCKS}, extracted AS (SELECT path, CASE WHEN conv_id % 10 <> 7 THEN CASE WHEN min(page_no) = 0 THEN chr(10) || '--- Page 1 Header ---' || chr(10) || 'Conversation ' || conv_id || chr(10) || '---' || chr(10) || chr(10) || chr(10) || chr(10) ELSE '' END
  || string_agg('{{' || page_no || '}}' || repeat('-', 48) || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY page_no) END AS text, count(*) AS pages, CASE WHEN conv_id % 10 = 7 THEN 'ValueError: unreadable' END AS error FROM pages GROUP BY conv_id, path)"""

ORACLES = {
    "content_hash": f"WITH {FILES} SELECT doc_id, hash, substr(hash, 1, 8) AS hash_prefix FROM files",
    "dedup_first_wins": f"WITH {FILES}, led AS (SELECT *, min(path) OVER (PARTITION BY hash) AS first_path FROM files) SELECT doc_id, hash, path = first_path AS is_first, first_path FROM led",
    "dedup_vs_catalog": f"WITH {FILES}, {_catalog_sql()} SELECT doc_id, c.id IS NOT NULL AS is_known, c.id AS known_id, c.original_filename AS known_name, c.type AS known_type FROM files LEFT JOIN catalog c USING (hash)",
    "new_documents": f"WITH {FILES}, {_catalog_sql()} SELECT doc_id, hash FROM files ANTI JOIN catalog USING (hash)",
    "orphan_files": f"WITH {FILES}, {_catalog_sql()} SELECT {_stored()} AS path, length FROM files WHERE {_stored()} NOT IN (SELECT storage_path FROM catalog)",
    "valid_files": f"WITH {FILES}, {LINES}, {VALID} SELECT path, valid FROM valid",
    "ingest_responses": f"WITH {OUTCOME} SELECT * FROM outcome",
    "batch_summary": f"WITH {OUTCOME} SELECT count(*) AS total_processed, count_if(status = 'ingested')::BIGINT AS successful, count_if(status = 'processing_failed')::BIGINT AS failed, count_if(is_duplicate)::BIGINT AS duplicates FROM outcome",
    "valid_layout": "SELECT conv_id, conv_id % 5 <> 0 AS valid FROM conversations GROUP BY conv_id",
    "size_check": f"WITH {FILES} SELECT doc_id, CASE WHEN length > {SMALL} THEN 'File size ' || length || ' bytes exceeds maximum {SMALL} bytes' END AS message FROM files",
    "directory_results": f"WITH {OUTCOME} SELECT path AS file, path NOT LIKE '%7.pdf' AS success, CASE WHEN path NOT LIKE '%7.pdf' THEN document_id END AS document_id, CASE WHEN path NOT LIKE '%7.pdf' THEN message END AS message, CASE WHEN path LIKE '%7.pdf' THEN 'OSError: unreadable' END AS error FROM outcome",
    "directory_answer": f"WITH {OUTCOME} SELECT 'Directory processing complete' AS message, '/landing' AS directory, count(*) AS total_files, count_if(path NOT LIKE '%7.pdf')::BIGINT AS successful, count_if(path LIKE '%7.pdf')::BIGINT AS failed, NULL::BIGINT AS files_processed FROM outcome",
    "extracts": f"""{EXTRACTS} SELECT path, text, error, CASE WHEN error IS NULL THEN pages::VARCHAR END AS pages, CASE WHEN error IS NULL THEN 'layout' END AS processor, CASE WHEN error IS NULL THEN 'a reader' END AS producer FROM extracted""",
    "extract_stats": f"""{EXTRACTS} SELECT count_if(error IS NULL)::BIGINT AS successful, count_if(error IS NOT NULL)::BIGINT AS failed, sum(0.5)::DOUBLE AS total_time, min(path::BIGINT)::DOUBLE AS start_time FROM extracted""",
    "is_batch_layout": f"""WITH {BLOCKS}, good AS (SELECT path, page_no, own, text FROM pages WHERE conv_id % 10 <> 7), {_batch_sql('good', 'path', LAYOUT_KEYWORDS, "coalesce(own, '')")}""",
    "metadata_or_empty": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND json_type(props) = 'OBJECT' THEN props ELSE '{}' END AS metadata, CASE WHEN event_id % 3 = 1 THEN 'metadata is not an object' END AS error FROM events",
    "directory_summary": f"WITH {OUTCOME} SELECT count(*) AS total_files, count_if(path NOT LIKE '%7.pdf')::BIGINT AS successful, count_if(path LIKE '%7.pdf')::BIGINT AS failed, count_if(status = 'ingested')::BIGINT AS ingested, count_if(status = 'processing_failed')::BIGINT AS processing_failed FROM outcome",
    "storage_stats": f"WITH {FILES} SELECT {STORAGE} FROM files",
    "service_stats": f"WITH {FILES} SELECT {STORAGE}, 100::BIGINT AS max_file_size_mb, 3 AS retry_attempts FROM files",
    "pdf_count_by_folder": f"WITH {FILES}, seen AS (SELECT source AS folder, count(*) AS n FROM files GROUP BY source) SELECT folder, true AS exists, n AS pdf_count FROM seen UNION ALL SELECT 'empty', false, 0",
    "folder_preview": f"WITH {FILES}, ranked AS (SELECT source AS folder, name, row_number() OVER (PARTITION BY source ORDER BY name) AS place, count(*) OVER (PARTITION BY source) AS total FROM files) SELECT folder, string_agg(name, ', ' ORDER BY name) || CASE WHEN max(total) > 3 THEN '...' ELSE '' END AS preview, max(total) AS total FROM ranked WHERE place <= 3 GROUP BY folder",
    "list_documents": f"WITH {FILES}, {_catalog_sql()}, page AS (SELECT * FROM catalog ORDER BY ('0x' || substr(hash, 1, 6))::BIGINT, id LIMIT 100 OFFSET 50) SELECT id, original_filename, (SELECT count(*) FROM page) AS total, (SELECT count(*) FROM catalog) AS total_available FROM page",
    "find_by_hash": f"WITH {FILES}, {_catalog_sql()} SELECT id, hash, original_filename FROM catalog WHERE hash = (SELECT min(hash) FROM catalog)",
    "find_by_id": f"WITH {FILES}, {_catalog_sql()} SELECT 'URN:UUID:{{' || upper(id) || '}}' AS asked, id, original_filename FROM catalog",
    "latest_status": "SELECT user_id AS id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "metadata_extract": "SELECT event_id, json_type(props) = 'OBJECT' AS is_object, json_extract_string(props, '$.k')::INT AS k FROM events",
    "metadata_merge": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, event_type AS kind, user_id AS user FROM events",
    "metadata_variant": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, event_type AS kind, user_id AS user, 'BIGINT' AS user_type FROM events",
    "is_batch": f"WITH {FILES}, {LINES}, {_batch_sql('lines', 'path', KEYWORDS)}",
    "is_batch_standard": f"WITH {FILES}, {LINES}, {_batch_sql('lines', 'path', batch.BATCH_KEYWORDS)}",
    "page_difference": f"WITH turns AS (SELECT conv_id, turn AS page_no, text FROM conversations), {_batch_sql('turns', 'conv_id', ())}",
    "turn_similarity": f"WITH sets AS (SELECT c.conv_id, c.turn, {_set('substr(c.text, 1, 200)')} AS a, {_set('substr(o.text, 1, 200)')} AS b FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = 0) SELECT conv_id, turn, round({_similarity('a', 'b')}, 9) AS similarity FROM sets",
    "page_counts": "SELECT conv_id, count(DISTINCT turn) AS pages FROM conversations GROUP BY conv_id",
    "strip_html": f"SELECT page_id, {BARE.format('html')} AS text FROM pages",
    "page_headers": f"SELECT page_id, unnest(headers) AS header, (generate_subscripts(headers, 1) - 1)::INT AS n FROM {CAPITALS}",
    "header_text": f"""WITH own AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<h1>(.*?)</h1>', 1), lambda h: {BARE.format('h')}), lambda h: h <> '' AND h <> '{fn.SENTINEL}') AS own, headers AS spare FROM pages JOIN {CAPITALS} USING (page_id)),
both_ AS (SELECT page_id, CASE WHEN len(own) > 0 THEN own ELSE spare END AS headers FROM own)
SELECT page_id, chr(10) || '--- Page 1 Header ---' || chr(10) || array_to_string(headers, chr(10)) || chr(10) || '---' || chr(10) || chr(10) AS header_text FROM both_ WHERE len(headers) > 0""",
    "block_text": f"""WITH blocks AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND text <> '' THEN trim(text, '{_WS}') ELSE nullif({BARE.format("'<p> ' || text || ' </p>'")}, '') END AS t FROM conversations) SELECT conv_id, coalesce(string_agg(t, ' ' ORDER BY turn), '') AS text FROM blocks GROUP BY conv_id""",
    "ingest_run": f"WITH {OUTCOME} SELECT path, document_id, original_filename, type, status, message, is_duplicate FROM outcome",
    "catalog_round_trip": f"WITH {FILES}, firsts AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY hash ORDER BY path) = 1) SELECT {_uuid('hash')} AS id, hash, name AS original_filename, type, CASE WHEN hash < '4' THEN 'processing_failed' ELSE 'ingested' END AS status FROM firsts",
    "packed_round_trip": f"WITH {FILES} SELECT doc_id, length, hash AS found FROM files",
    "storage_scan": f"WITH {FILES} SELECT DISTINCT hash || '_x.pdf' AS name, length FROM files",
    "folder_scan": f"WITH {FILES} SELECT DISTINCT hash || '_x.pdf' AS name, length, hash, 'directory_scan' AS source_type, NULL::VARCHAR AS error FROM files",
    "dedup_vs_repeated_catalog": f"WITH {FILES}, {_catalog_sql()} SELECT doc_id, CASE WHEN '0' || c.id < c.id THEN '0' || c.id ELSE c.id END AS known_id, CASE WHEN '0' || c.id < c.id THEN 'other' ELSE c.original_filename END AS known_name FROM files LEFT JOIN catalog c USING (hash)",
    "list_after": f"WITH {FILES}, {_catalog_sql()} SELECT id, original_filename FROM catalog ORDER BY ('0x' || substr(hash, 1, 6))::BIGINT, id LIMIT 100 OFFSET 20",
    "paginated_ranges": "SELECT conv_id, turn::INT AS page_no, trim(coalesce(text, ''), chr(10)) AS text FROM conversations",
    "paginated_split": "SELECT conv_id, turn::INT AS page_no, trim(coalesce(text, ''), chr(10)) AS text FROM conversations",
}
