"""Schemas of the catalog, of requests and responses, and of parsed documents."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = ("abstract", "publication")
INGESTED, FAILED = "ingested", "processing_failed"
STATUSES = (INGESTED, FAILED)

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    """A schema of plain columns; it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: One row per distinct content. ``hash`` is unique; ``metadata`` is a JSON object as text.
CATALOG = _schema(
    "id string, original_filename string, storage_path string, type string, upload_date timestamp, hash string, "
    "status string, metadata string, created_at timestamp, updated_at timestamp"
)
#: Keys of the metadata that are searched for: the catalog's files have them as columns beside the whole as VARIANT.
HOT_KEYS = ("source_type", "source_path")
STORED = T.StructType([*(T.StructField(f.name, T.VariantType() if f.name == "metadata" else f.dataType) for f in CATALOG.fields), *(T.StructField(k, T.StringType()) for k in HOT_KEYS)])
#: Append-only; the latest row of an id is its status.
STATUS_LOG = _schema("id string, status string, ts timestamp")
#: What the ingestion operators read; ``content`` may be left out where ``hash`` is there.
FILES = _schema("path string, name string, length long, content binary, type string, metadata string")
PAGES = _schema("path string, page_no int, text string, error string")
BLOCKS = _schema("path string, page_no int, block_no int, block_type string, text string, html string")
RESPONSE = _schema("document_id string, original_filename string, storage_path string, type string, status string, message string, is_duplicate boolean")

#: Longest values of text columns.
MOST_CHARACTERS = {"original_filename": 255, "storage_path": 500, "hash": 64}
