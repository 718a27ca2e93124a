"""PDF readers as plug-ins: a reader turns bytes into pages, Spark spreads the files.

A reader is any function from a file's bytes to pages, each a list of
(block_type, text, html) blocks, or to a ``Document`` of pages and metadata. It is
registered by a name with a function that makes it of options. No PDF library is needed by anything else; if
``pypdf`` is installed, ``light`` reads with it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings

Block = tuple[str, str | None, str | None]


@dataclass
class Document:
    pages: list[list[Block]]
    metadata: dict[str, Any] = field(default_factory=dict)


Reader = Callable[[bytes], list[list[Block]] | Document]
SCHEMA = "path string, page_no int, block_no int, block_type string, text string, html string, error string, metadata string, started double, elapsed double"
READERS: dict[str, Callable[[Mapping[str, Any]], Reader]] = {}


def register(name: str, make: Callable[[Mapping[str, Any]], Reader]) -> None:
    READERS[name] = make


def reader_of(settings: Settings) -> Reader:
    """The reader that the settings name, made with their options."""
    if settings.reader not in READERS:
        raise ValueError(f"no reader is registered as {settings.reader}")
    return READERS[settings.reader](settings.extractor_options())


def light(content: bytes) -> list[list[Block]]:
    """One text block per page."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        from PyPDF2 import PdfReader

    return [[("Text", page.extract_text(), None)] for page in PdfReader(io.BytesIO(content)).pages]


register("light", lambda options: light)


def read_blocks(files: DataFrame, reader: str | Reader = "light") -> DataFrame:
    """Blocks of (path, content) and maybe error, pages and blocks from 0. A page without blocks is one row of null block_no.

    The first row of a file bears the reader's metadata (JSON), when it was
    started (Unix time) and how many seconds it took. A file that the reader fails
    on is one row with its ``error``, and so is one that comes with an error; it never fails the job. Store the result
    before using it twice: each use reads anew.
    """
    read = READERS[reader]({}) if isinstance(reader, str) else reader
    names, types = zip(*(f.split() for f in SCHEMA.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t] for t in types]

    def rows_of(path: str, content: bytes | None, error: str | None) -> list[tuple]:
        started, began = time.time(), time.perf_counter()
        told, out = None, []
        if error is not None:
            return [(path, None, None, None, None, None, error, None, started, 0.0)]
        try:
            found = read(content or b"")
            document = found if isinstance(found, Document) else Document(found)
            told = json.dumps(document.metadata)
            for n, blocks in enumerate(document.pages):
                out += [(path, n, k, *block, None) for k, block in enumerate(blocks)] or [(path, n, None, None, None, None, None)]
            out = out or [(path, None, None, None, None, None, None)]
        except Exception as e:  # noqa: BLE001  one bad file is a result, not a failure
            out = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        elapsed = time.perf_counter() - began
        return [(*row, *((told, started, elapsed) if i == 0 else (None, None, None))) for i, row in enumerate(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows_of(path, content.as_py(), error), strict=True), kinds, strict=True)], names=list(names))

    error = F.col("error") if "error" in files.columns else F.lit(None)
    return files.select("path", "content", error.cast("string").alias("error")).mapInArrow(run, SCHEMA)
