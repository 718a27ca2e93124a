"""Settings, read from the environment as text and kept as one value object."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

NAME, VERSION, DESCRIPTION = "docloom", "0.1.0", "Set-at-a-time ingestion and analysis of document collections"

#: Texts that mark a file of several documents.
BATCH_KEYWORDS = (
    "Abstract ID",
    "Abstract ID:",
    "Abstract:",
    "ABSTRACT:",
    "Publication ID",
    "Publication ID:",
    "Title:",
    "TITLE:",
    "Authors:",
    "AUTHORS:",
    "Introduction",
    "INTRODUCTION",
    "Methods",
    "METHODS",
    "Results",
    "RESULTS",
    "Conclusion",
    "CONCLUSION",
)
#: Fixed value: pages whose word sets are less similar than this are different documents.
SIMILARITY_THRESHOLD = 0.3


def _truth(text: str) -> bool:
    return text.strip().lower() == "true"


@dataclass(frozen=True)
class Settings:
    max_file_size_mb: int = 100
    retry_attempts: int = 3
    use_llm: bool = False
    extract_images: bool = True
    storage_dir: str = "./storage"
    data_dir: str = "./data"
    catalog_dir: str = "./catalog"
    reader: str = "light"
    keywords: tuple[str, ...] = BATCH_KEYWORDS
    similarity_threshold: float = SIMILARITY_THRESHOLD
    packed: bool = False
    storage_mounted: bool = False

    @property
    def max_file_size(self) -> int:
        return self.max_file_size_mb * 1024 * 1024

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        return cls(
            max_file_size_mb=int(env.get("MAX_FILE_SIZE_MB", "100")),
            retry_attempts=int(env.get("RETRY_ATTEMPTS", "3")),
            use_llm=_truth(env.get("MARKER_USE_LLM", "false")),
            extract_images=_truth(env.get("MARKER_EXTRACT_IMAGES", "true")),
            storage_dir=env.get("STORAGE_DIR", "./storage"),
            data_dir=env.get("DATA_DIR", "./data"),
            catalog_dir=env.get("CATALOG_DIR", "./catalog"),
            reader=env.get("DOCLOOM_READER", "light"),
            packed=_truth(env.get("DOCLOOM_PACKED", "false")),
            storage_mounted=_truth(env.get("DOCLOOM_STORAGE_MOUNTED", "false")),
        )

    def session(self, name: str = NAME) -> SparkSession:
        """A session with the engine's settings; retries are Spark's task retries."""
        return (
            SparkSession.builder.appName(name)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.task.maxFailures", str(max(1, self.retry_attempts)))
            .getOrCreate()
        )

    def extractor_options(self) -> dict[str, object]:
        """Options that a reader is made with. Fixed values, but for the two settings."""
        return {
            "output_format": "markdown",
            "extract_images": self.extract_images,
            "paginate_output": True,
            "keep_pageheader_in_output": True,
            "format_lines": False,
            "use_llm": self.use_llm,
            "redo_inline_math": False,
            "debug": False,
            "workers": 1,
        }


def app_info(name: str = NAME) -> dict[str, str]:
    return {"name": name, "version": VERSION, "description": DESCRIPTION}


def is_healthy(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("SELECT 1").first()[0] == 1
