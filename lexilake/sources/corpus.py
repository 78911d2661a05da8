"""Text files that may mention catalog keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.sources.documents import read_documents

# File types searched and directories skipped.
TEXT_EXTENSIONS = [
    ".c", ".cc", ".cpp", ".cs", ".h", ".hpp", ".java", ".js", ".json", ".jsx", ".kt", ".kts", ".m", ".mm",
    ".plist", ".properties", ".rb", ".scala", ".storyboard", ".strings", ".swift", ".ts", ".tsx", ".xib",
    ".xml", ".yaml", ".yml",
]
SKIPPED_DIRECTORIES = [".git", ".next", ".snapshots", ".turbo", "build", "coverage", "dist", "node_modules"]


def searchable_path(path: Column, extensions: list[str], exclude_dirs: list[str]) -> Column:
    """The path has a searched extension and lies in no skipped directory."""
    file = F.regexp_extract(path, r"([^/]*)\z", 1)
    extension = F.lower(F.regexp_extract(file, r"[^.](\.[^.]*)\z", 1))
    folders = F.filter(F.split(F.regexp_replace(path, r"/?[^/]*\z", ""), "/"), lambda f: f != "")
    return extension.isin(extensions) & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in exclude_dirs]))


def text_corpus(docs: DataFrame, extensions: list[str] = TEXT_EXTENSIONS,
                exclude_dirs: list[str] = SKIPPED_DIRECTORIES) -> DataFrame:
    """Searchable documents; any that hold a NUL character are binary and left out."""
    return docs.filter(searchable_path(F.col("path"), extensions, exclude_dirs)
                       & ~F.contains("text", F.lit("\x00")))


def scan_text_corpus(spark: SparkSession, path: str, extensions: list[str] = TEXT_EXTENSIONS,
                     exclude_dirs: list[str] = SKIPPED_DIRECTORIES, catalog_dir: str | None = None,
                     **options) -> DataFrame:
    """Searchable files below ``path``, the catalog directory left out."""
    skipped = [*exclude_dirs, *([catalog_dir] if catalog_dir else [])]
    docs = read_documents(spark, path, **options)
    return text_corpus(docs, extensions, skipped)
