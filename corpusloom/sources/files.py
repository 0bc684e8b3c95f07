"""Text files and path rules: routing, languages, defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extension to language.
LANGUAGE_OF_EXTENSION = {
    ".py": "python",
    ".go": "go",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".rs": "rust",
    ".rb": "ruby",
}

# Directories that never hold source code of the project.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env",
    "vector_db", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build",
    "target", ".idea", ".vscode", ".egg-info", "site-packages",
)

UNKNOWN_SOURCE = "unknown"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """``.ext`` in lower case, empty if none; leading dots are no extension."""
    name = F.regexp_replace(basename(path), r"^\.+", "")
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Language id by extension; null when it is not a source file."""
    case = None
    for ext, lang in LANGUAGE_OF_EXTENSION.items():
        hit = extension(path) == ext
        case = F.when(hit, F.lit(lang)) if case is None else case.when(hit, F.lit(lang))
    return case


def route(path: Column, splitter: str = "semantic") -> Column:
    """Which loader takes a path: ``code`` first, then ``pdf``, else ``text``."""
    if splitter == "code":
        return F.lit("code")
    return F.when(extension(path) == ".pdf", F.lit("pdf")).otherwise(F.lit("text"))


def is_pruned(path: Column) -> Column:
    """True when any directory of the path is ignored or hidden.

    Only directories count: a hidden file in a visible one is kept.
    """
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*IGNORED_DIRS) | d.startswith("."))


def source_files(
    listing: DataFrame,
    languages: Sequence[str] | None = None,
    path_col: str = "path",
    prune: bool = True,
) -> DataFrame:
    """Rows of a path table that are source files, with their language.

    Both rules only look at the path, so with a stored table no content of a
    dropped row is read.
    """
    out = listing.withColumn("language", language(F.col(path_col))).where(
        F.col("language").isNotNull()
    )
    if languages is not None:
        out = out.where(F.col("language").isin(*languages))
    return out.where(~is_pruned(F.col(path_col))) if prune else out


def name_matches(path: Column, suffix: str = ".pdf") -> Column:
    """Glob ``*<suffix>`` on the file name, case-sensitive."""
    return basename(path).endswith(suffix)


def with_source(docs: DataFrame, path_col: str | None = None) -> DataFrame:
    """Fill a missing source from the path, else with ``unknown``."""
    own = [F.col("source")] if "source" in docs.columns else []
    path = [F.col(path_col)] if path_col else []
    return docs.withColumn("source", F.coalesce(*own, *path, F.lit(UNKNOWN_SOURCE)))
