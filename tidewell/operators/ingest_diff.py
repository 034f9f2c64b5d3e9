"""Incremental ingest as joins: what to skip, what to work on, what has vanished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import under_any_root


def skipped(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, mtime) whose known mtime is the same."""
    return files.join(known, ["path", "mtime"], "left_semi")


def work_list(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """New and changed files; all of them if forced."""
    return files if force else files.join(known, ["path", "mtime"], "left_anti")


def vanished(known: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """Known paths under the roots that are not among the files any more."""
    return known.filter(under_any_root(F.col("path"), roots)).join(files, "path", "left_anti")
