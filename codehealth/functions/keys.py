"""What identifies a file among many projects and analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame

FILE_KEYS = ("project_id", "analysis_id", "path")


def file_keys(df: DataFrame, keys: tuple[str, ...] | None = None) -> list[str]:
    """The key columns of df: those given, else those of FILE_KEYS that it has."""
    return list(keys) if keys is not None else [c for c in FILE_KEYS if c in df.columns]
