"""Scanners that users bring: functions from files (keys, content) to findings (keys, line, rule_key), by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions.keys import file_keys

Scanner = Callable[[DataFrame], DataFrame]
SCANNERS: dict[str, Scanner] = {}


def register_scanner(name: str, scan: Scanner) -> None:
    SCANNERS[name] = scan


def scanned(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """scanner, keys, line, rule_key of the named scanners (all if none are named)."""
    out = None
    for name in names if names is not None else sorted(SCANNERS):
        own = SCANNERS[name](files).select(F.lit(name).alias("scanner"), *file_keys(files), "line", "rule_key")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else files.select(F.lit("").alias("scanner"), *file_keys(files), F.lit(0).alias("line"), F.lit("").alias("rule_key")).limit(0)


@F.udtf(returnType="line int, rule_key string")
class LongLines:
    """A table function as a scanner: lines above a length."""

    def eval(self, content: str, most: int) -> Iterator[tuple[int, str]]:
        for i, line in enumerate((content or "").split("\n")):
            if len(line) > most:
                yield i + 1, "LONG-LINE"


def long_lines(most: int) -> Scanner:
    def scan(files: DataFrame) -> DataFrame:
        spark = files.sparkSession
        spark.udtf.register("long_lines", LongLines)
        return spark.sql(f"select {', '.join(file_keys(files))}, line, rule_key from {{files}}, lateral long_lines(content, {{most}})", files=files, most=most)

    return scan
