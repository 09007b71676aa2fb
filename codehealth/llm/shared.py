"""Tables that outlive a job: written once to the folder that all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of applications on this machine that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where it is unset (tests, one machine), a temporary one for the application; a
    running session does not take the setting any more, so it is kept here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, application = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _OWN[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codehealth-{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and reread: later jobs neither recompute it nor lose it with an executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def text_or_empty(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def pieces_for(spark: SparkSession, n_bytes: int, piece: int) -> int:
    """Number of parts so that each holds about `piece` bytes, at least what the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // piece))


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
