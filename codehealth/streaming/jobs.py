"""Streaming jobs over event tables: progress, trends, repeated submits, stuck runs, rule scans, answers.

Every job takes a streaming DataFrame and works the same on a batch one where its semantics allow it. run_to_table drains a
stream of files into a table, which is how tests and queries compare a stream with its batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from codehealth.sources.snapshots import replace_snapshot, snapshot

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_table(stream: DataFrame, mode: str, folder: str, final: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drains the stream into Parquet under folder, a batch at a time, and reads it back; each batch replaces its own part, so a
    batch that runs again leaves one copy. In update and complete mode rows carry their batch (`batch_id`)."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        out = rows.withColumn("batch_id", F.lit(batch))
        (final(out) if final else out).write.mode("overwrite").parquet(f"{folder}/out/part={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("part")


def run_to_snapshot(stream: DataFrame, find: Callable[[DataFrame], DataFrame], path: str, folder: str, keys: tuple[str, ...], name: str, order: str | None = None) -> DataFrame:
    """Drains the stream into a snapshot table at path and reads it back. Of each batch the keys are refreshed: what `find` makes of
    their rows replaces what the table has for them, so a file that comes again leaves one copy, and one without findings
    none. order: of several rows with equal keys in a batch the greatest counts. A batch that runs again, after a failure
    anywhere, is written once: the table knows the last batch of each stream by its name. folder: the stream's own state."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        if order:
            last = rows.groupBy(*keys).agg(F.max(order).alias(order))
            found = find(rows.join(last, [*keys, order], "left_semi"))
        else:
            found = find(rows)
        replace_snapshot(found, path, rows, keys, (name, batch))
        rows.unpersist()

    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return snapshot(spark, path, keys)


def latest_by_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's latest batch: what an update-mode table holds in the end."""
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return last.select(*keys, "v.*").drop("batch_id")


def latest_progress(events: DataFrame) -> DataFrame:
    """analysis_id with the stage and progress of its greatest seq; update mode."""
    return events.groupBy("analysis_id").agg(F.max_by(F.struct("stage", "progress"), "seq").alias("v"), F.max("seq").alias("seq")).select("analysis_id", "v.*", "seq")


def weekly(commits: DataFrame, late: str = "7 days") -> DataFrame:
    """Commits per week that starts on Monday (the epoch was a Thursday, hence the offset of four days)."""
    timed = commits.withColumn("committed_at", F.col("committed_at").cast("timestamp")).withWatermark("committed_at", late)
    own = timed.groupBy(F.window("committed_at", "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("commits"), F.sum("added").alias("added"))
    return own.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "commits", "added")


def unrepeated(messages: DataFrame, within: str = "2 seconds") -> DataFrame:
    """Messages whose (session_id, content) has not been seen within the time."""
    timed = messages.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", within)
    return timed.dropDuplicatesWithinWatermark(["session_id", "content"])


def first_within(messages: DataFrame, seconds: int) -> DataFrame:
    """The exact rule behind unrepeated, as a batch: session_id, id of the messages that no earlier one of equal content, let through
    itself, precedes by `seconds` or less. A fold over the times of each (session, content). A stream forgets a message only
    once its watermark has passed, so it may let fewer through."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    own = messages.groupBy("session_id", "content").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "id"))).alias("m"))
    start = F.struct(F.lit(None).cast("long").alias("gone"), F.array().cast("array<long>").alias("ids"))

    def step(acc, x):
        new = acc["gone"].isNull() | (x["at"] > acc["gone"])
        return F.struct(F.when(new, x["at"] + seconds * 1_000_000).otherwise(acc["gone"]).alias("gone"), F.when(new, F.concat(acc["ids"], F.array(x["id"].cast("long")))).otherwise(acc["ids"]).alias("ids"))

    return own.select("session_id", F.explode(F.aggregate("m", start, step, lambda acc: acc["ids"])).alias("id"))


def silences(events: DataFrame, minutes: int, late: str = "1 minute") -> DataFrame:
    """Batch twin of stuck_runs: a row (analysis_id, FAILED, 5003) for each time that a pending or running one had no event for so
    long, before its next event or the watermark after the last event of all."""
    at = F.col("at").cast("timestamp")
    order = Window.partitionBy("analysis_id").orderBy("at", "seq")
    end = events.agg((F.max(at) - F.expr(f"interval {late}")).alias("end"))  # one row
    rows = events.withColumn("next", F.lead(at).over(order)).join(F.broadcast(end))
    late = F.unix_micros(F.coalesce("next", "end")) - F.unix_micros(at) > minutes * 60_000_000
    return rows.filter(F.col("status").isin("PENDING", "RUNNING") & late).select("analysis_id", F.lit("FAILED").alias("status"), F.lit(5003).alias("error_code"))


#: Groups that sessions or runs are dealt into. A group's state is one value, read and written once a batch, so a batch costs its
#: rows and the state of the groups it touches, not a call to the state store for each key.
BUCKETS = 256


def _dealt(rows: DataFrame, key: str, order: str, buckets: int) -> DataFrame:
    """Rows with the key as text (a null among numbers would make them floats), their time in microseconds, and their group."""
    timed = rows.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)), "key": F.col(key).cast("string"), "micros": F.unix_micros("at")})
    return timed.drop(key).withColumnRenamed(order, "nr")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["micros", "nr"])


def _numbers(keys: list[str | None]) -> pd.Series:
    return pd.Series([None if k is None else int(k) for k in keys], dtype="Int64")


class Bucketed(StatefulProcessor):
    """Keeps a value for each key of a group, as two arrays of the types (key, value)."""

    types = (StringType(), LongType())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", StructType([StructField(name, ArrayType(kind)) for name, kind in zip(("keys", "values"), self.types)]))

    def load(self) -> dict:
        plain = lambda x: tuple(x) if isinstance(x, tuple) else x  # noqa: E731  rows as tuples
        return {plain(k): plain(v) for k, v in zip(*self.kept.get())} if self.kept.exists() else {}

    def save(self, values: dict) -> None:
        self.kept.update((list(values), list(values.values())))

    def close(self) -> None:
        pass


class FirstWithin(Bucketed):
    """Keeps until when a message of a session counts as seen."""

    types = (StructType([StructField("session_id", StringType()), StructField("content", StringType())]), LongType())

    def __init__(self, seconds: int):
        self.wait = seconds * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, gone = _in_order(rows), self.load()
        sessions, ids = [], []
        for own in zip(found["key"], found["content"], found["micros"], found["nr"]):
            last, timeless = gone.get(own[:2]), own[2] != own[2]
            if timeless or last is None or own[2] > last:
                if not timeless:
                    gone[own[:2]] = int(own[2]) + self.wait
                sessions.append(own[0])
                ids.append(own[3])
        self.save(gone)
        yield pd.DataFrame({"session_id": _numbers(sessions), "id": pd.Series(ids, dtype="int64")})


def first_within_stream(messages: DataFrame, seconds: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """first_within as a stream: session_id, id; exact if batches come in order. Its state keeps one time a session and content."""
    timed = messages.withColumn("at", F.col("at").cast("timestamp"))
    schema = StructType([StructField("session_id", LongType()), StructField("id", LongType())])
    return _dealt(timed, "session_id", "id", buckets).drop("at").groupBy("bucket").transformWithStateInPandas(FirstWithin(seconds), schema, "Append", "None")


class Submits(Bucketed):
    """Keeps each session's last message; a row that repeats it within the time is a repeat."""

    types = (StringType(), StructType([StructField("content", StringType()), StructField("micros", LongType())]))

    def __init__(self, seconds: float):
        self.wait = seconds * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, last = _in_order(rows), self.load()
        sessions, ids = [], []
        for session, content, at, nr in zip(found["key"], found["content"], found["micros"], found["nr"]):
            before, then = last.get(session, (None, None))
            if before is not None and content == before and then is not None and at - then <= self.wait:
                sessions.append(session)
                ids.append(nr)
            last[session] = (content, None if at != at else int(at))
        self.save(last)
        yield pd.DataFrame({"session_id": _numbers(sessions), "id": pd.Series(ids, dtype="int64")})


def repeated_submits(messages: DataFrame, seconds: float = 2.0, buckets: int = BUCKETS) -> DataFrame:
    """session_id, id of messages that repeat the session's previous one within the time; exact if batches come in order."""
    timed = messages.withColumn("at", F.col("at").cast("timestamp"))
    schema = StructType([StructField("session_id", LongType()), StructField("id", LongType())])
    return _dealt(timed, "session_id", "id", buckets).drop("at").groupBy("bucket").transformWithStateInPandas(Submits(seconds), schema, "Append", "None")


def _failed(runs: list[str | None]) -> pd.DataFrame:
    return pd.DataFrame({"analysis_id": _numbers(runs), "status": pd.Series(["FAILED"] * len(runs), dtype="str"), "error_code": pd.Series([5003] * len(runs), dtype="int64")})


class Stuck(Bucketed):
    """A run that stays pending or running without an event for so long fails, by a timer or, where its next event comes first, by
    that. Each silence fails it once. Keeps when each such run is due, in microseconds; a group has one timer, for the first."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.load()
        before, failed = self._first(due), []
        found = _in_order(rows)
        for run, status, at in zip(found["key"], found["status"], found["micros"]):
            if run in due and at > due[run]:
                failed.append(run)
            if status in ("PENDING", "RUNNING"):
                due[run] = int(at) + self.wait
            else:
                due.pop(run, None)
        first = self._first(due)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if first is not None:
                self.handle.registerTimer(first)
        self.save(due)
        yield _failed(failed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, now = self.load(), timerValues.getCurrentWatermarkInMs()
        failed = [run for run, at in due.items() if at // 1000 <= now]
        for run in failed:
            del due[run]
        if due:
            self.handle.registerTimer(self._first(due))
        self.save(due)
        yield _failed(failed)

    @staticmethod
    def _first(due: dict) -> int | None:
        return min(due.values()) // 1000 if due else None


def stuck_runs(events: DataFrame, minutes: int = 30, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """analysis_id, FAILED, 5003 of runs (analysis_id, seq, status, at) without an event for `minutes` of event time."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    schema = StructType([StructField("analysis_id", LongType()), StructField("status", StringType()), StructField("error_code", LongType())])
    return _dealt(timed, "analysis_id", "seq", buckets).groupBy("bucket").transformWithStateInPandas(Stuck(minutes), schema, "Append", "EventTime")


def answers(deltas: DataFrame) -> DataFrame:
    """session_id, answer, failed of deltas (session_id, seq, text, error): texts in order; an error wins, nothing is a failure."""
    own = deltas.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("d"), F.max("error").alias("error"))
    text = F.array_join(F.transform("d", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return own.select("session_id", F.when(F.col("error").isNull(), text).otherwise(F.col("error")).alias("answer"), (F.col("error").isNotNull() | (text == "")).alias("failed"))
