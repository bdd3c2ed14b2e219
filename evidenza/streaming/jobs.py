"""Structured Streaming forms of the queue, window and session logic.

A stream reads files as they come; ``drained`` runs one over what is there and gives the written rows as a table. State, output and
progress live in the shared folder of the session's checkpoints, so a lost executor or driver loses nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidenza.operators.lifecycle import upserted
from evidenza.runtime import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), "streams", uuid.uuid4().hex)


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet file or folder with the schema that is stored."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, name = os.path.split(path.rstrip("/"))
    return reader.option("pathGlobFilter", name).parquet(folder) if path.startswith("/") and os.path.isfile(path) else reader.parquet(path)


def with_end(stream: DataFrame, at: str) -> DataFrame:
    """A finite stream with a row behind all others that closes every window once the rest is read: all its values are null but a far time.

    Only for streams that are read in one batch; of a stream that is read in several, the row would make the later ones late.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/end"
    far = [(F.lit("9000-01-01 00:00:00") if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*far).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, and returns what it wrote."""
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/progress").option("path", f"{root}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def tumbling(stream: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each window; rows later than the watermark drop out, a window comes out once it is closed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(stream: DataFrame, at: str, width: str = "30 minutes", step: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, at: str, by: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def first_deliveries(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: repeated deliveries drop out, with bounded state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def interval_joined(opened: DataFrame, closing: DataFrame, key: str, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """Closings with the openings of their key at most so many seconds before; both streams have (key, id, at)."""
    o = opened.select(F.col(key).alias("o_key"), F.col("id").alias("opened_id"), F.col("at").alias("opened_at")).withWatermark("opened_at", late)
    c = closing.select(F.col(key).alias("c_key"), F.col("id").alias("closing_id"), F.col("at").alias("closed_at")).withWatermark("closed_at", late)
    near = (F.col("o_key") == F.col("c_key")) & (F.col("opened_at") <= F.col("closed_at")) & (F.col("opened_at") >= F.col("closed_at") - F.expr(f"interval {seconds} seconds"))
    return c.join(o, near).select("closing_id", "opened_id", "closed_at", "opened_at")


def _retries(most: int, keep_ms: int) -> Callable:
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, last, newest = state.get if state.exists else (0, "pending", 0)
        out = []
        for pdf in rows:
            for at, seq, event in pdf.sort_values(["at", "seq"])[["at", "seq", "event"]].itertuples(index=False):
                newest = max(newest, int(at.timestamp() * 1000))
                if last in ("ready", "dead_letter"):
                    continue
                if event == "failed":
                    failures += 1
                    last = "dead_letter" if failures >= most else "retry_wait"
                else:
                    last = {"done": "ready", "claimed": "running"}.get(event, "pending")
                out.append((key[0], seq, last, failures, float(min(300, 2 ** (failures - 1))) if last == "retry_wait" else None))
        state.update((failures, last, newest))
        state.setTimeoutTimestamp(max(newest + keep_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["job", "seq", "state", "failures", "wait_s"])

    return step


def retry_transitions(stream: DataFrame, most: int = 3, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """Every change of state of each job from its events (job, at, seq, event): retries with doubling waits, then a dead letter.

    A job that nothing was heard of for ``keep_days`` is forgotten, so the state doesn't grow with all jobs there ever were.
    Events without a job or time are left out.
    """
    kind = dict(stream.dtypes)["job"]
    watched = stream.where("job IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).groupBy("job")
    return watched.applyInPandasWithState(_retries(most, keep_days * 86_400_000), f"job {kind}, seq bigint, state string, failures int, wait_s double", "failures int, last string, newest bigint", "append", GroupStateTimeout.EventTimeTimeout)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def batches_upserted(stream: DataFrame, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Keeps a small table by versions: each batch is merged into the newest version and written as the next.

    A batch that is run again after a failure writes the same version anew from the version before it, so nothing counts twice.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = f"{folder}/version={number - 1}"
        out = merge(spark.read.parquet(before), batch) if _exists(spark, before) else batch
        out.write.mode("overwrite").parquet(f"{folder}/version={number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The rows of a table kept by ``buckets_upserted``, each bucket in its newest version (of those before a number); null without any."""
    if not _exists(spark, f"{folder}/rows"):
        return None
    rows = spark.read.parquet(f"{folder}/rows")
    rows = rows if before is None else rows.where(F.col("version") < before)
    marks = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # a row a bucket
    return rows.join(F.broadcast(marks), ["bucket", "version"], "left_semi")


def buckets_upserted(stream: DataFrame, folder: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """Keeps a large table by buckets of its keys: a batch rewrites only the buckets that it touches, as a new version of each.

    Of each key the row that is latest by ``order`` stays, of equal ones the one that came later. A batch that is run again
    writes the same versions anew from those before it. Read the table by ``newest``; older versions may be deleted.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        held = newest(spark, folder, number)
        touched = rows.select("bucket").distinct()  # at most ``buckets`` rows
        stored = rows.limit(0) if held is None else held.join(F.broadcast(touched), "bucket", "left_semi").select(*rows.columns)
        merged = upserted(stored, rows, key, order).withColumn("version", F.lit(number))
        merged.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "version").parquet(f"{folder}/rows")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def lifo(batch: DataFrame, order: Column, most: int) -> DataFrame:
    """The newest entries of a batch first, so many at most: what a worker takes next."""
    return batch.orderBy(order).limit(most)
