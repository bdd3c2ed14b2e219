"""Session helpers shared by every operator: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and bytes as Spark holds them, up to which a side may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine, UTC and adaptive."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]")
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder is the cluster's spark.checkpoint.dir. On one machine a folder of our own is set where none is; on a cluster that is an error, as executors must share it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "evidenza-checkpoints"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def shut(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(held: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(held)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([shut(batch)], pa.binary())], ["rows"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.column("rows"):
            yield opened(held.as_py())


def packed_cut(df: DataFrame) -> DataFrame:
    """Like cut, for many small rows: a checkpoint holds rows as they are in memory, so they are compressed first, some thousands together."""
    return cut(df.mapInArrow(_packed, "rows binary")).mapInArrow(_unpacked, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    """The rows with their number, from 1, in the order within their group; keys aren't null.

    Groups are cut into ranges of the order, so one that holds a third of all rows is spread over as many tasks; only
    one number a group and range is brought together.
    """
    rows = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    inner = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    rows = rows.withColumn("_at", inner).join(sizes, [*keys, "_part"])
    return rows.withColumn(name, (F.col("_skip") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_skip")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after measuring that the side is small; otherwise leave the join to the planner.

    The measuring stops after ``rows + 1`` rows, so it stays cheap; bytes are those of the rows as JSON.
    """
    size = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= rows and size["bytes"] <= BROADCAST_BYTES else df
