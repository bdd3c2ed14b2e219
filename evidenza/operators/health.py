"""Health and hygiene: counts, percentiles, coverage, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import text


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], last: int = 1000, order: list | None = None) -> DataFrame:
    """(by, share, value): nearest-rank percentiles of the latest values: index round((n - 1) * share), half to even."""
    if order is not None:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= last)
    w = Window.partitionBy(*by)
    rows = df.select(*by, F.col(value).alias("value"), (F.row_number().over(w.orderBy(value)) - 1).alias("at"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return rows.where(F.col("at") == F.rint((F.col("n") - 1) * F.col("share"))).select(*by, "share", "value")


def operation_stats(df: DataFrame, by: list[str], value: str, failed: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.count_if(failed).alias("n_failed"))


def findings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, class, subclass, n, excerpt): what looks like a credential, or points to one, in each text field; excerpts are redacted and have at most 1,000 signs."""
    stacked = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text"), text.redacted(F.col(f).cast("string"), f).alias("shown")) for f in fields])).alias("x")).select(key, "x.*").where(F.col("text").isNotNull())
    rows = stacked.select(key, "field", F.substring("shown", 1, 1000).alias("excerpt"), F.explode(text.secret_counts(F.col("text"))).alias("h"))
    return rows.select(key, "field", "h.class", "h.subclass", "h.n", "excerpt")


def first_conflict(ops: DataFrame, order: str, conflict: str) -> DataFrame:
    """Approved operations with a status: those from the first conflict on don't run."""
    first = ops.where(conflict).agg(F.min(order).alias("_stop"))
    rows = ops.join(F.broadcast(first))  # one row
    return rows.withColumn("state", F.when(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")), "apply").when(F.col(order) == F.col("_stop"), "conflict").otherwise("not run")).drop("_stop")
