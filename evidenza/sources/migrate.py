"""Older stored tables brought to the present schema, and packed vectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing, name to (type, default); columns that are there stay as they are."""
    return df.withColumns({n: F.lit(v).cast(t) for n, (t, v) in wanted.items() if n not in df.columns})


def re_owned(rows: DataFrame, memory_id: str, memories: DataFrame) -> DataFrame:
    """Rows with ``agent`` as their memory's owner; "" for rows without a stored memory."""
    owners = memories.select(F.col("id").alias(memory_id), F.col("agent").alias("_owner"))
    return rows.drop("agent").join(owners, memory_id, "left").withColumn("agent", F.coalesce("_owner", F.lit(""))).drop("_owner")


def kept_facts(facts: DataFrame) -> DataFrame:
    """Extracted facts without those marked as discarded or hypothetical; missing marks mean neither."""
    return facts.where(~F.coalesce("discard", F.lit(False)) & (F.lower(F.coalesce("modality", F.lit("asserted"))) != "hypothetical"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column("vec").to_pylist():
            x = None if v is None or any(e is None for e in v) else np.asarray(v, "<f4")
            out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() else None)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "packed"])


def packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, packed): vectors as little-endian 32-bit floats behind one another; null for null, empty and non-finite ones."""
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec")).mapInArrow(_packed, f"key {kind}, packed binary").withColumnRenamed("key", key)


def unpacked(blob: bytes | None) -> list[float] | None:
    """The elements of one packed vector; an error for a length that holds no whole number of them."""
    if blob is None:
        return None
    if len(blob) % 4:
        raise ValueError("a packed vector has four bytes an element")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


def packed_length(blob: Column) -> Column:
    """The number of elements of a packed vector."""
    return (F.length(blob) / 4).cast("int")
