"""Structured Streaming forms: audit, deduplication with a watermark, windowed counts, an ordered fold with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.audit import PATTERNS, categories


def read_landing(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they land in a folder, at most ``files`` per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def audit_stream(df: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """Running counts by source of rows scanned and rows with each category."""
    rows = df.select(source_col, categories(F.col(text_col)).alias("found"))
    names = (*PATTERNS, "payment_card")
    return rows.groupBy(source_col).agg(F.count("*").alias("scanned"), *[F.count_if(F.array_contains("found", n)).alias(n) for n in names])


def first_seen(df: DataFrame, text_col: str, time_col: str, late: str = "1 day") -> DataFrame:
    """Each text once within the watermark; state is bounded by time."""
    return df.withWatermark(time_col, late).withColumn("digest", F.sha1(F.col(text_col))).dropDuplicatesWithinWatermark(["digest"])


def window_counts(df: DataFrame, time_col: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; rows later than the watermark are dropped by Spark."""
    rows = df.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), key, "n")


def ema_stream(df: DataFrame, key: str, value: str, rate: float, order: str | None = None) -> DataFrame:
    """Exponential moving average by key over all rows so far: batches as they arrive, rows of a batch by ``order`` if given.

    Rows of one key and batch are held to be ordered; ``maxFilesPerTrigger`` of the source bounds them.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        for b in [pd.concat(list(batches)).sort_values(order)] if order else batches:
            for x in b[value]:
                now = float(x) if now is None else now * (1 - rate) + float(x) * rate
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "ema": [now]})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ema double", "ema double", "update", GroupStateTimeout.NoTimeout)
