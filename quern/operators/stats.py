"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import SCRIPTS, WHITE, script_count


def corpus_stats(df: DataFrame, text_col: str) -> DataFrame:
    """Count, sum, mean, largest and exact median of lengths in code points, and bytes."""
    n = F.length(text_col)
    return df.filter(F.col(text_col).isNotNull()).agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("chars"),
        F.avg(n).alias("mean_chars"),
        F.max(n).cast("long").alias("max_chars"),
        F.median(n).alias("median_chars"),
        F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("utf8_bytes"),
        F.lit(False).alias("median_is_approximate"),
    )


def script_totals(df: DataFrame, text_col: str, by: list[str] | None = None) -> DataFrame:
    """Characters by writing system; one aggregation over native counts."""
    rows = df.filter(F.col(text_col).isNotNull())
    seen = F.length(F.regexp_replace(F.col(text_col), WHITE, ""))
    parts = [F.sum(script_count(F.col(text_col), s)).cast("long").alias(s) for s in SCRIPTS]
    sums = rows.groupBy(*(by or [])).agg(*parts, F.sum(seen).cast("long").alias("other"))
    return sums.withColumn("other", F.col("other") - sum((F.col(s) for s in SCRIPTS), F.lit(0)))  # what none of them has


def script_ratios(df: DataFrame, text_col: str) -> DataFrame:
    names = (*SCRIPTS, "other")
    totals = script_totals(df, text_col)
    whole = sum((F.col(n) for n in names), F.lit(0))
    return totals.select(*[F.round(F.col(n) / whole, 4).alias(n) for n in names])


def language_stats(df: DataFrame, text_col: str, languages: str) -> DataFrame:
    """By declared language (an array; a sample counts once per tag): samples, characters, bytes, share of samples."""
    rows = df.filter(F.col(text_col).isNotNull())
    total = rows.agg(F.count("*").alias("_all"))
    tags = rows.select(F.explode(F.array_distinct(languages)).alias("language"), F.length(text_col).alias("c"), F.octet_length(text_col).alias("b"))
    out = tags.groupBy("language").agg(F.count("*").alias("samples"), F.sum("c").cast("long").alias("chars"), F.sum("b").cast("long").alias("utf8_bytes"))
    return out.join(F.broadcast(total)).select("language", "samples", "chars", "utf8_bytes", (F.col("samples") / F.col("_all")).alias("sample_ratio"), (F.col("utf8_bytes") / F.col("chars")).alias("bytes_per_char"))


def source_coverage(df: DataFrame, source_col: str, required: DataFrame) -> DataFrame:
    """Rows of every required source, zero where it has none."""
    counts = df.groupBy(source_col).agg(F.count("*").alias("n"))
    return required.select(source_col).join(counts, source_col, "left").select(source_col, F.coalesce("n", F.lit(0)).alias("samples"))
