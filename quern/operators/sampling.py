"""Sampling, caps, splits and deduplication, all with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.numeric import split_name
from quern.operators.audit import first_of_group
from quern.plans.shared import attach_by_key, materialize


def capped(df: DataFrame, source_col: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each source. Filters above stay above: the cap counts what it sees."""
    return first_of_group(df, [source_col], order, cap, order[-1])


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``position`` from 0 in the order of a unique column: range partitions, their sizes, and ranks inside."""
    return numbered_of(df, order)[0]


def numbered_of(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """:func:`numbered`, and the number of rows."""
    spark = df.sparkSession
    placed = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, skip = 0, []
    for p in sorted(sizes):
        skip.append((p, before))
        before += sizes[p]
    offsets = F.broadcast(spark.createDataFrame(skip, "_part int, _skip long"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.join(offsets, "_part").withColumn("position", inside + F.col("_skip")).drop("_part", "_skip"), before


def positional_split(df: DataFrame, order: str, train: float = 0.98, valid: float = 0.01, test: float = 0.01) -> DataFrame:
    """Split by place: the first share trains, the next validates, the rest tests."""
    total = train + valid + test
    rows, n = numbered_of(df, order)
    at = F.col("position") / F.lit(float(max(1, n)))
    return rows.withColumn("split", F.when(at < train / total, "train").when(at < (train + valid) / total, "valid").otherwise("test"))


def sample_split(conflict: Column, forced: Column, key: Column, **ratios: float) -> Column:
    """``discard`` on a conflict, else the forced split, else the hash split."""
    return F.when(F.coalesce(conflict, F.lit(False)), "discard").otherwise(F.coalesce(forced, split_name(key, **ratios)))


def translation_split(source: Column, target: Column, source_field: str, target_field: str, **ratios: float) -> tuple[Column, Column]:
    """Split key of a parallel pair, and its split: that of both endpoints if they agree, else ``discard``."""
    a, b = F.least(source, target), F.greatest(source, target)
    key = F.concat(F.lit("translation:"), a, F.lit("\0"), b)
    ends = [split_name(F.concat(F.lit(f"translation-endpoint:{f}:"), c), **ratios) for f, c in ((source_field, source), (target_field, target))]
    return key, F.when(ends[0] == ends[1], ends[0]).otherwise("discard")


def deduplicated(df: DataFrame, text_col: str, order: str) -> DataFrame:
    """Rows whose text no earlier row has. Digests and order are aggregated before the shuffle; texts do not move for it."""
    keyed = df.select(order, F.sha1(F.col(text_col)).alias("_digest"))
    first = keyed.groupBy("_digest").agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def duplicate_groups(df: DataFrame, text_col: str, order: str) -> DataFrame:
    """``digest, first, copies`` of texts that occur more than once."""
    keyed = df.filter(F.col(text_col).isNotNull()).groupBy(F.sha1(F.col(text_col)).alias("digest"))
    return keyed.agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")


def with_first(df: DataFrame, text_col: str, order: str) -> DataFrame:
    """Every row of a duplicated text with the first row that has it; hot texts are salted."""
    keyed = df.select(order, F.sha1(F.col(text_col)).alias("digest")).filter("digest is not null")
    facts = keyed.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return attach_by_key(keyed, facts, "digest", order, "copies", df.count()).select(order, "first", "copies")


def epoch_order(id_col: Column, seed: int, epoch: int) -> Column:
    """Sort key of a permutation that any epoch can ask for again."""
    return F.xxhash64(F.lit(seed + epoch), id_col)


def with_fallback(df: DataFrame, split_col: str, order: str) -> DataFrame:
    """``df`` with a validation split: where none is, the test rows validate, or else the last training row, if it is not the only one."""
    seen = df.groupBy().agg(F.max(F.col(split_col) == "valid").alias("_valid"), F.max(F.col(split_col) == "test").alias("_test"), F.count_if(F.col(split_col) == "train").alias("_n"), F.max(F.when(F.col(split_col) == "train", F.col(order))).alias("_last"))  # one row
    now = F.col(split_col)
    none = ~F.coalesce("_valid", F.lit(False))
    moved = F.when(none & F.coalesce("_test", F.lit(False)) & (now == "test"), "valid").when(none & ~F.coalesce("_test", F.lit(False)) & (F.col("_n") > 1) & (now == "train") & (F.col(order) == F.col("_last")), "valid")
    return df.join(F.broadcast(seen)).withColumn(split_col, F.coalesce(moved, now)).drop("_valid", "_test", "_n", "_last")


def evaluation_rows(df: DataFrame, split_col: str) -> DataFrame:
    """The test rows, or the validation rows where no row is a test row, or else the training rows."""
    rank = F.array_position(F.array(F.lit("test"), F.lit("valid"), F.lit("train")), F.col(split_col))
    best = df.filter(rank > 0).agg(F.min(rank).alias("_best"))  # one row
    return df.join(F.broadcast(best), rank == F.col("_best")).drop("_best")


def requested(wanted: DataFrame, allowed: DataFrame, name: str) -> DataFrame:
    """Requested sources with whether they are allowed; the caller fails on any that is not."""
    known = allowed.select(name).distinct().withColumn("_known", F.lit(True))
    return wanted.select(name).distinct().join(known, name, "left").select(name, F.coalesce("_known", F.lit(False)).alias("allowed"))
