"""Shared storage for intermediate tables, and joins that survive hot keys.

Intermediate tables are written to the folder the cluster names in ``spark.checkpoint.dir``.  Only when that setting is
empty (tests, notebooks on one machine) is a folder under the working directory's warehouse used instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key counts as hot from this share of all rows on, so there are at most 1 / HOT_SHARE hot keys: a proven broadcast bound.
HOT_SHARE = 1e-3
#: Number of parts into which the rows of a hot key are salted.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share. Read from the session; set only where the session has none, and only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("quern.local.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.local.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The files outlive lost executors and go when the application ends. Empty inputs come back empty with the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path  # type: ignore[attr-defined]
    return out


def materialize_counted(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize`, and the number of rows and further aggregates measured by the same write, without another job."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures), name)
    got = seen.get
    return out, got if got.get("rows") is not None else {"rows": out.count()}


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` once nothing reads them any more."""
    path = getattr(df, "quern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt_of(column: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, row_id: str, size: str, total: int) -> DataFrame:
    """Inner join ``rows`` to one fact row per ``key``, hot keys salted.

    ``facts`` has a unique ``key`` and ``size`` (rows of that key). Keys with at least HOT_SHARE of ``total`` rows are hot;
    at most 1 / HOT_SHARE of them exist, so only their names are broadcast. Their fact row is repeated once per salt and
    their rows spread over the salts; other keys have salt 0. Null keys join nothing.
    """
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(facts.filter(F.col(size) >= least).select(F.col(key).alias("_hot_key")))
    spread = (
        rows.join(hot, rows[key] == F.col("_hot_key"), "left")
        .withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), salt_of(F.col(row_id))).otherwise(F.lit(0)))
        .drop("_hot_key")
    )
    salts = F.when(F.col(size) >= least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    wide = facts.withColumn("_salt", F.explode(salts))
    return spread.join(wide, [key, "_salt"], "inner").drop("_salt")


def in_blocks(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the partition's number in ``_block``, as a table of its own.

    Windows over a key then run over (key, _block), whose size a partition bounds however hot the key is; what crosses blocks
    is one row per key and block (see :func:`before_blocks`).
    """
    return materialize(df.repartitionByRange(order).withColumn("_block", F.spark_partition_id()), name)


def before_blocks(blocked: DataFrame, keys: list[str], **totals: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """``keys, _block`` and, for every (aggregate of a block, how to combine) given, its value over all earlier blocks.

    One row per key and block, so at most as many rows of a key as there are partitions. Null where there is no earlier block.
    """
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = blocked.groupBy(*keys, "_block").agg(*[a.alias(f"_{n}") for n, (a, _) in totals.items()])
    return per.select(*keys, "_block", *[combine(F.col(f"_{n}")).over(w).alias(n) for n, (_, combine) in totals.items()])
