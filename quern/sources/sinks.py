"""Sinks: JSONL, tokenizer corpus, token store, logs and content-addressed caches, and the switch that publishes a folder.

Every sink writes beside its target and then switches, so readers see the old files or the new ones, never a mixture.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import WHITE

# Names beside a target while a switch is under way.
BACKUP, JOURNAL = ".previous", ".switching"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    at = lambda suffix="": jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + suffix)
    return at().getFileSystem(spark._jsc.hadoopConfiguration()), at


def recover(spark: SparkSession, target: str) -> str:
    """Bring a target whose switch was interrupted into one of its two states: ``none``, ``restored`` or ``completed``."""
    fs, at = _fs(spark, target)
    if not fs.exists(at(JOURNAL)):
        return "none"
    state = "completed"
    if not fs.exists(at()) and fs.exists(at(BACKUP)):
        fs.rename(at(BACKUP), at())
        state = "restored"
    fs.delete(at(BACKUP), True)
    fs.delete(at(JOURNAL), True)
    return state


def publish(spark: SparkSession, staged: str, target: str, fail_after: str | None = None) -> None:
    """Replace the folder ``target`` by ``staged``. A journal and the kept old folder let :func:`recover` undo half a switch.

    ``fail_after`` (``journal``, ``backup`` or ``switch``) stops there with an error, for tests of the recovery.
    """
    recover(spark, target)
    fs, at = _fs(spark, target)
    source = spark._jvm.org.apache.hadoop.fs.Path(staged)
    if not fs.exists(source):
        raise FileNotFoundError(staged)

    def reached(step: str) -> None:
        if fail_after == step:
            raise RuntimeError(f"stopped after {step}")

    fs.create(at(JOURNAL), True).close()
    reached("journal")
    if fs.exists(at()):
        fs.rename(at(), at(BACKUP))
    reached("backup")
    if not fs.rename(source, at()):
        recover(spark, target)
        raise OSError(f"could not switch {target}")
    reached("switch")
    fs.delete(at(BACKUP), True)
    fs.delete(at(JOURNAL), True)


def _switched(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    write(staged)
    publish(df.sparkSession, staged, path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; NaN and infinite numbers fail before anything is replaced."""
    checked = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
            checked = checked.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(F.col(name)))
    lines = checked.select(F.to_json(F.struct(*checked.columns), {"ignoreNullFields": "false"}).alias("value"))
    _switched(df, path, lambda staged: lines.write.text(staged))


def write_tokenizer_corpus(df: DataFrame, text_col: str, path: str) -> None:
    """One sample per line, line ends inside samples as spaces, blank samples left out."""
    line = F.regexp_replace(F.regexp_replace(F.col(text_col), r"[\r\n]+", " "), f"^{WHITE}|{WHITE}$", "")
    lines = df.select(line.alias("value")).filter("value <> ''")
    _switched(df, path, lambda staged: lines.write.text(staged))


def write_token_store(df: DataFrame, path: str, split_col: str = "split_name", id_col: str = "seq_id") -> None:
    """Token rows by split, sorted by id inside files, so that a look-up of ids reads few row groups."""
    rows = df.repartitionByRange(split_col, id_col).sortWithinPartitions(split_col, id_col)
    _switched(df, path, lambda staged: rows.write.partitionBy(split_col).option("compression", "zstd").parquet(staged))


def read_token_rows(spark: SparkSession, path: str, ids: list[int], id_col: str = "seq_id") -> DataFrame:
    """Random access: the rows of some ids. The filter reaches the scan, whose statistics skip the rest."""
    return spark.read.parquet(path).filter(F.col(id_col).isin(*ids))


def append_log(df: DataFrame, path: str) -> None:
    """Metrics of a run as JSON lines, appended."""
    df.write.mode("append").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table as Markdown in one file, ordered by its first column."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))], "part int, value string")
    rows = head.unionByName(df.select(F.lit(2).alias("part"), cells.alias("value"))).orderBy("part", "value").select("value").coalesce(1)
    _switched(df, path, lambda staged: rows.write.text(staged))


def cache_key(settings: dict, checksums: DataFrame) -> str:
    """Digest of the settings and of the files' checksums, independent of their order."""
    files = checksums.select(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256")))), 256)).first()[0]
    return hashlib.sha256((json.dumps(settings, sort_keys=True, separators=(",", ":")) + str(files)).encode()).hexdigest()
