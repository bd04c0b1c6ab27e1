"""Locks, digests and comparisons of files and settings."""

from __future__ import annotations

import hashlib
import json
import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import content_hash
from quern.sources.files import checksums, expand, file_list


def json_digest(payload: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def source_lock(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """``source_name, purpose, path, bytes, sha256`` of every file of every source, in order."""
    files = [(s["name"], s.get("purpose", "training"), f) for s in sources for f in expand(spark, s.get("paths") or [s["path"]])]
    if not files:
        raise ValueError("no files to lock")
    listed = spark.createDataFrame(files, "source_name string, purpose string, path string")
    return checksums(listed).drop("newlines").orderBy("source_name", "path")


def path_overlap(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Paths that serve both, however written: dots, doubled slashes and a scheme of local files do not count."""

    def plain(df: DataFrame) -> DataFrame:
        p = F.regexp_replace(F.col("path"), "^file:/+", "/")
        p = F.regexp_replace(p, "/+", "/")
        p = F.regexp_replace(p, r"/(?:\./)+", "/")
        parts = F.filter(F.split(p, "/"), lambda x: x != "")
        step = lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
        return df.select(F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).alias("path")).distinct()

    return plain(training).intersect(plain(evaluation))


def purpose_conflicts(lock: DataFrame) -> DataFrame:
    """Checksums that serve both training and evaluation."""
    return lock.groupBy("sha256").agg(F.array_sort(F.collect_set("purpose")).alias("purposes")).filter("size(purposes) > 1")


def lock_changes(locked: DataFrame, now: DataFrame) -> DataFrame:
    """Files that were added, removed or changed since the lock."""
    a = locked.select("source_name", "path", F.col("sha256").alias("before"))
    b = now.select("source_name", "path", F.col("sha256").alias("after"))
    both = a.join(b, ["source_name", "path"], "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", kind).filter("change IS NOT NULL")


def denylist_digest(deny: DataFrame) -> DataFrame:
    """SHA-256 of the sorted distinct hashes as a JSON list. The sorted list streams through one task with a digest as state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = hashlib.sha256(b"["), True
        for batch in batches:
            values = [f'"{h}"' for h in batch.column(0).to_pylist()]
            if values:
                digest.update((("" if first else ",") + ",".join(values)).encode())
                first = False
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["digest"])

    return deny.filter("hash is not null").select("hash").distinct().orderBy("hash").coalesce(1).mapInArrow(run, "digest string")


def leaves(settings: dict, prefix: str = "") -> dict[str, str]:
    """Settings as dotted paths; lists are one value; types count."""
    out: dict[str, str] = {}
    for k, v in settings.items():
        path = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict) and v:
            out |= leaves(v, path)
        else:
            out[path] = f"{type(v).__name__}:{json.dumps(v, sort_keys=True)}"
    return out


def changed_settings(a: dict, b: dict, ignored: tuple[str, ...] = ()) -> list[str]:
    """Paths whose values or types differ, but for those below an ignored prefix."""
    x, y = leaves(a), leaves(b)
    skip = lambda p: any(p == i or p.startswith(i + ".") for i in ignored)
    return sorted(p for p in x.keys() | y.keys() if x.get(p) != y.get(p) and not skip(p))


def undeclared_changes(a: dict, b: dict, declared: set[str], ignored: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Changes that were not declared, and declared ones that did not happen."""
    found = set(changed_settings(a, b, ignored))
    return sorted(found - declared), sorted(declared - found)


def data_signature(spark: SparkSession, sources: list[dict]) -> str:
    """Digest of the contents of all files of the sources: path, bytes and checksum, in order. One short row per file."""
    return json_digest([[r["path"], r["bytes"], r["sha256"]] for r in source_lock(spark, sources).select("path", "bytes", "sha256").distinct().orderBy("path").toLocalIterator()])


def fingerprint(stage: str, settings: dict, signature: str, versions: dict | None = None) -> str:
    """What an artifact was made of: stage, settings, data and versions. Equal fingerprints mean it is fresh."""
    return json_digest({"stage": stage, "settings": settings, "data": signature, "versions": versions or {}})


def corpus_manifest(spark: SparkSession, path: str, evidence: dict) -> dict:
    """Bytes, lines and checksum of a corpus (its files in order), with the evidence of how it was made."""
    sums = checksums(file_list(spark, [path])).orderBy("path")
    rows = [(r["path"].rsplit("/", 1)[-1], r["bytes"], r["newlines"], r["sha256"]) for r in sums.toLocalIterator()]
    return {"files": [[n, h] for n, _, _, h in rows], "bytes": sum(r[1] for r in rows), "lines": sum(r[2] for r in rows), **evidence}


def manifest_problems(spark: SparkSession, path: str, manifest: dict, evidence: dict) -> list[str]:
    """Fields of a corpus manifest that no longer hold."""
    now = corpus_manifest(spark, path, evidence)
    return sorted(k for k in now.keys() | manifest.keys() if now.get(k) != manifest.get(k))


def audit_changes(stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """``key, column, stored, now``: counts of an audit that differ from its stored form, missing sources included."""
    names = [c for c in now.columns if c != key]
    long = lambda df, side: df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias(side)) for n in names])).alias("x")).select(key, "x.column", f"x.{side}")
    both = long(stored, "stored").join(long(now, "now"), [key, "column"], "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("now")))


def redacted(settings: dict, hidden: dict[str, str]) -> dict:
    """A copy of the settings in which the values at dotted paths are replaced; absent and null ones stay so."""
    out = json.loads(json.dumps(settings))
    for path, mark in hidden.items():
        *above, last = path.split(".")
        at = out
        for k in above:
            at = at.get(k) if isinstance(at, dict) else None
        if isinstance(at, dict) and at.get(last) is not None:
            at[last] = mark
    return out


def components(value: object, depth: int = 0) -> Iterator[str]:
    """All strings inside a JSON value, eight levels down; fields that begin with an underscore are not looked into."""
    if depth > 8:
        return
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            if not k.startswith("_"):
                yield from components(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from components(v, depth + 1)


def component_hits(df: DataFrame, id_col: str, json_col: str, deny: DataFrame) -> DataFrame:
    """Ids of rows any of whose components has a listed content hash. Broken JSON has no components, null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = set(components(json.loads(text)))
                except ValueError:
                    continue
                ids += [i] * len(found)
                texts += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(texts, pa.string())], [id_col, "component"])

    rows = df.filter(F.col(id_col).isNotNull() & F.col(json_col).isNotNull()).select(id_col, json_col)
    parts = rows.mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, component string")
    return parts.select(id_col, content_hash(F.col("component")).alias("hash")).join(deny.select("hash").distinct(), "hash", "left_semi").select(id_col).distinct()


def publication_problems(files: DataFrame, suffixes: tuple[str, ...], names: str, contents: dict[str, str]) -> DataFrame:
    """``path, problem`` of files (``path, value``: one row per line) that must not be published: by suffix, name or content."""
    base = F.element_at(F.split("path", "/"), -1)
    by_path = F.array_compact(F.array(F.when(base.rlike("(?i)\\.(" + "|".join(suffixes) + ")$"), F.lit("suffix")), F.when(base.rlike(names), F.lit("name"))))
    by_line = F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.lit(n)) for n, p in contents.items()]))
    return files.select("path", F.explode(F.concat(by_path, by_line)).alias("problem")).distinct()


def template_problems(template: str, fields: tuple[str, ...]) -> list[str]:
    """Why a prompt template cannot be used: it is blank, lacks a field, or names another."""
    used = {name for _, name, _, _ in string.Formatter().parse(template) if name is not None}
    return (["blank"] if not template.strip() else []) + [f"missing {f}" for f in fields if f not in used] + [f"unknown {f}" for f in sorted(used - set(fields))]


def settings_problems(settings: dict, ranges: dict[str, tuple[float, float]], ratios: tuple[str, ...] = ()) -> list[str]:
    """Dotted settings that are no number inside their range, and ratios that do not add up to one."""
    flat = {}
    stack: list[tuple[str, object]] = [("", settings)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        else:
            flat[path] = v
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    out = [p for p, (low, high) in ranges.items() if not number(flat.get(p)) or not low <= flat[p] <= high]
    if ratios and (not all(number(flat.get(r)) for r in ratios) or abs(sum(flat[r] for r in ratios) - 1) > 1e-9):
        out.append("+".join(ratios))
    return sorted(out)


def first_complete(candidates: DataFrame, wanted: str | None, stages: tuple[str, ...] = ("dpo", "sft", "pretrain")) -> DataFrame:
    """The checkpoint to use (``path, stage, complete``): the wanted path if it is complete, else the first complete stage's."""
    rank = F.when(F.col("path") == F.lit(wanted), -1).otherwise(F.coalesce(F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")), F.lit(0)).cast("int") - 1)
    ranked = candidates.filter("complete").withColumn("_rank", F.when(F.col("path") == F.lit(wanted), F.lit(-1)).otherwise(F.when(F.col("stage").isin(*stages), rank)))
    return ranked.filter("_rank IS NOT NULL").orderBy("_rank", "path").limit(1).drop("_rank")
