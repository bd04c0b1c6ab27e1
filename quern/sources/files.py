"""Sources: JSONL, JSON envelopes, text, CSV and TSV files, denylists, checksums; each a lazy DataFrame.

Rows keep their place: ``path`` and ``row_no`` (order within the file), so that "first wins" is defined. A source of any
number of files is one scan a format.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMATS = ("jsonl", "jl", "json", "txt", "csv", "tsv")
# Keys that make an object a record of its own, and keys under which envelopes keep their rows.
RECORD_KEYS = ("text", "messages", "instruction", "prompt", "ko", "ja")
ENVELOPE_KEYS = ("data", "rows", "records", "items", "examples")
#: Bytes read at a time for a checksum.
CHUNK = 8 << 20


def _glob(pattern: str) -> re.Pattern[str]:
    """A glob over whole paths: ``**`` spans folders, ``*`` and ``?`` do not."""
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]+\])", pattern):
        known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        out.append(known.get(part) or (part.replace("[!", "[^") if part.startswith("[") and part.endswith("]") else re.escape(part)))
    return re.compile("".join(out))


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files behind paths and globs, each once, sorted. ``**`` stands for any number of folders."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: set[str] = set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p if "**" not in p else p[: p.index("**")].rsplit("/", 1)[0] or "/")
        fs = path.getFileSystem(conf)
        if "**" not in p:
            found |= {s.getPath().toString() for s in fs.globStatus(path) or []}
            continue
        like = _glob(re.sub(r"^[a-z][a-z0-9+.\-]*:(?://[^/]*)?(?=/)", "", p))
        for base in fs.globStatus(path) or []:
            files = fs.listFiles(base.getPath(), True)
            while files.hasNext():
                full = files.next().getPath()
                if like.fullmatch(full.toUri().getPath()):
                    found.add(full.toString())
    return sorted(found)


def _placed(df: DataFrame) -> DataFrame:
    """Place of each row in its file; the id ascends with the file's blocks and rows."""
    return df.withColumn("path", F.col("_metadata.file_path")).withColumn("row_no", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """``path, row_no, row VARIANT``. Blank lines are skipped; a broken line fails with its file and text, or is dropped.

    :func:`jsonl_problems` and :func:`check_jsonl` tell the number of a broken line, which takes a count of the lines before.
    """
    lines = _placed(spark.read.text(path)).filter(F.trim("value") != "")
    row = F.try_parse_json("value")
    if not strict:
        return lines.withColumn("row", row).filter("row is not null").select("path", "row_no", "row")
    told = F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("path"), F.lit(": "), F.substring("value", 1, 80)))
    checked = F.when(row.isNull(), told.cast("string")).otherwise(F.col("value"))
    return lines.select("path", "row_no", F.parse_json(checked).alias("row"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, line_no, value``: lines with their number in the file, from 1, however many tasks read it.

    A first scan counts the lines of every block; the second adds the counts of the blocks before.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return lines.join(blocks, ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "value")


def jsonl_problems(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, line_no, value`` of lines that are neither blank nor JSON."""
    return numbered_lines(spark, path).filter((F.trim("value") != "") & F.try_parse_json("value").isNull())


def check_jsonl(spark: SparkSession, path: str | list[str]) -> None:
    """Fail with ``file:line`` of the first broken line."""
    first = jsonl_problems(spark, path).orderBy("path", "line_no").first()
    if first:
        raise ValueError(f"invalid JSON at {first.path}:{first.line_no}")


def json_records(x: object) -> Iterator[object]:
    """Records of a JSON value: lists are walked, question lists opened, envelopes unwrapped."""
    if isinstance(x, list):
        for y in x:
            yield from json_records(y)
        return
    if isinstance(x, dict) and isinstance(x.get("paragraphs"), list):
        for p in (p for p in x["paragraphs"] if isinstance(p, dict)):
            for q in p.get("qas", []):
                first = (q.get("answers") or [None])[0]
                output = first.get("text", "") if isinstance(first, dict) else ""
                yield {"instruction": q.get("question", ""), "input": p.get("context", ""), "output": output, "meta": {"id": q.get("id"), "title": x.get("title")}}
        return
    inner = None
    if isinstance(x, dict) and not any(k in x for k in RECORD_KEYS):
        inner = next((x[k] for k in ENVELOPE_KEYS if isinstance(x.get(k), list)), None)
    if inner is None:
        yield x
    else:
        yield from json_records(inner)


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of whole JSON documents: ``path, row_no, row VARIANT``. A document is one value, so it is read at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [json.dumps(r, ensure_ascii=False) for r in json_records(json.loads(text))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], ["path", "row_no", "row"])

    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return docs.mapInArrow(run, "path string, row_no long, row string").select("path", "row_no", F.parse_json("row").alias("row"))


def read_txt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Header row, all values strings, an empty field the empty string."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"').na.fill("")


def format_of(path: str, data_format: str | None = None) -> str:
    kind = (data_format or path.rsplit(".", 1)[-1]).lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; supported: {', '.join(FORMATS)}")
    return kind


def read_rows(spark: SparkSession, path: str | list[str], data_format: str | None = None) -> DataFrame:
    """``path, row_no, row VARIANT`` of files in one supported format."""
    kind = format_of(path if isinstance(path, str) else path[0], data_format)
    if kind in ("jsonl", "jl"):
        return read_jsonl(spark, path)
    if kind == "json":
        return read_json(spark, path)
    if kind == "txt":
        return read_txt(spark, path).select("path", F.lit(0).cast("long").alias("row_no"), F.to_variant_object(F.struct("text")).alias("row"))
    rows = read_delimited(spark, path, "\t" if kind == "tsv" else ",")
    fields = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row_no"), fields.alias("row"))


def first_row(spark: SparkSession, path: str, data_format: str | None = None) -> DataFrame:
    """The first record of the first file, for checks before a run."""
    return read_rows(spark, expand(spark, [path])[:1], data_format or format_of(path)).orderBy("path", "row_no").limit(1)


def union_scan(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Rows of all sources in order: ``src_ord, source_name, path, row_no, row``. A source without files fails.

    Files of a source are read in one scan a format; header files have one scan each, as their columns may differ.
    """
    scans: list[DataFrame] = []
    for k, s in enumerate(sources):
        files = expand(spark, s.get("paths") or [s["path"]])
        if not files:
            raise FileNotFoundError(f"source {s['name']!r} has no files")
        kinds: dict[str, list[str]] = {}
        for f in files:
            kind = format_of(f, s.get("format"))
            kinds.setdefault(f"{kind} {f}" if kind in ("csv", "tsv") else kind, []).append(f)
        for kind, own in kinds.items():
            scans.append(read_rows(spark, own, kind.split(" ")[0]).select(F.lit(k).alias("src_ord"), F.lit(s["name"]).alias("source_name"), "path", "row_no", "row"))
    if not scans:
        raise ValueError("no sources")
    return reduce(DataFrame.unionByName, scans)


def read_denylist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case SHA-256 lines; comments and blank lines skipped; any other line fails."""
    line = F.trim("value")
    lines = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    good = F.when(line.rlike("^[0-9a-fA-F]{64}$"), F.lower(line)).otherwise(F.raise_error(F.lit("denylist line is no SHA-256")).cast("string"))
    return lines.select(good.alias("hash")).distinct()


def checksums(files: DataFrame) -> DataFrame:
    """``files`` (with a column ``path``) with ``bytes, sha256, newlines``. Files are streamed, so their size does not matter."""
    names = [*files.columns, "bytes", "sha256", "newlines"]
    at = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch.column(at).to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
                digest, size, lines = hashlib.sha256(), 0, 0
                with store.open_input_stream(name) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                        size += len(chunk)
                        lines += chunk.count(b"\n")
                sums.append((size, digest.hexdigest(), lines))
            columns = zip(*sums) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64())))], names)

    spread = files.repartition(max(1, min(1024, files.sparkSession.sparkContext.defaultParallelism)), "path")
    return spread.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in files.dtypes), "bytes long, sha256 string, newlines long"]))


def file_list(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in expand(spark, patterns)], "path string")


def read_log(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a JSONL log as strings, allow-listed keys only; broken lines and lines that are no objects are skipped."""
    rows = read_jsonl(spark, path, strict=False).filter(F.schema_of_variant("row").startswith("OBJECT"))
    return rows.select("path", "row_no", *[F.try_variant_get("row", f"$.{k}", "string").alias(k) for k in keys])


def load_manifest(path: str, known: tuple[str, ...] = ("pack", "sources")) -> list[dict]:
    """Sources from a manifest, a list or a pack with ``sources``; other keys of a pack fail. YAML needs the yaml package."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    if isinstance(data, dict):
        other = sorted(set(data) - set(known))
        if other:
            raise ValueError(f"unknown keys in manifest: {', '.join(other)}")
        data = data.get("sources") or []
    if not isinstance(data, list) or not all(isinstance(s, dict) and s.get("name") for s in data):
        raise ValueError("a manifest lists sources, each with a name")
    return data


def synthetic_lines(spark: SparkSession, n: int, words: tuple[str, ...] = ("river", "lamp", "stone", "paper", "cloud", "garden", "signal", "copper")) -> DataFrame:
    """Deterministic lines of permuted words, for smoke tests."""
    if n < 32:
        raise ValueError("at least 32 lines")
    pool = F.array(*[F.lit(w) for w in words])
    pick = [F.element_at(pool, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(words))) + 1).cast("int")) for k in range(6)]
    return spark.range(n).select(F.col("id").alias("row_no"), F.concat_ws(" ", *pick, F.col("id").cast("string")).alias("text"))


