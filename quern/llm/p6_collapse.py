"""Problem 6: records that are identical except for formatting, collapsed to one with its number of copies.

Method: progressive partition refinement. Every record gets two invariants that formatting and field order cannot change:
its number of letters and digits, and a fingerprint of its letter histogram (a sum over mixed code points, so order plays
no part), of the text and, where they differ, of the parsed fields. Only the ids of classes with several members go on to the costlier keys: the sequence of letters and digits,
and, for serialized records, the set of their fields. Classes that fall apart into single records end there.

Texts are compared by casefold. A JSON object or lines of ``key: value`` equal any record with the same fields and values
in any order. Records with the same sequence share one class even if only one of them can be parsed into fields.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.kernels import alnum_table, mix64, slabs, strings, to_codepoints
from quern.llm.p2_groups import components
from quern.plans.shared import attach_by_key, materialize, materialize_counted

_LINE = re.compile(r"^\s*([^\s:：][^:：\n]{0,40}?)\s*[:：]\s*(.*?)\s*$")
_NOT_ALNUM = re.compile(r"[\W_]+")
_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"\s*[:：]\s*(?:"((?:[^"\\]|\\.)*)"|([^,{}\[\]"]+))')


def bare(text: str) -> str:
    """Letters and digits of a text, casefolded."""
    return _NOT_ALNUM.sub("", text.casefold())


def _flat(value: object) -> str:
    """A field's value in one spelling; nested objects in key order, lists in their own order."""
    if isinstance(value, dict):
        return "{" + "\x1e".join(sorted(bare(str(k)) + "\x1f" + _flat(v) for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + "\x1e".join(map(_flat, value)) + "]"
    return bare("" if value is None else str(value))


def fields_of(text: str) -> list[str] | None:
    """Sorted ``key, value`` strings of a serialized record, or None if the text is none.

    JSON whose punctuation or spacing was damaged is still read pair by pair.
    """
    body = text.strip().lstrip("﻿​").strip()
    if body[:1] == "{":
        try:
            value = json.loads(body)
            if isinstance(value, dict) and value:
                return sorted(bare(str(k)) + "\x1f" + _flat(v) for k, v in value.items())
        except ValueError:
            pass
        pairs = _PAIR.findall(body)
        if pairs and bare("".join(a + b + c for a, b, c in pairs)) == bare(body):
            return sorted(bare(k) + "\x1f" + bare(a or b) for k, a, b in pairs)
        return None
    lines = [x for x in body.splitlines() if bare(x)]
    found = [_LINE.match(x) for x in lines]
    if len(found) < 2 or not all(found):
        return None
    pairs = [(bare(m[1]), bare(m[2])) for m in found if m]
    if not all(k for k, _ in pairs) or len({k for k, _ in pairs}) < len(pairs):
        return None
    return sorted(k + "\x1f" + v for k, v in pairs)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def invariants(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_letters, histogram`` of every text with letters or digits: what formatting and field order cannot change.

    A record whose fields, as parsed, hold other letters than its text (escapes, null) has a second row for its fields, so
    that it meets records of the same sequence and records of the same fields.
    """
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("n_letters", T.LongType()),
            T.StructField("histogram", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in slabs(texts):
                part = texts[a:b]
                fields = {i: f for i, t in enumerate(part) if (":" in t or "：" in t) and (f := fields_of(t))}
                source = np.array([*range(len(part)), *fields], dtype=np.int64)
                cps, offsets = to_codepoints([t.casefold() for t in (*part, *map("".join, fields.values()))])
                ok = alnum_table()[cps]
                with np.errstate(over="ignore"):
                    total = np.concatenate(([np.uint64(0)], np.cumsum(np.where(ok, mix64(cps), np.uint64(0)))))
                    histogram = total[offsets[1:]] - total[offsets[:-1]]
                many = np.concatenate(([0], np.cumsum(ok)))
                many = many[offsets[1:]] - many[offsets[:-1]]
                same = (many == many[source]) & (histogram == histogram[source])
                keep = np.flatnonzero((many > 0) & (~same | (np.arange(len(source)) < len(part))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(source[keep])),
                        pa.array(many[keep], pa.int64()),
                        pa.array(histogram[keep].view(np.int64), pa.int64()),
                    ],
                    schema.fieldNames(),
                )

    return df.select(id_col, text_col).filter(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def equality_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, seq, fields``: digests of the letter sequence and, for serialized records, of the set of fields."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("seq", T.StringType()), T.StructField("fields", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            fields = [fields_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_digest(bare(t)) for t in texts]), pa.array([None if f is None else _digest("\x1d".join(f)) for f in fields], pa.string())],
                schema.fieldNames(),
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, keep_id, copies`` for every record of a class of two or more equal records.

    Defined cases: null texts and texts without letters and digits are in no class; null ids are left out, as they name
    no record; a repeated id counts once per distinct text class; an empty table gives an empty table; other columns are
    not carried, so clashing names do no harm. Very long texts are compared whole. Ties cannot occur: keep_id is the least id.
    """
    coarse = materialize(invariants(df, id_col, text_col), "p6-coarse")
    sizes = coarse.groupBy("n_letters", "histogram").agg(F.count("*").alias("n"))
    several = sizes.filter("n > 1").withColumn("cell", F.xxhash64("n_letters", "histogram"))
    total = coarse.count()
    cells = several.groupBy("cell").agg(F.sum("n").alias("n"))
    suspects = attach_by_key(coarse.withColumn("cell", F.xxhash64("n_letters", "histogram")), cells, "cell", "id", "n", total).select("id")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(suspects.distinct(), "id", "left_semi")
    keyed = materialize(equality_keys(rows, "id", "text"), "p6-keys")
    # A sequence takes the field set of any member that could be parsed, so both ways of being equal form one class.
    by_seq = keyed.groupBy("seq").agg(F.min("fields").alias("of_seq"), F.max("fields").alias("other"), F.min("id").alias("least"), F.count("*").alias("n"))
    by_seq, ways = materialize_counted(by_seq, "p6-sequences", F.count_if(F.col("of_seq") != F.col("other")).alias("several"))
    if ways.get("several"):  # one sequence of letters can be written as different records, which joins their classes
        split = keyed.join(by_seq.filter("of_seq <> other").select("seq", "of_seq"), "seq").filter("fields IS NOT NULL")
        number = lambda c: F.conv(F.substring(c, 1, 15), 16, 10).cast("long")
        edges = split.select(number(F.col("of_seq")).alias("u"), number(F.col("fields")).alias("v"))
        roots = components(edges)
        ends = split.select(F.explode(F.array("of_seq", "fields")).alias("of_seq")).distinct().withColumn("v", number(F.col("of_seq")))
        whole = ends.join(roots, "v", "left").select("of_seq", F.coalesce("root", "v").alias("root"))
        names = materialize(whole.join(whole.groupBy("root").agg(F.min("of_seq").alias("name")), "root").select("of_seq", "name"), "p6-names")
        by_seq = by_seq.join(names, "of_seq", "left").withColumn("of_seq", F.coalesce("name", "of_seq")).drop("name")
    by_seq = by_seq.withColumn("class", F.coalesce("of_seq", "seq"))
    by_class = by_seq.groupBy("class").agg(F.min("least").alias("keep_id"), F.sum("n").alias("copies"))
    facts = by_seq.join(by_class.filter("copies > 1"), "class").select("seq", "n", "keep_id", "copies")
    return attach_by_key(keyed.select("id", "seq"), facts, "seq", "id", "n", total).select("id", "keep_id", "copies")


def found(df: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """``keep_id, copy_id``: one row for each record other than the kept one of its class."""
    c = classes(df, id_col, text_col)
    return c.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()


__all__ = ["bare", "classes", "equality_keys", "fields_of", "found", "invariants"]
