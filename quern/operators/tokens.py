"""Token rows: chunks, packing by shard, labels, collation geometry, preference truncation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.plans.shared import before_blocks, in_blocks, materialize

IGNORED = -100
#: Ids of a shard that one task packs in order; each such range begins a new bin, which wastes less than a bin a range.
PACK_RANGE = 1_000_000


def chunks(values: Column, size: int) -> Column:
    """Slices of at most ``size``; none for an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.slice(values, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))


def has_loss(labels: Column) -> Column:
    """A label after the first place counts."""
    return F.exists(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != IGNORED)


def chunk_rows(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """``id, chunk_no, input_ids, labels``: chunks of more than one token with a label that counts."""
    zipped = F.arrays_zip(chunks(F.col("input_ids"), size).alias("input_ids"), chunks(F.coalesce("labels", "input_ids"), size).alias("labels"))
    rows = df.select(id_col, F.posexplode(zipped).alias("chunk_no", "c")).select(id_col, "chunk_no", "c.input_ids", "c.labels")
    return rows.filter((F.size("input_ids") > 1) & has_loss(F.col("labels")))


def with_final(values: Column, size: int, end: int) -> Column:
    """Chunks whose last token is the end token, overwriting one where none stands."""
    return F.transform(chunks(values, size), lambda c: F.when(F.element_at(c, -1) == end, c).when(F.size(c) < size, F.concat(c, F.array(F.lit(end)))).otherwise(F.concat(F.slice(c, 1, F.lit(size - 1)), F.array(F.lit(end)))))


def _ranges(df: DataFrame, shard: str, order: str, length: str) -> DataFrame:
    rows = df.select(F.floor(F.col(order) / PACK_RANGE).cast("long").alias("_range"), F.col(shard).cast("long"), F.col(order).cast("long"), F.col(length).cast("long"))
    return rows.repartition(shard, "_range").sortWithinPartitions(shard, "_range", order)


def _by_range(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Run a fold over shards with (shard, range) in the place of the shard, and give both back."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, int]] = {}
        last: tuple[int, int] | None = None

        def numbered() -> Iterator[pa.RecordBatch]:
            nonlocal last
            for b in batches:
                parts = []
                for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if key != last:
                        last = key
                        known[len(known)] = key
                    parts.append(len(known) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *b.columns[2:]], ["part", *b.schema.names[2:]])

        for out in run(numbered()):
            keys = [known[p] for p in out.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in keys], pa.int64()), pa.array([s for _, s in keys], pa.int64()), *out.columns[1:]], ["_range", *out.schema.names])

    return both


def _renumbered(rows: DataFrame, shard: str) -> DataFrame:
    """Bins (0 and up) and chunks (-1 and down) numbered on through the ranges of a shard."""
    rows = materialize(rows, "packed")
    w = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    used = rows.groupBy(shard, "_range").agg(F.coalesce(F.max(F.when(F.col("bin") >= 0, F.col("bin"))) + 1, F.lit(0)).alias("_b"), F.coalesce(-F.min(F.when(F.col("bin") < 0, F.col("bin"))), F.lit(0)).alias("_c"))
    before = used.select(shard, "_range", F.coalesce(F.sum("_b").over(w), F.lit(0)).alias("_b"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c"))
    out = rows.join(before, [shard, "_range"])
    return out.withColumn("bin", F.when(F.col("bin") >= 0, F.col("bin") + F.col("_b")).otherwise(F.col("bin") - F.col("_c"))).select(*[c for c in rows.columns if c != "_range"])


def greedy_bins(df: DataFrame, shard: str, order: str, length: str, capacity: int) -> DataFrame:
    """``shard, order, bin, length``: items in order, a new bin where the next does not fit; shards are packed apart.

    The fold runs over sorted batches with one number of state. A shard is cut into ranges of PACK_RANGE ids, which are packed
    apart, each from a new bin on, so a hot shard is spread over tasks; bins are numbered on through the ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, number = None, 0, 0
        for batch in batches:
            shards, lengths = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            bins = np.zeros(len(shards), dtype=np.int64)
            for i, (s, n) in enumerate(zip(shards, lengths.tolist())):
                if s != now:
                    now, used, number = s, 0, 0
                elif used + n > capacity and used:
                    number, used = number + 1, 0
                used += n
                bins[i] = number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins)], [shard, order, length, "bin"])

    return _renumbered(_ranges(df, shard, order, length).mapInArrow(_by_range(run), f"_range long, {shard} long, {order} long, {length} long, bin long"), shard)


def greedy_packs(df: DataFrame, shard: str, order: str, length: str, capacity: int) -> DataFrame:
    """``shard, order, start, length, bin``: as :func:`greedy_bins`, but items over the capacity are cut into chunks.

    A chunk is a bin of its own, numbered -1, -2 and on, and leaves the open bin open. Every token is in one bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, number, cut = None, 0, 0, 0
        names = [shard, order, "start", length, "bin"]
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for s, k, n in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now:
                    now, used, number, cut = s, 0, 0, 0
                if n > capacity:
                    for start in range(0, n, capacity):
                        cut -= 1
                        out.append((s, k, start, min(capacity, n - start), cut))
                    continue
                if used + n > capacity:
                    number, used = number + 1, 0
                used += n
                out.append((s, k, 0, n, number))
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return _renumbered(_ranges(df, shard, order, length).mapInArrow(_by_range(run), f"_range long, {shard} long, {order} long, start long, {length} long, bin long"), shard)


def position_ids(lens: Column) -> Column:
    """Positions that start over with every document of a packed row."""
    return F.flatten(F.transform(F.filter(lens, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1)))


def document_ids(lens: Column) -> Column:
    return F.flatten(F.transform(lens, lambda n, i: F.array_repeat(i, n)))


def padded(values: Column, size: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(size - F.size(values), F.lit(0))))


def collated(df: DataFrame, id_col: str, batch: int, pad: int) -> DataFrame:
    """Rows of a batch (by id) padded to its longest: ids, labels, mask, and geometry."""
    w = Window.partitionBy("batch_no")
    rows = df.withColumn("batch_no", F.floor(F.col(id_col) / batch)).withColumn("width", F.max(F.size("input_ids")).over(w))
    return rows.select(
        id_col,
        "batch_no",
        padded(F.col("input_ids"), F.col("width"), pad).alias("input_ids"),
        padded(F.col("labels"), F.col("width"), IGNORED).alias("labels"),
        F.concat(F.transform("input_ids", lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.col("width") - F.size("input_ids"))).alias("attention_mask"),
    )


def preference_sequence(prompt: Column, answer: Column, end: int, limit: int) -> tuple[Column, Column]:
    """Ids and labels of prompt + answer + end: overflow trims the prompt's head, an over-long answer keeps its tail."""
    tail = F.concat(answer, F.array(F.lit(end)))
    kept = F.when(F.size(tail) > limit, F.slice(tail, F.size(tail) - limit + 1, F.lit(limit))).otherwise(tail)
    room = F.lit(limit) - F.size(kept)
    head = F.when(room <= 0, F.array().cast("array<int>")).when(F.size(prompt) > room, F.slice(prompt, F.size(prompt) - room + 1, room)).otherwise(prompt)
    return F.concat(head, kept), F.concat(F.transform(head, lambda x: F.lit(IGNORED)), kept)


def recent_prompt(ids: Column, budget: int) -> Column:
    """The first id and the last ``budget - 1``."""
    return F.when(F.size(ids) <= budget, ids).otherwise(F.concat(F.slice(ids, 1, 1), F.slice(ids, F.size(ids) - (budget - 2), F.lit(budget - 1))))


def code_point_tokens(text: Column) -> Column:
    """The test tokenizer: begin, 20 + code point modulo 200 each, end."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lit(20) + F.pmod(F.ascii(c), F.lit(200)))
    return F.concat(F.array(F.lit(1)), points, F.array(F.lit(2)))


def assistant_labels(ids: Column, mask: Column) -> Column:
    """Labels of begin + ids + end: ids the mask marks are kept, others ignored; the end counts if the last id does."""
    inner = F.slice(ids, F.lit(2), F.size(ids) - 2)
    kept = F.zip_with(inner, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))
    last = F.when(F.element_at(mask, -1) == 1, F.element_at(ids, -1)).otherwise(F.lit(IGNORED))
    return F.concat(F.array(F.lit(IGNORED)), kept, F.array(last))


def segment_means(df: DataFrame, row: str, segment: str, place: str, value: str) -> DataFrame:
    """Running mean within each segment of a packed row, and whether a segment begins at a place; long rows go in blocks."""
    rows = in_blocks(df.select(row, segment, place, value), place, "segments")
    inside = Window.partitionBy(row, segment, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(row, "_block").orderBy(place)
    sums = before_blocks(rows, [row, segment], s=(F.sum(value), F.sum), n=(F.count(value), F.sum))
    last = before_blocks(rows, [row], last=(F.max(F.struct(place, segment)), F.max))
    before = F.when(F.row_number().over(along) == 1, F.col(f"last.{segment}")).otherwise(F.lag(segment).over(along))
    mean = (F.sum(value).over(inside) + F.coalesce("s", F.lit(0.0))) / (F.count(value).over(inside) + F.coalesce("n", F.lit(0)))
    out = rows.join(last, [row, "_block"]).withColumn("_before", before).join(sums, [row, segment, "_block"])
    return out.select(row, segment, place, mean.alias("mean"), (F.col("_before").isNull() | (F.col("_before") != F.col(segment))).alias("begins"))


def batch_steps(batches: Column, epochs: int, micro_batch: int, sequence: int, target_tokens: int, world: int = 1, fallback: int = 1) -> tuple[Column, Column]:
    """Micro-steps gathered per optimizer step so that it sees at least the target tokens, and optimizer steps of a training."""
    gathered = F.greatest(F.lit(fallback), F.ceil(F.lit(target_tokens) / F.lit(max(1, micro_batch * sequence * max(1, world)))))
    return gathered, F.greatest(F.lit(1), F.lit(epochs) * F.ceil(F.greatest(F.lit(1), batches) / gathered))


def masked_blocks(df: DataFrame, key: str, ids: str, labels: str, lens: str, mask_id: int, size: int, rate: float) -> DataFrame:
    """``key, input_ids, labels, start, end``: one supervised block of every row corrupted for denoising; rows without one are left out.

    A place among the supervised ones is chosen by hash of ``key``; the block of ``size`` that holds it, counted from the
    start of its document (``lens``), is corrupted: each of its supervised tokens is masked with probability ``rate``, the
    chosen one if none is. Labels keep the masked tokens only. What follows ``end`` is hidden from attention.
    """
    draw = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = F.size("ids")
    total = F.aggregate("lens", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))  # borders of documents
    rows = df.select(key, F.col(ids).alias("ids"), F.col(labels).alias("labels"), F.col(lens).alias("lens"))
    rows = rows.withColumn("place", F.filter(F.transform("labels", lambda y, i: F.when(y != IGNORED, i)), lambda i: i.isNotNull())).filter("size(place) > 0")
    rows = rows.withColumn("chosen", F.element_at("place", (F.floor(draw(F.col(key), F.lit("place")) * F.size("place")) + 1).cast("int"))).withColumn("borders", total)
    rows = rows.withColumn("low", F.array_max(F.filter("borders", lambda e: e <= F.col("chosen")))).withColumn("high", F.coalesce(F.array_min(F.filter("borders", lambda e: e > F.col("chosen"))), n))
    rows = rows.withColumn("start", (F.col("low") + F.floor((F.col("chosen") - F.col("low")) / size) * size).cast("int"))
    rows = rows.withColumn("end", F.least(F.col("high"), F.col("start") + size, n).cast("int"))
    rows = rows.withColumn("drawn", F.filter("place", lambda i: (i >= F.col("start")) & (i < F.col("end")) & (draw(F.col(key), i) < rate)))
    rows = rows.withColumn("masked", F.when(F.size("drawn") > 0, F.col("drawn")).otherwise(F.array("chosen")))
    hit = lambda i: F.array_contains("masked", i)
    return rows.select(
        key,
        F.transform("ids", lambda x, i: F.when(hit(i), F.lit(mask_id)).otherwise(x)).alias("input_ids"),
        F.transform("ids", lambda x, i: F.when(hit(i), x).otherwise(F.lit(IGNORED))).alias("labels"),
        "start",
        "end",
    )


def round_trip_problems(df: DataFrame, id_col: str, text_col: str, load: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]], unknown: int | None = None) -> DataFrame:
    """``id, reason`` of texts that a tokenizer does not give back: an unknown id, or other text. ``load`` makes encoder and decoder in a worker."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = load()
        for batch in batches:
            ids, reasons = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = encode(text)
                reason = "unknown id" if unknown in out and unknown is not None else "other text" if decode(out) != text else None
                if reason:
                    ids.append(i)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(reasons, pa.string())], [id_col, "reason"])

    return df.filter(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, reason string")


def digit_pieces(pieces: list[str]) -> list[str]:
    """Vocabulary pieces with more than one decimal digit, which a tokenizer that splits digits must not have."""
    return [p for p in pieces if sum(c.isdecimal() for c in p) > 1]
