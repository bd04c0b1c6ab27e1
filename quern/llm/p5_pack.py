"""Problem 5: filling rows of fixed capacity with items of varying length.

Method: pattern packing by non-negative least squares. The histogram of item lengths (at most ``capacity`` counts, whatever
the number of items) is all that the plan depends on. Lengths of larger items are rounded up to a grid; all patterns of few
documents that fill a row on the grid are enumerated; NNLS fits how often each pattern repeats so that the patterns use up
the histogram; repeat counts are rounded down; what remains, and all small items, is packed by best fit decreasing into the
true free space of the rows. Rows of equal content form one group, so the plan works on groups, never on single rows.

The plan is a table of rank ranges: the r-th item of a length goes to one row at one offset. Items are ranked within
(length, salt) cells, so a length that a third of all items share is spread over many tasks, and looked up in the table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.plans.shared import materialize

CAPACITY = 2048
#: Grid steps per row, documents per pattern, and the least grid length that patterns use; smaller items fill the gaps.
GRID, MOST, LEAST = 64, 4, 4
#: Items per (length, salt) cell, on average, for lengths with more.
CELL = 500_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x = np.zeros(n)
    free = np.zeros(n, dtype=bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= scale:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            dropped = free & (x <= 1e-12)
            if not dropped.any():
                dropped = low
            free &= ~dropped
            x[~free] = 0
    return x


def patterns(grid: int = GRID, most: int = MOST, least: int = LEAST) -> list[tuple[int, ...]]:
    """All multisets of at most ``most`` grid lengths >= ``least`` that fill a row on the grid, longest first."""
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int, upto: int) -> None:
        if chosen and left < 2:
            out.append(chosen)
            return
        if len(chosen) == most:
            return
        for x in range(min(left, upto), least - 1, -1):
            # The remaining places must be able to fill the row.
            if x * (most - len(chosen)) < left - 1:
                break
            grow((*chosen, x), left - x, x)

    grow((), grid, grid)
    return out


@dataclass
class Plan:
    """Rank ranges: items of ``length`` with rank in [first, first + count) go to rows base, base + 1, ... at ``offset``."""

    capacity: int
    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    rows: int = 0

    def put(self, length: int, first: int, count: int, base: int, offset: int) -> None:
        for store, x in zip((self.length, self.first, self.count, self.base, self.offset), (length, first, count, base, offset)):
            store.append(x)

    def arrays(self) -> tuple[np.ndarray, ...]:
        a = [np.array(x, dtype=np.int64) for x in (self.length, self.first, self.count, self.base, self.offset)]
        order = np.lexsort((a[1], a[0]))
        return tuple(x[order] for x in a)


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the items of each length go. Depends on the histogram only; lengths lie in 1 .. capacity."""
    plan = Plan(capacity)
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    groups: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []

    def offer(space: int, count: int, base: int) -> None:
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append((count, base))

    step = -(-capacity // GRID)
    grid = -(-capacity // step)
    of_level = {g: [x for x in range(min(g * step, capacity), (g - 1) * step, -1)] for g in range(LEAST, grid + 1)}
    level = np.array([left[of_level[g]].sum() if g in of_level else 0 for g in range(grid + 1)], dtype=np.int64)
    if level.sum():
        options = [p for p in patterns(grid) if all(level[x] for x in p)]
        if options:
            a = np.zeros((grid + 1, len(options)))
            for k, p in enumerate(options):
                for x in p:
                    a[x, k] += 1
            fit = nnls(a, level.astype(float))
            for k in np.argsort(-fit, kind="stable"):
                pattern = options[k]
                many = min([int(fit[k]), *(int(level[x] // pattern.count(x)) for x in set(pattern))])
                if many <= 0:
                    continue
                # Each place of the pattern takes a run of items, longest first; rows of equal content form groups.
                runs = []
                for x in pattern:
                    need, run = many, []
                    for length in of_level[x]:
                        take = min(need, int(left[length]))
                        if take:
                            run.append((length, int(used[length]), take))
                            used[length] += take
                            left[length] -= take
                            need -= take
                        if not need:
                            break
                    level[x] -= many
                    runs.append(run)
                borders = sorted({0, many, *(b for run in runs for b in np.cumsum([c for _, _, c in run]).tolist())})
                for lo, hi in zip(borders, borders[1:]):
                    fill = 0
                    for run in runs:
                        at = 0
                        for length, first, c in run:
                            if at <= lo < at + c:
                                plan.put(length, first + lo - at, hi - lo, plan.rows + lo, fill)
                                fill += length
                                break
                            at += c
                    offer(capacity - fill, hi - lo, plan.rows + lo)
                plan.rows += many
    for length in range(capacity, 0, -1):
        need = int(left[length])
        while need:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                fresh = -(-need // (capacity // length))
                offer(capacity, fresh, plan.rows)
                plan.rows += fresh
                continue
            space = spaces[k]
            count, base = groups[space].pop()
            if not groups[space]:
                del groups[space], spaces[k]
            take = min(need, count)
            plan.put(length, int(used[length]), take, base, capacity - space)
            used[length] += take
            need -= take
            if space > length:
                offer(space - length, take, base)
            if count > take:
                offer(space, count - take, base + take)
    return plan


def items(df: DataFrame, id_col: str, ids_col: str, lens_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``seq_id, item_no, part_no, start, length``: the items of all rows, those longer than ``capacity`` in parts."""
    schema = T.StructType.fromDDL("seq_id long, item_no int, part_no int, start int, length int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, size, lens = batch.columns
            size = size.to_numpy(zero_copy_only=False).astype(np.int64)
            given = lens.is_valid().to_numpy(zero_copy_only=False)
            at = lens.offsets.to_numpy().astype(np.int64)
            flat = lens.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            many = np.where(given, np.diff(at), 1)
            row = np.repeat(np.arange(len(size)), many)
            no = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            spot = np.minimum(at[:-1][row] + no, max(len(flat) - 1, 0))
            length = np.where(given[row], np.maximum(flat[spot], 0) if len(flat) else 0, size[row])
            ends = np.cumsum(length)
            ends -= np.concatenate(([0], ends))[np.cumsum(many) - many][row]
            start = np.minimum(ends - length, size[row])
            length = np.minimum(ends, size[row]) - start  # no item reaches beyond its row
            parts = -(-length // capacity)
            back = np.repeat(np.arange(len(row)), parts)
            part = np.arange(len(back)) - np.repeat(np.cumsum(parts) - parts, parts)
            yield pa.RecordBatch.from_arrays(
                [
                    seq.take(pa.array(row[back])),
                    pa.array(no[back], pa.int32()),
                    pa.array(part, pa.int32()),
                    pa.array(start[back] + part * capacity, pa.int32()),
                    pa.array(np.minimum(capacity, length[back] - part * capacity), pa.int32()),
                ],
                schema.fieldNames(),
            )

    rows = df.filter(F.col(ids_col).isNotNull()).select(F.col(id_col).cast("long"), F.size(ids_col).alias("n"), F.col(lens_col).cast("array<int>").alias("lens"))
    return rows.mapInArrow(run, schema)


def pack(df: DataFrame, id_col: str = "seq_id", ids_col: str = "input_ids", lens_col: str = "seq_lens", capacity: int = CAPACITY) -> DataFrame:
    """``row_id, row_offset, seq_id, item_no, part_no, start, length``: the place of every item (or part) in packed rows.

    Defined cases: a null or empty ``input_ids`` has no items; null ``seq_lens`` means one item; lengths null or below
    zero count as zero, items without tokens take no place and have no row; lengths beyond the row's end are cut to it;
    only an item longer than ``capacity`` is cut. Rows with equal or null ids are packed each, ties are ordered by
    position. An empty table gives an empty table; other columns are not carried.
    """
    found = materialize(items(df, id_col, ids_col, lens_col, capacity), "p5-items")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = make_plan(histogram, capacity)
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(plan.arrays())
    salts = max(1, max(histogram.values(), default=0) // CELL)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("seq_id", "item_no", "part_no"), F.lit(salts)))
    cell = Window.partitionBy("length", "salt").orderBy("seq_id", "item_no", "part_no", "start")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = salted.withColumn("k", F.row_number().over(cell) - 1).join(cells, ["length", "salt"])
    ranked = ranked.select("seq_id", "item_no", "part_no", "start", "length", (F.col("k") + F.col("skip")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, base, offset = held.value
        wide = np.int64(1) << 42
        keys = length * wide + first
        for batch in batches:
            own = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            spot = np.searchsorted(keys, own * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(base[spot] + rank - first[spot], pa.int64()), pa.array(offset[spot], pa.int32()), *batch.columns[:5]],
                ["row_id", "row_offset", "seq_id", "item_no", "part_no", "start", "length"],
            )

    return ranked.mapInArrow(place, "row_id long, row_offset int, seq_id long, item_no int, part_no int, start int, length int")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: packed rows, tokens, least possible rows, and the share of space unused."""
    rows = packed.groupBy("row_id").agg(F.sum("length").alias("used"))
    total = rows.agg(F.count("*").alias("packed_rows"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity).alias("least_rows")
    return total.select("packed_rows", "tokens", least, (1 - F.col("tokens") / (F.col("packed_rows") * capacity)).alias("unused_share"))
