"""Vector memory: scoring, nearest neighbours, diverse retrieval, retention, clusters and gists.

Vectors stand in arrays of any length; two of different lengths are not compared, and a vector of length zero is similar
to nothing (0).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.numeric import cosine, recency, support_bonus, unit
from quern.plans.shared import materialize

#: Coordinates of the queries that one scan of the memory holds: 32 MB.
QUERY_BLOCK = 4_000_000
#: Similarities are compared to twelve decimals, so that equal vectors tie whatever the order of the sums.
DECIMALS = 12


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors of a column of vectors, by length."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        m = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        yield at, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _blocks(queries: DataFrame, id_col: str, vec_col: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The stated queries a block at a time: ids and unit vectors by length."""
    block, size = [], 0

    def packed(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        vectors = pa.array([r[1] for r in rows], pa.list_(pa.float64()))
        return {m.shape[1]: (np.array([rows[i][0] for i in at]), m) for at, m in unit_rows(vectors)}

    for r in queries.select(F.col(id_col).cast("long"), vec_col).filter(F.col(vec_col).isNotNull()).toLocalIterator():
        block.append(r)
        size += len(r[1])
        if size >= QUERY_BLOCK:
            yield packed(block)
            block, size = [], 0
    if block:
        yield packed(block)


def _scan(memory: DataFrame, queries: DataFrame, id_col: str, vec_col: str, run, schema: str, extra: list[str]) -> DataFrame:  # noqa: ANN001
    """One pass over the memory for each block of queries, which is broadcast (at most QUERY_BLOCK coordinates)."""
    spark = memory.sparkSession
    rows = memory.select(F.col(id_col).cast("long"), vec_col, *extra)
    parts = []
    for block in _blocks(queries, id_col, vec_col):
        held = spark.sparkContext.broadcast(block)
        parts.append(rows.mapInArrow(lambda batches, held=held: run(batches, held.value), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def nearest(memory: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, others: bool = False, weight: float | None = None, bonus: str | None = None, least: float = -1.0) -> DataFrame:
    """``query_id, id, similarity, score, rank``: the ``k`` rows of highest score for each query of a stated set, ids break ties.

    The score is the similarity, or ``weight`` times it (0 at least) plus the row's ``bonus``. Rows below ``least`` in
    similarity are left out, with ``others`` the query itself, too. Each task keeps the best rows of its part while batches
    of similarities (matrix products) go by; only these are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch], held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        bar = {n: np.full(len(q), -np.inf) for n, (q, _) in held.items()}

        def cut(n: int) -> None:
            at, ids, sim, score = (np.concatenate(x) for x in zip(*best[n]))
            order = np.lexsort((ids, -score, at))
            at = at[order]
            first = np.searchsorted(at, at)
            keep = order[np.arange(len(at)) - first < k]
            full = np.bincount(at, minlength=len(bar[n])) >= k
            best[n] = [tuple(x[keep] for x in (np.concatenate(y) for y in zip(*best[n])))]
            last = best[n][0]
            low = np.full(len(bar[n]), np.inf)
            np.minimum.at(low, last[0], last[3])
            bar[n] = np.where(full, low, -np.inf)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            added = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64) if bonus else None
            for rows, m in unit_rows(batch.column(1)):
                n = m.shape[1]
                if n not in held:
                    continue
                names, q = held[n]
                sim = np.round(q @ m.T, DECIMALS)
                score = sim if weight is None else np.round(weight * np.maximum(sim, 0) + (0.0 if added is None else added[rows]), DECIMALS)
                out = sim < least
                if others:
                    out |= names[:, None] == ids[rows][None, :]
                score = np.where(out, -np.inf, score)
                top = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(names), -np.inf)
                at, pos = np.nonzero((score >= np.maximum(top, bar[n])[:, None]) & np.isfinite(score))
                best.setdefault(n, []).append((at, ids[rows][pos], sim[at, pos], score[at, pos]))
                cut(n)
        for n in best:
            at, ids, sim, score = best[n][0]
            yield pa.RecordBatch.from_arrays([pa.array(held[n][0][at]), pa.array(ids), pa.array(sim), pa.array(score)], ["query_id", "id", "similarity", "score"])

    found = _scan(memory, queries, id_col, vec_col, run, "query_id long, id long, similarity double, score double", [bonus] if bonus else [])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similarities(memory: DataFrame, queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``query_id, id, similarity`` of a stated set of queries against all rows, in one pass over the rows a block of queries."""

    def run(batches: Iterator[pa.RecordBatch], held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, m in unit_rows(batch.column(1)):
                names, q = held.get(m.shape[1], (np.zeros(0, dtype=np.int64), np.zeros((0, m.shape[1]))))
                for name, sim in zip(names, np.round(q @ m.T, DECIMALS)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name)), pa.array(ids[rows]), pa.array(sim)], ["query_id", "id", "similarity"])

    return _scan(memory, queries, id_col, vec_col, run, "query_id long, id long, similarity double", [])


def novelty(memory: DataFrame, queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One minus the similarity to the nearest other row, at most one."""
    one = nearest(memory, queries, id_col, vec_col, 1, others=True)
    return one.select("query_id", (1 - F.greatest(F.lit(0.0), F.col("similarity"))).alias("novelty"))


def centroids(df: DataFrame, label: str, vec_col: str, weight: str | None = None) -> DataFrame:
    """Weighted mean of each label's unit vectors by coordinate: ``label, axis, value``."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.05)) if weight else F.lit(1.0)
    rows = df.select(label, w.alias("_w"), F.posexplode(unit(F.col(vec_col))).alias("axis", "_x"))
    return rows.groupBy(label, "axis").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("value"))


def retained(df: DataFrame, score: str, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(score), order).limit(n)


def diverse(memory: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, pool: int, redundancy: float = 0.2, weight: float | None = None, bonus: str | None = None, least: float = -1.0) -> DataFrame:
    """``query_id, rank, id``: greedy choice of ``k`` rows by score less ``redundancy`` times the largest similarity to a chosen one.

    Score, bonus and threshold are those of :func:`nearest`. The choice is tried among the ``pool`` best rows of a query. The
    score bounds a row's value from above, so the choice stands if the last value chosen reaches the least score of the pool.
    Queries where it does not are chosen for in ``k`` rounds over all rows.
    """
    vectors = memory.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
    top = nearest(memory, queries, id_col, vec_col, pool, False, weight, bonus, least).join(vectors, "id").select("query_id", "id", "score", "_v")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack([np.asarray(x, dtype=np.float64) for x in rows["_v"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        score, near, chosen, last = rows["score"].to_numpy(), np.zeros(len(rows)), [], np.inf
        for _ in range(min(k, len(rows))):
            value = np.round(score - redundancy * near, DECIMALS)
            value[chosen] = -np.inf
            # Equal values go to the smaller id.
            best = min(np.flatnonzero(value == value.max()), key=lambda i: rows["id"].iloc[i])
            last = value[best]
            chosen.append(int(best))
            near = np.maximum(near, v @ v[best])
        sure = len(rows) < pool or (len(chosen) == k and last > score[-1])
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": range(1, len(chosen) + 1), "id": rows["id"].iloc[chosen].to_numpy(), "sure": sure})

    tried = materialize(top.groupBy("query_id").applyInPandas(choose, "query_id long, rank int, id long, sure boolean"), "diverse-pool")
    done = tried.filter("sure").select("query_id", "rank", "id")
    open_queries = tried.filter("NOT sure").select("query_id").distinct()
    if open_queries.isEmpty():
        return done
    asked = queries.join(open_queries, F.col(id_col) == F.col("query_id"), "left_semi")
    rows = similarities(memory, asked, id_col, vec_col).filter(F.col("similarity") >= least)
    score = F.col("similarity") if weight is None else F.lit(weight) * F.greatest(F.lit(0.0), F.col("similarity"))
    if bonus:
        score = score + F.col("_bonus")
        vectors = memory.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"), F.col(bonus).alias("_bonus"))
    rows = materialize(rows.join(vectors, "id").select("query_id", "id", score.alias("score"), "_v"), "diverse-all")
    chosen = None  # at most k rows a query
    for turn in range(1, k + 1):
        value, left = F.col("score"), rows
        if chosen is not None:
            held = chosen.groupBy("query_id").agg(F.collect_list("id").alias("_ids"), F.collect_list("_v").alias("_vs"))
            left = rows.join(held, "query_id").filter(~F.array_contains("_ids", F.col("id")))
            near = F.array_max(F.transform("_vs", lambda x: cosine(x, F.col("_v"))))
            value = value - redundancy * F.greatest(F.lit(0.0), near)
        best = left.groupBy("query_id").agg(F.max(F.struct(F.round(value, DECIMALS).alias("value"), (-F.col("id")).alias("minus"), "_v")).alias("b"))
        best = materialize(best.select("query_id", F.lit(turn).alias("rank"), (-F.col("b.minus")).alias("id"), F.col("b._v").alias("_v")), "diverse-round")
        chosen = best if chosen is None else chosen.unionByName(best)
    return done.unionByName(chosen.select("query_id", "rank", "id"))


def memory_bonus(salience: str, age_hours: str, support: str, half_life: float) -> Column:
    """What a memory's salience, recency and support add to a score whose similarity weighs 0.65."""
    return 0.2 * F.col(salience) + 0.1 * recency(F.col(age_hours), half_life) + 0.05 * support_bonus(F.col(support))


def clusters(df: DataFrame, owner: str, id_col: str, vec_col: str, least: float) -> DataFrame:
    """``owner, anchor, id``: in id order, each free row takes the later free rows of its owner that are similar enough.

    So a row belongs to the first anchor it is similar enough to, and is an anchor if there is none. Rows stream through in
    id order and only anchors are held, so an owner of any number of rows completes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held = None, [], np.zeros((0, 0))
        for batch in batches:
            owners, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            anchor = []
            for o, i, x in zip(owners, ids, batch.column(2).to_pylist()):
                v = np.asarray(x, dtype=np.float64)
                v /= max(np.linalg.norm(v), 1e-300)
                if not names or o != now:
                    now, names, held = o, [], np.zeros((16, len(v)))
                near = held[: len(names)] @ v >= least
                if near.any():
                    anchor.append(names[int(np.argmax(near))])
                    continue
                if len(names) == len(held):
                    held = np.concatenate((held, np.zeros_like(held)))
                held[len(names)] = v
                names.append(i)
                anchor.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(anchor, pa.int64()), batch.column(1)], [owner, "anchor", "id"])

    rows = df.select(owner, F.col(id_col).cast("long").alias(id_col), vec_col).repartition(owner).sortWithinPartitions(owner, id_col)
    return rows.mapInArrow(run, f"{owner} {dict(df.dtypes)[owner]}, anchor long, id long")


def gists(df: DataFrame, owner: str, id_col: str, vec_col: str, salience: str, least: float) -> DataFrame:
    """``owner, gist, support, salience, embedding, members``: what clusters of two or more leave behind.

    A cluster's vector is the mean of its members' unit vectors weighted by salience (0.05 at least), of length one. Clusters
    come in the order of their anchors; each joins the first gist of its owner that is similar enough, whose vector becomes
    the mean of both by support, or else begins a new one with the mean salience of its members. Per owner only gists are
    held, so owners of any size stream through. A cluster's coordinates are summed by axis, never gathered as members.
    """
    member = clusters(df, owner, id_col, vec_col, least)
    member = materialize(member.join(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_v"), F.col(salience).cast("double").alias("_s")), "id"), "gist-members")
    w = F.greatest(F.col("_s"), F.lit(0.05))
    axes = member.select(owner, "anchor", w.alias("_w"), F.posexplode(unit(F.col("_v"))).alias("axis", "_x")).groupBy(owner, "anchor", "axis").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("value"))
    vector = axes.groupBy(owner, "anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "value"))), lambda x: x["value"]).alias("v"))
    sizes = member.groupBy(owner, "anchor").agg(F.count("*").alias("n"), F.avg("_s").alias("s")).filter("n > 1")
    rows = sizes.join(vector, [owner, "anchor"]).select(owner, "anchor", "n", "s", "v").repartition(owner).sortWithinPartitions(owner, "anchor")
    names = [owner, "gist", "support", "salience", "embedding", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kind = None, [], pa.null()

        def out() -> list[tuple]:
            return [(now, k + 1, n, s, v.tolist(), m) for k, (v, n, s, m) in enumerate(held)]

        done: list[tuple] = []
        for batch in batches:
            kind = batch.schema.types[0]
            for o, anchor, n, s, v in zip(*(c.to_pylist() for c in batch.columns)):
                if held and o != now:
                    done += out()
                    held = []
                now = o
                x = np.asarray(v) / max(np.linalg.norm(v), 1e-300)
                k = next((k for k, g in enumerate(held) if len(g[0]) == len(x) and g[0] @ x >= least), None)
                if k is None:
                    held.append((x, n, s, [anchor]))
                else:
                    old, m, first, members = held[k]
                    mixed = (old * m + x * n) / (m + n)
                    held[k] = (mixed / max(np.linalg.norm(mixed), 1e-300), m + n, first, [*members, anchor])
            if len(done) > 4096:
                yield _table(done, names, kind)
                done = []
        if held:
            yield _table(done + out(), names, kind)

    return rows.mapInArrow(run, f"{owner} {dict(df.dtypes)[owner]}, gist int, support long, salience double, embedding array<double>, members array<long>")


def _table(rows: list[tuple], names: list[str], owner: pa.DataType) -> pa.RecordBatch:
    types = (owner, pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def memory_problems(df: DataFrame, id_col: str, vec_col: str, salience: str, size: int) -> DataFrame:
    """Rows of a stored memory that a loader refuses, with the first reason."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v, s = F.col(vec_col), F.col(salience).cast("double")
    reason = (
        F.when(F.col(id_col).isNull(), "no id")
        .when(v.isNull() | (F.size(v) != size), "size")
        .when(F.exists(v, lambda x: bad(x.cast("double"))), "not finite")
        .when(~F.exists(v, lambda x: x != 0), "zero")
        .when(bad(s) | ~s.between(0, 1), "salience")
    )
    return df.select(id_col, reason.alias("reason")).filter("reason IS NOT NULL")


def observed(novelty_rows: DataFrame, surprise: DataFrame, key: str, least: float) -> DataFrame:
    """Observations worth keeping: salience from surprise and novelty reaches ``least``."""
    salience = 0.55 * F.col("surprise") + 0.45 * F.col("novelty")
    return novelty_rows.join(surprise, key).select(key, salience.alias("salience")).filter(F.col("salience") >= least)


def weighted_sample(df: DataFrame, id_col: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, each draw in proportion to its weight; the same seed gives the same rows.

    Every row gets an exponential arrival time with its weight as rate, from a hash of its id; the first ``n`` to arrive are
    drawn. One top-n, no state.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = df.filter(F.col(weight) > 0).withColumn("_arrival", -F.log(u) / F.col(weight))
    return keyed.orderBy("_arrival", id_col).limit(n).drop("_arrival")


def replay_priority(df: DataFrame, loss: str, power: float, n: int, order: str) -> DataFrame:
    """The ``n`` rows of highest priority: loss, capped at four times its mean, to a power."""
    mean = df.agg(F.avg(loss).alias("_mean"))  # one row
    rows = df.join(F.broadcast(mean)).withColumn("priority", F.pow(F.least(F.col(loss), 4 * F.col("_mean")), F.lit(power))).drop("_mean")
    return rows.orderBy(F.desc("priority"), order).limit(n)
