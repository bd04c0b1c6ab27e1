"""Evaluation aggregates: weighted losses, votes, windows of logs, running bests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.plans.shared import before_blocks, in_blocks, materialize


def weighted_loss(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """Sum of loss times tokens over tokens; rows with a loss that is no number are left out and counted."""
    bad = F.isnan(loss) | F.col(loss).isNull()
    good = df.withColumn("_w", F.when(~bad, F.col(tokens)))
    return good.agg((F.sum(F.when(~bad, F.col(loss) * F.col(tokens))) / F.sum("_w")).alias("loss"), F.sum("_w").cast("long").alias("tokens"), F.count_if(bad).alias("skipped"))


def majority(df: DataFrame, prompt: str, answer: Column, order: str) -> DataFrame:
    """Answer that more than half of a prompt's candidates give, and the first candidate that gives it."""
    votes = df.select(prompt, answer.alias("answer"), order).groupBy(prompt, "answer").agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    total = votes.groupBy(prompt).agg(F.sum("votes").alias("candidates"))
    return votes.join(total, prompt).filter("2 * votes > candidates AND answer <> ''").select(prompt, "answer", "votes", "candidates", "first")


def log_windows(df: DataFrame, step: str, every: int, **sums: str) -> DataFrame:
    """Sums by window of ``every`` steps; the last window may be short."""
    return df.groupBy(F.floor(F.col(step) / every).alias("window_no")).agg(F.count("*").alias("steps"), *[F.sum(c).alias(n) for n, c in sums.items()])


def running_best(df: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """Best value before each step, whether the step improves on it, and steps since the last improvement, by run.

    Steps are taken in blocks, so a run of any length is spread over tasks; what came before a block is joined to it.
    """
    rows = in_blocks(df.select(run, step, metric), step, "running-best")
    inside = Window.partitionBy(run, "_block").orderBy(step)
    earlier = before_blocks(rows, [run], low=(F.min(metric), F.min), count=(F.count("*"), F.sum))
    best = F.least(F.min(metric).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("low"))
    rows = rows.join(earlier, [run, "_block"]).withColumn("best", best)
    rows = rows.withColumn("better", F.col("best").isNull() | (F.col(metric) < F.col("best")))
    rows = materialize(rows.withColumn("no", F.row_number().over(inside) + F.coalesce("count", F.lit(0))), "running-best")
    last = F.max(F.when(F.col("better"), F.col("no")))
    earlier = before_blocks(rows, [run], improved=(last, F.max))
    upto = F.greatest(last.over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("improved"))
    return rows.join(earlier, [run, "_block"]).select(run, step, metric, "best", "better", (F.col("no") - upto).alias("stale"))


def last_value(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Later rows replace earlier ones."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Every value with the one before it under the same key; hot keys are spread over blocks of the order."""
    rows = in_blocks(df.select(key, order, value), order, "changes")
    inside = Window.partitionBy(key, "_block").orderBy(order)
    last = before_blocks(rows, [key], last=(F.max(F.struct(order, value)), F.max))
    before = F.when(F.row_number().over(inside) == 1, F.col(f"last.{value}")).otherwise(F.lag(value).over(inside))
    return rows.join(last, [key, "_block"]).select(key, order, before.alias("value_before"), value)


def due_patches(patches: DataFrame, settings: DataFrame, steps: DataFrame) -> DataFrame:
    """``step, at_step, key, before, after``: the patches that become due at each step that is looked at.

    ``patches``: ``at_step, no, key, value``, applied in the order of step and number; ``settings``: ``key, value`` at the
    start; ``steps``: the steps at which due patches are applied. A patch is applied at the first step not before its own;
    patches after the last step never are.
    """
    w = Window.partitionBy("key").orderBy("at_step", "no")
    known = patches.withColumn("lagged", F.lag("value").over(w)).join(settings.select("key", F.col("value").alias("start")), "key", "left")
    before = known.select("at_step", "no", "key", F.coalesce("lagged", "start").alias("before"), F.col("value").alias("after"))
    # The first step looked at from at_step on: steps carried backwards over the merged order.
    merged = before.select("at_step", "no", "key", "before", "after", F.lit(None).cast("long").alias("seen")).unionByName(
        steps.select(F.col("step").alias("at_step"), F.lit(1 << 40).cast("long").alias("no"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"), F.col("step").alias("seen"))
    )
    ahead = Window.orderBy("at_step", "no").rowsBetween(0, Window.unboundedFollowing)  # a schedule: one row per patch and step looked at
    return merged.withColumn("step", F.first("seen", ignorenulls=True).over(ahead)).filter("key IS NOT NULL AND step IS NOT NULL").select("step", "at_step", "key", "before", "after")


def probabilities(df: DataFrame, step: str, logit: str, name: str = "p") -> DataFrame:
    """Softmax of each step's logits. A step's rows are one vocabulary, which bounds the window."""
    whole = Window.partitionBy(step)
    shifted = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(whole)))
    return shifted.withColumn(name, F.col("_e") / F.sum("_e").over(whole)).drop("_e")


def nucleus(df: DataFrame, step: str, token: str, logit: str, top_p: float, top_k: int = 0) -> DataFrame:
    """Tokens kept by top-k and nucleus filtering, with their probability among those the first filter keeps.

    Tokens with a logit below that of rank ``top_k`` go first (ties with it stay; 0 keeps all); of the rest a token stays if
    the cumulative probability before it does not exceed ``top_p``.
    """
    if top_k:
        rank = F.rank().over(Window.partitionBy(step).orderBy(F.desc(logit)))
        df = df.withColumn("_rank", rank).filter(F.col("_rank") <= top_k).drop("_rank")
    ordered = Window.partitionBy(step).orderBy(F.desc("p"), token).rowsBetween(Window.unboundedPreceding, -1)
    rows = probabilities(df, step, logit).withColumn("_before", F.coalesce(F.sum("p").over(ordered), F.lit(0.0)))
    return rows.filter(F.col("_before") <= top_p).select(step, token, "p")


def trace(df: DataFrame, step: str, token: str, logit: str, k: int = 5) -> DataFrame:
    """``step, entropy, tokens, probabilities``: entropy of each step's distribution and its ``k`` likeliest tokens, ties by token."""
    p = F.col("p")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-p).alias("minus"), F.col(token).alias("token")))), 1, k)
    rows = probabilities(df, step, logit).groupBy(step).agg((-F.sum(p * F.log(F.greatest(p, F.lit(1e-12))))).alias("entropy"), best.alias("b"))
    return rows.select(step, "entropy", F.transform("b", lambda x: x["token"]).alias("tokens"), F.transform("b", lambda x: -x["minus"]).alias("probabilities"))


def surprise(entropies: DataFrame, key: str, entropy: str, vocabulary: int) -> DataFrame:
    """Mean entropy of an output as a share of the largest possible, from 0 to 1."""
    scale = max(1e-12, math.log(max(2, vocabulary)))
    return entropies.groupBy(key).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.avg(entropy), F.lit(0.0)) / scale)).alias("surprise"))


def sequence_logprob(labels: Column, logps: Column) -> Column:
    """Sum of the log-probabilities of the labels that count; ``logps`` holds those of the second token on, as labels are shifted."""
    shifted = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(shifted, logps, lambda y, p: F.when(y != -100, p).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def arm_results(results: DataFrame, arms: list[str], seeds: list[int], metrics: list[str]) -> DataFrame:
    """``arm, metric, mean, complete`` over a grid of arms, seeds and metrics that is complete only if every cell stands once, finite."""
    spark = results.sparkSession
    grid = spark.createDataFrame([(a, s, m) for a in arms for s in seeds for m in metrics], "arm string, seed long, metric string")  # stated by the study
    value = F.col("value").cast("double")
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    cells = results.groupBy("arm", "seed", "metric").agg(F.count("*").alias("n"), F.avg(F.when(fine, value)).alias("value"), F.min(fine).alias("fine"))
    rows = grid.join(cells, ["arm", "seed", "metric"], "left")
    return rows.groupBy("arm", "metric").agg(F.avg("value").alias("mean"), F.min(F.coalesce((F.col("n") == 1) & F.col("fine"), F.lit(False))).alias("complete"))


def activation_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation, root mean square, largest size and share of zeros over finite values; share of finite values."""
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    f = F.when(finite, x)
    return df.groupBy(key).agg(
        F.avg(f).alias("mean"), F.stddev_pop(f).alias("deviation"), F.sqrt(F.avg(f * f)).alias("rms"), F.max(F.abs(f)).alias("abs_max"), F.avg(F.when(finite, (x == 0).cast("double"))).alias("zero_share"), F.avg(finite.cast("double")).alias("finite_share")
    )


def ema(df: DataFrame, key: str, order: str, value: str, rate: float) -> DataFrame:
    """Exponential moving average in order, by key, beginning with the key's first value.

    Updating is an affine map, so a block of ``n`` values is one, too: it scales by ``(1 - rate) ** n`` and adds the weighted
    sum of its values. Blocks are summed up apart; a key has one row per block to fold.
    """
    rows = in_blocks(df.select(key, order, value), order, "ema")
    w = Window.partitionBy(key, "_block").orderBy(order)
    after = F.count("*").over(Window.partitionBy(key, "_block")) - F.row_number().over(w)
    added = rows.withColumn("_a", F.lit(rate) * F.pow(F.lit(1.0 - rate), after) * F.col(value))
    parts = added.groupBy(key, "_block").agg(F.pow(F.lit(1.0 - rate), F.count("*")).alias("scale"), F.sum("_a").alias("add"), F.min(F.struct(order, value)).alias("first"))
    folded = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "scale", "add"))).alias("s"), F.min("first").alias("f"))
    return folded.select(key, F.aggregate("s", F.col(f"f.{value}").cast("double"), lambda a, r: a * r["scale"] + r["add"]).alias("ema"))


def modulated(df: DataFrame, run: str, step: str, loss: str, norm: str, decay: float = 0.98, gain: float = 0.2, tire: float = 0.01, rest: float = 0.005, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """``run, step, surprise, arousal, fatigue, plasticity`` after every step of a run's log.

    The state is clipped at every step, so no block can be summed up without it: steps of a run stream in order through one
    task with six numbers of state. A run's log is bounded by its steps; runs are spread over tasks.
    """
    names = [run, step, "surprise", "arousal", "fatigue", "plasticity"]

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mean, spread, s, a, f, p = object(), None, 1.0, 0.0, 0.0, 0.0, 1.0
        for batch in batches:
            out = []
            for r, t, x, g in zip(*(c.to_pylist() for c in batch.columns)):
                x = x if x is not None and math.isfinite(x) else 0.0
                g = max(0.0, g) if g is not None and math.isfinite(g) else 0.0
                if r != now:
                    now, mean, s, a, f, p = r, None, 0.0, 0.0, 0.0, 1.0
                if mean is None:
                    mean, spread = x, max(1e-6, x * x * 0.01)
                else:
                    d = x - mean
                    mean, spread = decay * mean + (1 - decay) * x, decay * spread + (1 - decay) * d * d
                    s = min(1.0, abs(d) / math.sqrt(max(spread, 1e-8)) / 4)
                    a = decay * a + (1 - decay) * s
                    f = min(1.0, max(0.0, f + tire * 0.5 * (g / (1 + g) + s) - rest * (1 - a)))
                    p = min(high, max(low, 1 + gain * a - gain * f / 2))
                out.append((s, a, f, p))
            states = [pa.array(c, pa.float64()) for c in (zip(*out) if out else [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *states], names)

    kinds = dict(df.dtypes)
    rows = df.select(run, step, F.col(loss).cast("double"), F.col(norm).cast("double")).repartition(run).sortWithinPartitions(run, step)
    return rows.mapInArrow(run_batches, f"{run} {kinds[run]}, {step} {kinds[step]}, surprise double, arousal double, fatigue double, plasticity double")


def pilot_metrics(df: DataFrame, label: Column, answer: Column) -> DataFrame:
    """Items, correct ones, accuracy, and share of outputs that are a label at all."""
    return df.agg(F.count("*").alias("items"), F.count_if(label == answer).alias("correct"), F.avg(F.coalesce((label == answer).cast("double"), F.lit(0.0))).alias("accuracy"), F.avg(label.isNotNull().cast("double")).alias("parse_rate"))


def containment_accuracy(df: DataFrame, output: str, answer: str) -> DataFrame:
    """Share of outputs that contain the answer."""
    return df.agg(F.count("*").alias("probes"), F.avg(F.coalesce(F.contains(F.col(output), F.col(answer)).cast("double"), F.lit(0.0))).alias("accuracy"))


def item_problems(df: DataFrame, id_col: str, choices: str, answer: str, labels: tuple[str, ...], texts: tuple[str, ...] = ()) -> DataFrame:
    """Items that a strict loader refuses, with the first reason. ``texts`` must not be blank."""
    counts = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1")
    wanted = F.array_sort(F.array(*[F.lit(x) for x in labels]))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    reason = F.when(F.col(id_col).isNull(), "no id").when(F.col("_n").isNotNull(), "repeated id")
    for t in texts:
        reason = reason.when(blank(F.col(t)), t)
    reason = (
        reason.when(F.col(choices).isNull() | (F.array_sort(F.map_keys(choices)) != wanted), "labels")
        .when(F.exists(F.map_values(choices), blank), "choices")
        .when(F.col(answer).isNull() | ~F.col(answer).isin(*labels), "answer")
    )
    return df.join(counts, id_col, "left").select(id_col, reason.alias("reason")).filter("reason IS NOT NULL")


def scored(df: DataFrame, columns: list[str], load: Callable[[], Callable[[pa.RecordBatch], tuple[pa.Array, pa.Array]]]) -> DataFrame:
    """``loss, tokens`` of every row by a pluggable model: ``load`` makes, in a worker, what scores a batch of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*score(batch)], ["loss", "tokens"])

    return df.select(*columns).mapInArrow(run, "loss double, tokens long")
