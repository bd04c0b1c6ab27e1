"""Numeric, hashing and vector functions as Column builders; all native."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000_000


def luhn(digits: Column) -> Column:
    """Check digit of a string of digits: 13 to 19 of them, not all equal."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")

    def add(total: Column, i: Column) -> Column:
        d = value(i)
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    same = digits == F.repeat(F.substring(digits, 1, 1), n)
    return F.when(n.between(13, 19) & digits.rlike("^[0-9]+$") & ~same, F.aggregate(at, F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """SHA-256 of the key as a number, modulo ``buckets``, folded over 32-bit parts so that it fits a BIGINT."""
    h = F.sha2(key, 256)
    out = F.lit(0).cast("long")
    for k in range(8):
        part = F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long")
        out = (out * F.lit(1 << 32) + part) % F.lit(buckets)
    return out


def split_name(key: Column, train: float = 0.98, valid: float = 0.01, test: float = 0.01) -> Column:
    total = train + valid + test
    value = bucket(key) / F.lit(float(BUCKETS))
    return F.when(value < train / total, "train").when(value < (train + valid) / total, "valid").otherwise("test")


def sampled(source: Column, path: Column, key: Column, rate: float) -> Column:
    """Deterministic Bernoulli choice: the hash of source, path and key lies below the rate's share of all hashes."""
    if rate >= 1:
        return F.lit(True)
    limit = format(int(max(0.0, rate) * (1 << 256)), "064x")
    return F.sha2(F.concat(source, F.lit("\0"), path, F.lit("\0"), key), 256) < F.lit(limit)


def perplexity(loss: Column) -> Column:
    bad = loss.isNull() | F.isnan(loss) | (loss < 0) | (loss == float("inf"))
    return F.when(bad, F.raise_error(F.lit("loss must be finite and not negative")).cast("double")).otherwise(F.exp(F.least(loss, F.lit(math.log(1.7976931348623157e308) - 1))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Vector scaled to length one; null where the length is zero."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, -1 if their sizes differ."""
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def recency(age_hours: Column, half_life: float) -> Column:
    return F.exp(-F.lit(math.log(2)) * F.greatest(age_hours, F.lit(0.0)) / F.lit(half_life))


def support_bonus(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(count.cast("double")) / F.log(F.lit(8.0)))


def vocab_sizes(chars: Column, small: tuple[int, ...], middle: tuple[int, ...], large: tuple[int, ...]) -> Column:
    """Candidate vocabulary sizes by corpus size: under a million, under fifty million, more."""
    lists = [F.array(*[F.lit(x) for x in s]) for s in (small, middle, large)]
    return F.when(chars < 1_000_000, lists[0]).when(chars < 50_000_000, lists[1]).otherwise(lists[2])


def token_budget(most: Column, ratio: float) -> Column:
    return F.greatest(F.lit(0), F.floor(most * ratio).cast("int"))


def learning_rate(step: Column, total: int, warmup: int, base: float, least: float, kind: str = "cosine") -> Column:
    """Linear warm-up, then cosine or linear decay to ``least``."""
    done = F.least(F.lit(1.0), (step - warmup).cast("double") / float(max(1, total - warmup)))
    decay = 0.5 * (1 + F.cos(F.lit(math.pi) * done)) if kind == "cosine" else 1 - done
    return F.when(step < warmup, F.lit(base) * (step + 1) / float(max(1, warmup))).otherwise(least + (base - least) * decay)


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, hinge: bool = False) -> Column:
    z = F.lit(beta) * ((chosen - rejected) - (ref_chosen - ref_rejected))
    return F.greatest(F.lit(0.0), 1 - z) if hinge else F.log1p(F.exp(-z))


def seed_of(text: Column) -> Column:
    """A non-negative 63-bit seed from the first eight bytes of the hash."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    tail = F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("long")
    return (head % F.lit(1 << 31)) * F.lit(1 << 32) + tail


def improvement(baseline: Column, candidate: Column, direction: Column) -> Column:
    return F.when(direction == "minimize", baseline - candidate).otherwise(candidate - baseline)


def update_ratio(rate: Column, gradient: Column, weight: Column) -> Column:
    return rate * gradient / F.greatest(weight, F.lit(1e-12))


def capacity(size: Column, parameters: int) -> Column:
    """Struct of estimated tokens, bytes of a token cache and bytes of training state for a corpus of ``size`` bytes."""
    tokens = F.ceil(size / 3.5)
    return F.struct(tokens.alias("tokens"), F.ceil(tokens * 8 * 1.25).alias("cache_bytes"), F.lit(parameters * 16).cast("long").alias("training_bytes"))
