"""Conversations: pairs, resuming, preference and instruction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.audit import categories


def turns_of(text: Column) -> Column:
    """Turns of a rendered chat text: a role line opens a turn, what follows is its content."""
    marked = F.regexp_replace(text, r"(?m)^<(system|user|assistant)>\n", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("role"), F.trim(F.regexp_replace(F.substring_index(p, "\x02", -1), r"\n+$", "")).alias("content")))


def chat_pairs(turns: DataFrame, conv: str, turn: str) -> DataFrame:
    """Each assistant turn with the latest user turn before it; an empty user turn resets it."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prompt = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)
    rows = turns.withColumn("prompt", prompt).filter("role = 'assistant' AND prompt <> '' AND content <> ''")
    return rows.select(conv, turn, "prompt", F.col("content").alias("chosen"))


def distinct_pairs(pairs: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """Distinct (prompt, chosen) pairs in order of first appearance; the first ``n`` if given."""
    first = pairs.groupBy("prompt", "chosen").agg(F.min(F.struct(*order)).alias("first"))
    out = first.select("prompt", "chosen", *[F.col(f"first.{o}").alias(o) for o in order])
    return out.orderBy(*order).limit(n) if n is not None else out


def not_done(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs without a result yet, for resuming."""
    return pairs.join(done.select("prompt", "chosen").distinct(), ["prompt", "chosen"], "left_anti")


def field(row: Column, names: tuple[str, ...]) -> Column:
    """Value under the first of the names that exists in a variant row, even if it is null there."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.variant_get(row, f"$.{n}", "variant").isNotNull(), F.try_variant_get(row, f"$.{n}", "string")).otherwise(out)
    return out


def instruction_messages(row: Column) -> Column:
    """User and assistant message of an instruction row, or null if instruction or output is missing."""
    ask, context, answer = (field(row, n) for n in (("instruction", "question", "prompt"), ("input", "context"), ("output", "answer", "chosen", "response")))
    content = F.when(F.coalesce(context, F.lit("")) != "", F.concat(ask, F.lit("\n\n"), context)).otherwise(ask)
    pair = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.when((F.coalesce(ask, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != ""), pair)


def sample_kind(row: Column) -> Column:
    """How a raw row becomes a sample: string, instruction, messages, text, preference, or null (dropped)."""
    has = lambda *names: F.coalesce(*[F.when(F.variant_get(row, f"$.{n}", "variant").isNotNull(), F.lit(True)) for n in names], F.lit(False))
    return (
        F.when(F.schema_of_variant(row) == "STRING", "string")
        .when(instruction_messages(row).isNotNull() & ~has("messages", "conversations"), "instruction")
        .when(has("messages", "conversations"), "messages")
        .when(has("text"), "text")
        .when(has("prompt") & has("chosen"), "preference")
    )


def preference_of(row: Column) -> Column:
    """Prompt, chosen and rejected of a variant row, or null if one is missing."""
    p, c, r = (field(row, (n,)) for n in ("prompt", "chosen", "rejected"))
    return F.when((F.coalesce(p, F.lit("")) != "") & (F.coalesce(c, F.lit("")) != "") & (F.coalesce(r, F.lit("")) != ""), F.struct(p.alias("prompt"), c.alias("chosen"), r.alias("rejected")))


def preferences(df: DataFrame, id_col: str, row: str, purpose: str, tokens: tuple[str, ...] = ()) -> DataFrame:
    """``id, prompt, chosen, rejected`` of variant rows. For ``training`` a row with sensitive content fails the scan, with its id
    and categories; for ``evaluation`` none is left out. Rows that lack a part are no preference rows and are dropped."""
    if purpose not in ("training", "evaluation"):
        raise ValueError(f"unknown purpose {purpose!r}")
    rows = df.select(id_col, preference_of(F.col(row)).alias("p")).filter("p IS NOT NULL").select(id_col, "p.*")
    if purpose == "evaluation":
        return rows
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(categories(F.col(c), tokens), F.array().cast("array<string>")) for c in ("prompt", "chosen", "rejected")])))
    told = F.raise_error(F.concat(F.lit("preference row "), F.col(id_col).cast("string"), F.lit(" holds "), F.array_join(found, ", ")))
    return rows.withColumn("prompt", F.when(F.size(found) > 0, told.cast("string")).otherwise(F.col("prompt")))
