"""Filters and audits: length, personal data, credentials, denylists, reports by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.numeric import luhn
from quern.functions.text import content_hash
from quern.plans.shared import materialize, salt_of

# Patterns of sensitive content, in Java syntax.
PATTERNS = {
    "email": r"(?iU)(?<![\w.+-])[\w.+-]{1,64}@[\w.-]{1,253}\.[a-z]{2,24}(?![\w.-])",
    "kr_phone": r"(?U)(?<!\d)(?:\+?82[- .]?)?0?1[016789][- .]?\d{3,4}[- .]?\d{4}(?!\d)",
    "jp_phone": r"(?U)(?<!\d)(?:\+?81[- .]?)?0(?:70|80|90)[- .]?\d{4}[- .]?\d{4}(?!\d)",
    "kr_resident_id": r"(?U)(?<!\d)\d{6}[- ]?[1-4]\d{6}(?!\d)",
    "credential": r"(?iU)\b(?:api[_ -]?key|access[_ -]?token|client[_ -]?secret|password|passwd)\b\s*[:=]\s*['\"]?[A-Za-z0-9_./+~-]{8,}",
}
CARD = r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
CATEGORIES = (*PATTERNS, "payment_card", "special_token_injection")


def _may_have(text: Column, name: str) -> Column:
    """A cheap necessary condition, so that the long patterns run on few texts."""
    if name == "email":
        return F.contains(text, F.lit("@"))
    if name == "credential":
        return text.rlike("(?i)key|token|secret|passw")
    return text.rlike(r"\p{Nd}[- .]?\p{Nd}{3}")


def has_card(text: Column) -> Column:
    """A run of 13 to 19 digits with a valid check digit."""
    runs = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    return F.exists(runs, lambda r: luhn(F.regexp_replace(r, r"[ -]", "")))


def categories(text: Column, tokens: tuple[str, ...] = (), kind: Column | None = None) -> Column:
    """Sensitive categories of a text in fixed order; control tokens count in pretraining texts only."""
    marks = [F.when(_may_have(text, n) & text.rlike(p), F.lit(n)) for n, p in PATTERNS.items()]
    marks.append(F.when(text.rlike(r"(?:\p{Nd}[ -]?){13}") & has_card(text), F.lit("payment_card")))
    if tokens:
        any_token = F.lit(False)
        for t in tokens:
            any_token = any_token | F.contains(text, F.lit(t))
        if kind is not None:
            any_token = any_token & (kind == "pretrain")
        marks.append(F.when(any_token, F.lit("special_token_injection")))
    return F.array_compact(F.array(*marks))


def length_reason(text: Column, least: int = 10, most: int = 200_000) -> Column:
    """``invalid``, ``too_short``, ``too_long``, or null for texts that stay; both bounds are kept."""
    n = F.length(text)
    return F.when(text.isNull() | (text == ""), "invalid").when(n < least, "too_short").when(n > most, "too_long")


def removed_counts(df: DataFrame, text_col: str, least: int = 10, most: int = 200_000) -> DataFrame:
    reason = length_reason(F.col(text_col), least, most)
    return df.agg(*[F.count_if(reason == r).alias(r) for r in ("invalid", "too_short", "too_long")], F.count_if(reason.isNull()).alias("kept"))


def denied_ids(df: DataFrame, id_col: str, text_col: str, deny: DataFrame, components: Column | None = None) -> DataFrame:
    """Ids of rows whose text, or any of whose components, has a listed content hash. Only ids and hashes are moved."""
    parts = F.array(F.col(text_col)) if components is None else F.concat(F.array(F.col(text_col)), components)
    hashes = df.select(id_col, F.explode(parts).alias("_part")).select(id_col, content_hash(F.col("_part")).alias("hash"))
    return hashes.join(deny, "hash", "left_semi").select(id_col).distinct()


def required_hashes(items: DataFrame, id_col: str, question: Column, prompt: Column) -> DataFrame:
    """``hash, kind, items``: content hashes that a denylist has to hold, of each item's question and rendered prompt.

    ``items`` counts the items of one hash and kind: more than one is a repeated question or prompt, which a strict build
    refuses. Choices and answers are too short to be listed.
    """
    parts = F.array(F.struct(F.lit("question").alias("kind"), question.alias("text")), F.struct(F.lit("prompt").alias("kind"), prompt.alias("text")))
    rows = items.select(F.col(id_col).alias("_id"), F.explode(parts).alias("p")).filter("p.text IS NOT NULL")
    return rows.select("_id", "p.kind", content_hash(F.col("p.text")).alias("hash")).groupBy("hash", "kind").agg(F.countDistinct("_id").alias("items"))


def missing_from_denylist(required: DataFrame, deny: DataFrame) -> DataFrame:
    return required.select("hash").distinct().join(deny, "hash", "left_anti")


def first_of_group(df: DataFrame, group: list[str], order: list[str], n: int, row_id: str) -> DataFrame:
    """The first ``n`` rows of each group in order, exact, without ever sorting a whole group in one task.

    A first cut keeps ``n`` rows of each of SALTS parts of a group; at most SALTS * n rows of a group meet in the second.
    """
    parts = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    some = df.withColumn("_salt", salt_of(F.col(row_id))).withColumn("_k", F.row_number().over(parts)).filter(F.col("_k") <= n)
    return some.withColumn("_k", F.row_number().over(whole)).filter(F.col("_k") <= n).drop("_salt", "_k")


def audit(df: DataFrame, source_col: str, id_col: str, text_col: str, deny: DataFrame, hashes: int = 25) -> DataFrame:
    """By source: rows scanned and accepted, rows by category (a row may count in several), first hashes of rejected rows."""
    listed = deny.select("hash").distinct().withColumn("_listed", F.lit(True))
    # One pass over the texts; all that follows reads its narrow result.
    seen = materialize(df.select(source_col, id_col, categories(F.col(text_col)).alias("found"), content_hash(F.col(text_col)).alias("hash")), "audit")
    marked = seen.join(listed, "hash", "left")
    found = F.concat(F.coalesce("found", F.array().cast("array<string>")), F.when(F.col("_listed"), F.array(F.lit("benchmark"))).otherwise(F.array().cast("array<string>")))
    rows = marked.withColumn("found", found).withColumn("rejected", F.size("found") > 0)
    names = (*PATTERNS, "payment_card", "benchmark")
    counts = rows.groupBy(source_col).agg(
        F.count("*").alias("scanned"), F.count_if(~F.col("rejected")).alias("accepted"), *[F.count_if(F.array_contains("found", n)).alias(n) for n in names]
    )
    shown = first_of_group(rows.filter("rejected").select(source_col, id_col, "hash"), [source_col], [id_col], hashes, id_col)
    lists = shown.groupBy(source_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(id_col, "hash"))), lambda s: s["hash"]).alias("rejection_hashes"))
    return counts.join(lists, source_col, "left").withColumn("rejection_hashes", F.coalesce("rejection_hashes", F.array().cast("array<string>")))
