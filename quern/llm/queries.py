"""Queries pN_... over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import p1_surrogates, p2_groups, p3_defects, p4_overlap, p5_pack, p6_collapse, p7_encode, p8_leak, p9_split
from quern.plans.shared import read_table


def _with_pii(spark: SparkSession, d: str) -> tuple[list[tuple[DataFrame, str, str, str]], DataFrame]:
    texts, pairs = read_table(spark, d, "text_samples"), read_table(spark, d, "preference_samples")
    return [(texts, "text_samples", "sample_id", "text"), (pairs, "preference_samples", "pair_id", "chosen")], read_table(spark, d, "person_names")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_surrogates.found(*_with_pii(spark, d))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return p1_surrogates.anonymized(*_with_pii(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_groups.found(read_table(spark, d, "text_samples"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return p2_groups.splits(read_table(spark, d, "text_samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_defects.found(read_table(spark, d, "preference_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_overlap.found(read_table(spark, d, "text_samples"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return p4_overlap.report(read_table(spark, d, "text_samples"))


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return p5_pack.pack(read_table(spark, d, "token_rows"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return p5_pack.fill(p5_pack.pack(read_table(spark, d, "token_rows")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_collapse.found(read_table(spark, d, "text_samples"))


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    """Kept records and how many copies each had."""
    c = p6_collapse.classes(read_table(spark, d, "text_samples"), "sample_id", "text")
    return c.filter("id = keep_id").select("keep_id", "copies").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return p7_encode.encode_corpus(read_table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = read_table(spark, d, "documents"), read_table(spark, d, "eval_items")
    return p8_leak.leaks(docs, "doc_id", "text", items, "item_id", "lang", ["passage", "question"])


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the spans they share with evaluation items."""
    docs, items = read_table(spark, d, "documents"), read_table(spark, d, "eval_items")
    return p8_leak.without_spans(docs, "doc_id", "text", items, "item_id", "lang", ["passage", "question"])


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p9_split.split_oversized(read_table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_text, p2_found, p2_splits, p3_found, p4_found, p4_report, p5_rows, p5_fill, p6_found, p6_copies, p7_ids, p8_found, p8_clean, p9_pieces)}


#: Windows of ten words (Japanese items: of 25 letters and digits) that documents and items share.
P8_FOUND = r"""WITH t AS (SELECT 'd' AS side, doc_id AS id, '' AS lang, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS u FROM documents
UNION ALL SELECT 'i', item_id, lower(coalesce(lang, '')), regexp_extract_all(replace(lower(part), 'ß', 'ss'), '[\p{L}\p{N}]+') FROM (SELECT item_id, lang, passage AS part FROM eval_items UNION ALL SELECT item_id, lang, question FROM eval_items)),
w AS (SELECT side, id, array_to_string(u[k : k + 9], ' ') AS g FROM t, LATERAL (SELECT unnest(range(1, len(u) - 8)) AS k) WHERE lang NOT LIKE 'ja%'),
s AS (SELECT side, id, array_to_string(u, '') AS z FROM t WHERE side = 'd' OR lang LIKE 'ja%'),
l AS (SELECT side, id, substring(z, k, 25) AS g FROM s, LATERAL (SELECT unnest(range(1, length(z) - 23)) AS k))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM w d JOIN w i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g
UNION SELECT DISTINCT d.id, i.id FROM l d JOIN l i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g"""


def oracle_sql() -> dict[str, str]:
    return {"p8_found": P8_FOUND}
