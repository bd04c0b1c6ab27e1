"""Queries of the corpus operators over the project's tables, with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numeric as N
from quern.functions import text as X
from quern.operators import audit, chat, evaluate, sampling, stats, tokens, vectors
from quern.plans.shared import materialize, read_table
from quern.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks ----------------------------------------------------------------------------------------------
WHITE = X.WHITE
_COLLAPSED = "trim(regexp_replace(§, '" + WHITE + "', ' ', 'g'))"
#: Full casefolds that differ from lower case in the given tables, as SQL has no casefold.
_FOLDS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ς": "σ", "ſ": "s"}
_CONTENT_HASH = "sha256(" + "replace(" * len(_FOLDS) + "lower(" + _COLLAPSED + ")" + "".join(f", '{a}', '{b}')" for a, b in _FOLDS.items()) + ")"


def sql_content_hash(c: str) -> str:
    return _CONTENT_HASH.replace("§", c)


def sql_bucket(key: str) -> str:
    out = "0::BIGINT"
    for k in range(8):
        out = f"(({out}) * 4294967296 + ('0x' || substr(sha256({key}), {1 + 8 * k}, 8))::BIGINT) % 10000000"
    return f"({out})"


def sql_split(key: str, train: float = 0.98, valid: float = 0.01) -> str:
    v = f"{sql_bucket(key)}::DOUBLE / 10000000.0"
    return f"CASE WHEN {v} < {train} THEN 'train' WHEN {v} < {train + valid} THEN 'valid' ELSE 'test' END"


def sql_count(c: str, script: str) -> str:
    if script == "other":
        seen = f"length(regexp_replace({c}, '{WHITE}', '', 'g'))"
        return f"({seen} - " + " - ".join(sql_count(c, s) for s in X.SCRIPTS) + ")"
    return f"len(regexp_extract_all({c}, '{X.SCRIPTS[script]}'))"


_D, _W = r"\p{Nd}", r"\p{L}\p{M}\p{N}\p{Pc}"
_NOT_DIGIT = rf"(^|[^{_D}])"
SQL_PATTERNS = {
    "email": rf"(?i)(^|[^{_W}.+-])[{_W}.+-]{{1,64}}@[{_W}.-]{{1,253}}\.[a-z]{{2,24}}([^{_W}.-]|$)",
    "kr_phone": rf"{_NOT_DIGIT}(\+?82[- .]?)?0?1[016789][- .]?{_D}{{3,4}}[- .]?{_D}{{4}}([^{_D}]|$)",
    "jp_phone": rf"{_NOT_DIGIT}(\+?81[- .]?)?0(70|80|90)[- .]?{_D}{{4}}[- .]?{_D}{{4}}([^{_D}]|$)",
    "kr_resident_id": rf"{_NOT_DIGIT}{_D}{{6}}[- ]?[1-4]{_D}{{6}}([^{_D}]|$)",
    "credential": r"(?i)(^|[^\p{L}\p{N}_])(api[_ -]?key|access[_ -]?token|client[_ -]?secret|password|passwd)\s*[:=]\s*[''\"]?[A-Za-z0-9_./+~-]{8,}",
}


def sql_has(c: str, name: str) -> str:
    return f"coalesce(regexp_matches({c}, '{SQL_PATTERNS[name]}'), false)"


_LUHN = "list_sum(list_transform(range(1, length(z) + 1), lambda i: CASE WHEN (length(z) - i) % 2 = 1 THEN CASE WHEN substr(z, i, 1)::INT * 2 > 9 THEN substr(z, i, 1)::INT * 2 - 9 ELSE substr(z, i, 1)::INT * 2 END ELSE substr(z, i, 1)::INT END)) % 10 = 0"
_CARD = f"""coalesce(len(list_filter(list_transform(regexp_extract_all(§, '(^|[^{_D}])(({_D}[ -]?){{12,18}}{_D})', 2), lambda r: regexp_replace(r, '[ -]', '', 'g')), lambda z: length(z) BETWEEN 13 AND 19 AND z <> repeat(substr(z, 1, 1), length(z)) AND {_LUHN})) > 0, false)"""
_TURNS = """
SELECT sample_id, turn, substr(p, 1, strpos(p, chr(2)) - 1) AS role, trim(regexp_replace(substr(p, strpos(p, chr(2)) + 1), '\\n+$', '')) AS content
FROM (SELECT sample_id, unnest(list_transform(l, lambda x, i: {'p': x, 'turn': i - 1}), recursive := true)
      FROM (SELECT sample_id, list_filter(string_split(regexp_replace(text, '(?m)^<(system|user|assistant)>\\n', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda x: x <> '') AS l
            FROM text_samples WHERE kind = 'sft' AND text LIKE '<%'))
"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def sft_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "text_samples").filter("kind = 'sft' AND text LIKE '<%'")
    return rows.select("sample_id", F.posexplode(chat.turns_of(F.col("text"))).alias("turn", "t")).select("sample_id", F.col("turn").cast("long"), "t.role", "t.content")


# --- flagship: audit by source -----------------------------------------------------------------------------------------
def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes of the documents that hold whole evaluation passages as lines, and of a stated set of documents."""
    lines = read_table(spark, d, "eval_items").select(X.content_hash(F.col("passage")).alias("hash"))
    stated = docs(spark, d).filter("doc_id % 50 = 0 AND text IS NOT NULL").select(X.content_hash(F.col("text")).alias("hash"))
    return lines.union(stated).distinct()


_LISTED = f"SELECT {sql_content_hash('passage')} AS hash FROM eval_items UNION SELECT {sql_content_hash('text')} FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL"
_MARKS = ", ".join(f"{sql_has('text', n)} AS {n}" for n in SQL_PATTERNS)
_ANY = " OR ".join([*SQL_PATTERNS, "payment_card", "benchmark"])


@query(f"""
WITH deny AS ({_LISTED}),
m AS (SELECT source, doc_id, {sql_content_hash('text')} AS hash, {_MARKS}, {_CARD.replace('§', 'text')} AS payment_card FROM documents),
r AS (SELECT m.*, coalesce(m.hash IN (SELECT hash FROM deny), false) AS benchmark FROM m),
x AS (SELECT *, ({_ANY}) AS rejected FROM r),
k AS (SELECT source, doc_id, hash, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM x WHERE rejected)
SELECT x.source, count(*) AS scanned, count(*) FILTER (NOT rejected) AS accepted,
  {", ".join(f"count(*) FILTER ({n}) AS {n}" for n in [*SQL_PATTERNS, "payment_card", "benchmark"])},
  coalesce((SELECT string_agg(hash, ',' ORDER BY doc_id) FROM k WHERE k.source = x.source AND n <= 25), '') AS first_hashes
FROM x GROUP BY x.source""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    out = audit.audit(docs(spark, d), "source", "doc_id", "text", _listed(spark, d))
    return out.withColumn("first_hashes", F.array_join("rejection_hashes", ",")).drop("rejection_hashes")


# --- scans and filters --------------------------------------------------------------------------------------------------
@query("SELECT doc_id, source, n_chars FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "source", "n_chars")


@query("SELECT 'documents' AS src, source AS source_name, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'text_samples', source_name, count(*) FROM text_samples GROUP BY source_name")
def scan_union(spark: SparkSession, d: str) -> DataFrame:
    a = docs(spark, d).select(F.lit("documents").alias("src"), F.col("source").alias("source_name"))
    b = read_table(spark, d, "text_samples").select(F.lit("text_samples").alias("src"), "source_name")
    return a.unionByName(b).groupBy("src", "source_name").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE text <> '' AND length(text) BETWEEN 100 AND 3000")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(audit.length_reason(F.col("text"), 100, 3000).isNull()).select("doc_id")


@query("""SELECT count(*) FILTER (text IS NULL OR text = '') AS invalid, count(*) FILTER (text <> '' AND length(text) < 100) AS too_short,
count(*) FILTER (length(text) > 3000) AS too_long, count(*) FILTER (text <> '' AND length(text) BETWEEN 100 AND 3000) AS kept FROM documents""")
def removed_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.removed_counts(docs(spark, d), "text", 100, 3000)


@query(f"SELECT sample_id, {', '.join(f'{sql_has("text", n)} AS {n}' for n in SQL_PATTERNS)}, {_CARD.replace('§', 'text')} AS payment_card FROM text_samples WHERE text IS NOT NULL")
def sensitive_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "text_samples").filter("text IS NOT NULL").select("sample_id", audit.categories(F.col("text")).alias("c"))
    return rows.select("sample_id", *[F.array_contains("c", n).alias(n) for n in (*audit.PATTERNS, "payment_card")])


@query(f"SELECT source_name, {', '.join(f'count(*) FILTER ({sql_has("chosen", n)}) AS {n}' for n in ('email', 'kr_phone', 'jp_phone', 'kr_resident_id'))} FROM preference_samples GROUP BY source_name")
def sensitive_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples").select("source_name", audit.categories(F.col("chosen")).alias("c"))
    return rows.groupBy("source_name").agg(*[F.count_if(F.array_contains("c", n)).alias(n) for n in ("email", "kr_phone", "jp_phone", "kr_resident_id")])


@query("SELECT sample_id FROM text_samples WHERE kind = 'pretrain' AND (" + " OR ".join(f"contains(text, '{t}')" for t in X.PRESERVED_TAGS) + ")")
def token_injection(spark: SparkSession, d: str) -> DataFrame:
    c = audit.categories(F.col("text"), X.PRESERVED_TAGS, F.col("kind"))
    return read_table(spark, d, "text_samples").filter(F.array_contains(c, "special_token_injection")).select("sample_id")


@query("SELECT source_name FROM sources WHERE stages IS NULL OR list_contains(stages, 'sft') OR list_contains(stages, 'all')")
def stage_sources(spark: SparkSession, d: str) -> DataFrame:
    stages = F.col("stages")
    return read_table(spark, d, "sources").filter(stages.isNull() | F.array_contains(stages, "sft") | F.array_contains(stages, "all")).select("source_name")


# --- hashing, sampling, splits ------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {sql_content_hash('text')} AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, sha256(text) AS hash, {sql_bucket('text')} AS bucket FROM documents WHERE text IS NOT NULL")
def stable_hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", X.stable_hash(F.col("text")).alias("hash"), N.bucket(F.col("text")).alias("bucket"))


@query(f"SELECT doc_id, {sql_split('text')} AS split FROM documents WHERE text IS NOT NULL")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", N.split_name(F.col("text")).alias("split"))


@query(f"SELECT source, {sql_split('text', 0.8, 0.1)} AS split, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").groupBy("source", N.split_name(F.col("text"), 0.8, 0.1, 0.1).alias("split")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER () < 0.8 THEN 'train'
WHEN (row_number() OVER (ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER () < 0.9 THEN 'valid' ELSE 'test' END AS split FROM documents""")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.positional_split(docs(spark, d).select("doc_id"), "doc_id", 0.8, 0.1, 0.1).select("doc_id", "split")


_RATE = format(int(0.4 * (1 << 256)), "064x")


@query(f"SELECT sample_id FROM text_samples WHERE text IS NOT NULL AND sha256(source_name || chr(0) || source_path || chr(0) || text) < '{_RATE}'")
def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "text_samples").filter("text IS NOT NULL")
    return rows.filter(N.sampled(F.col("source_name"), F.col("source_path"), F.col("text"), 0.4)).select("sample_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 100) WHERE k <= 20")
def source_cap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.capped(docs(spark, d).filter("length(text) >= 100").select("source", "doc_id"), "source", ["doc_id"], 20)


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 100) WHERE k <= 20 AND {sql_split('text', 0.8, 0.1)} = 'train'")
def source_cap_then_split(spark: SparkSession, d: str) -> DataFrame:
    kept = sampling.capped(docs(spark, d).filter("length(text) >= 100").select("source", "text", "doc_id"), "source", ["doc_id"], 20)
    return kept.filter(N.split_name(F.col("text"), 0.8, 0.1, 0.1) == "train").select("source", "doc_id")


@query(f"""WITH p AS (SELECT pair_id, prompt AS a, chosen AS b FROM preference_samples WHERE prompt <> '' AND chosen <> ''),
s AS (SELECT pair_id, a, b, {sql_split("'translation-endpoint:prompt:' || a", 0.8, 0.1)} AS x, {sql_split("'translation-endpoint:chosen:' || b", 0.8, 0.1)} AS y FROM p)
SELECT pair_id, sha256('translation:' || least(a, b) || chr(0) || greatest(a, b)) AS key_hash, CASE WHEN x = y THEN x ELSE 'discard' END AS split FROM s""")
def translation_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples").filter("prompt <> '' AND chosen <> ''")
    key, split = sampling.translation_split(F.col("prompt"), F.col("chosen"), "prompt", "chosen", train=0.8, valid=0.1, test=0.1)
    return rows.select("pair_id", F.sha2(key, 256).alias("key_hash"), split.alias("split"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sampling.deduplicated(docs(spark, d).filter("text IS NOT NULL").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query('SELECT sha1(text) AS digest, min(doc_id) AS "first", count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1')
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return sampling.duplicate_groups(docs(spark, d), "text", "doc_id")


@query('SELECT doc_id, "first", copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS "first", count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL) WHERE copies > 1')
def dup_members(spark: SparkSession, d: str) -> DataFrame:
    return sampling.with_first(docs(spark, d), "text", "doc_id")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM text_samples WHERE text IS NOT NULL AND split_name IS NOT NULL GROUP BY text HAVING count(DISTINCT split_name = 'train') = 2")
def purpose_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "text_samples").filter("text IS NOT NULL AND split_name IS NOT NULL").select(F.sha2("text", 256).alias("digest"), (F.col("split_name") == "train").alias("train"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("train").alias("a"), F.min("train").alias("b")).filter("a AND NOT b").select("digest", "n")


# --- denylists ----------------------------------------------------------------------------------------------------------
def required_hashes(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "eval_items")
    return audit.required_hashes(items, "item_id", F.col("question"), X.choice_prompt(F.col("question"), F.col("choices"))).select("hash").distinct()


_LABELS = "list_sort(map_keys(choices))"
_PROMPT = f"question || chr(10) || array_to_string(list_transform({_LABELS}, lambda k: k || '. ' || choices[k]), chr(10)) || chr(10) || 'Answer with one of ' || array_to_string({_LABELS}, ', ') || '.'"
_REQUIRED = f"SELECT {sql_content_hash('question')} AS hash FROM eval_items UNION SELECT {sql_content_hash(f'({_PROMPT})')} FROM eval_items"


@query(f"SELECT item_id, {_PROMPT} AS prompt FROM eval_items")
def choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "eval_items").select("item_id", X.choice_prompt(F.col("question"), F.col("choices")).alias("prompt"))


@query(f"SELECT hash FROM ({_REQUIRED})")
def denylist_build(spark: SparkSession, d: str) -> DataFrame:
    return required_hashes(spark, d)


@query(f"SELECT {sql_content_hash('question')} AS hash, count(*) AS items FROM eval_items WHERE question IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that a strict build of a denylist refuses, as another item asks the same."""
    found = audit.required_hashes(read_table(spark, d, "eval_items"), "item_id", F.col("question"), F.lit(None).cast("string"))
    return found.filter("items > 1").select("hash", "items")


@query(f"SELECT hash FROM ({_REQUIRED}) UNION SELECT hash FROM ({_LISTED})")
def denylist_merge(spark: SparkSession, d: str) -> DataFrame:
    return required_hashes(spark, d).union(_listed(spark, d)).distinct()


@query(f"SELECT count(*) AS missing FROM ({_REQUIRED}) WHERE hash NOT IN (SELECT hash FROM ({_LISTED}))")
def denylist_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_from_denylist(required_hashes(spark, d), _listed(spark, d)).agg(F.count("*").alias("missing"))


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {sql_content_hash('text')} NOT IN (SELECT hash FROM ({_LISTED}))")
def denylist_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", "text")
    return rows.select("doc_id").join(audit.denied_ids(rows, "doc_id", "text", _listed(spark, d)), "doc_id", "left_anti")


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL) WHERE {sql_content_hash('line')} IN (SELECT hash FROM ({_LISTED}))")
def denylist_components(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", "text")
    return audit.denied_ids(rows, "doc_id", "text", _listed(spark, d), F.split("text", "\n"))


# --- statistics ---------------------------------------------------------------------------------------------------------
@query("""SELECT count(*) AS samples, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars, max(length(text))::BIGINT AS max_chars,
median(length(text))::DOUBLE AS median_chars, sum(strlen(text))::BIGINT AS utf8_bytes, false AS median_is_approximate FROM documents WHERE text IS NOT NULL""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_stats(docs(spark, d), "text").withColumn("mean_chars", F.round("mean_chars", 6))


@query(f"SELECT doc_kind, {', '.join(f'sum({sql_count("text", s)})::BIGINT AS {s}' for s in (*X.SCRIPTS, 'other'))} FROM documents WHERE text IS NOT NULL GROUP BY doc_kind")
def script_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.script_totals(docs(spark, d), "text", ["doc_kind"])


@query(f"WITH t AS (SELECT {', '.join(f'sum({sql_count("text", s)})::DOUBLE AS {s}' for s in (*X.SCRIPTS, 'other'))} FROM documents WHERE text IS NOT NULL) SELECT {', '.join(f'round({s} / (hangul + kana + han + latin + other), 4) AS {s}' for s in (*X.SCRIPTS, 'other'))} FROM t")
def script_ratio(spark: SparkSession, d: str) -> DataFrame:
    return stats.script_ratios(docs(spark, d), "text")


@query("""WITH s AS (SELECT lower(lang) AS language, length(text) AS c, strlen(text) AS b FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
n AS (SELECT count(*) AS k FROM documents WHERE text IS NOT NULL)
SELECT language, count(*) AS samples, sum(c)::BIGINT AS chars, sum(b)::BIGINT AS utf8_bytes, round(count(*) / (SELECT k FROM n), 8) AS sample_ratio, round(sum(b) / sum(c), 8) AS bytes_per_char FROM s GROUP BY language""")
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).withColumn("tags", X.language_tags(F.when(F.col("lang").isNotNull(), F.array("lang"))))
    out = stats.language_stats(rows, "text", "tags")
    return out.withColumn("sample_ratio", F.round("sample_ratio", 8)).withColumn("bytes_per_char", F.round("bytes_per_char", 8))


@query("SELECT source_name, array_to_string(list_distinct_in_order, ',') AS tags FROM (SELECT source_name, list_filter(list_transform(coalesce(languages, []), lambda x: lower(trim(x))), lambda x: x <> '') AS list_distinct_in_order FROM sources)")
def source_languages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sources").select("source_name", F.array_join(X.language_tags(F.col("languages")), ",").alias("tags"))


@query("SELECT s.source_name, count(t.sample_id) AS samples FROM sources s LEFT JOIN text_samples t USING (source_name) GROUP BY s.source_name")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.source_coverage(read_table(spark, d, "text_samples"), "source_name", read_table(spark, d, "sources"))


@query("SELECT CASE WHEN n < 1000000 THEN '8000,16000,24000' WHEN n < 50000000 THEN '16000,32000,48000' ELSE '32000,48000,64000' END AS sizes FROM (SELECT sum(length(text)) AS n FROM documents)")
def vocab_recommendation(spark: SparkSession, d: str) -> DataFrame:
    total = docs(spark, d).agg(F.sum(F.length("text")).alias("n"))
    return total.select(F.array_join(N.vocab_sizes(F.col("n"), (8000, 16000, 24000), (16000, 32000, 48000), (32000, 48000, 64000)).cast("array<string>"), ",").alias("sizes"))


# --- chat ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT sample_id, turn::BIGINT AS turn, role, content FROM ({_TURNS})")
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    return sft_turns(spark, d)


def _rendered(rows: DataFrame) -> DataFrame:
    message = F.struct("role", "content", F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("reasoning_mode"))
    talk = rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda s: s["m"]).alias("messages"))
    parts = talk.select("sample_id", X.render_segments(F.col("messages")).alias("segments"))
    return parts.select(
        "sample_id", F.sha2(X.render_messages(F.col("segments")), 256).alias("text_hash"), F.aggregate(X.assistant_runs(F.col("segments")), F.lit(0).cast("long"), lambda a, r: a + F.when(r["assistant"], r["n"]).otherwise(0)).alias("assistant_chars")
    )


_PAIRS = f"""SELECT sample_id, turn, prompt, content AS chosen FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prompt FROM ({_TURNS})) WHERE role = 'assistant' AND prompt <> '' AND content <> ''"""


_SAID = "replace(" * len(X.PRESERVED_TAGS) + "content" + "".join(f", '{t}', '{t.replace('<', '‹').replace('>', '›')}')" for t in sorted(X.PRESERVED_TAGS, key=len, reverse=True))


@query(f"""SELECT sample_id, sha256(string_agg('<' || role || '>' || chr(10) || said || chr(10), '' ORDER BY turn)) AS text_hash,
sum(CASE WHEN role = 'assistant' THEN length('<' || role || '>' || chr(10) || said || chr(10)) ELSE 0 END)::BIGINT AS assistant_chars FROM (SELECT *, {_SAID} AS said FROM ({_TURNS})) GROUP BY sample_id""")
def render_conversation(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(sft_turns(spark, d))


@query(f"SELECT sample_id, turn::BIGINT AS turn, prompt, chosen FROM ({_PAIRS})")
def chat_pairs(spark: SparkSession, d: str) -> DataFrame:
    return chat.chat_pairs(sft_turns(spark, d), "sample_id", "turn")


@query(f"SELECT prompt, chosen, f.sample_id AS sample_id, f.turn::BIGINT AS turn FROM (SELECT prompt, chosen, min({{'sample_id': sample_id, 'turn': turn}}) AS f FROM ({_PAIRS}) GROUP BY ALL) ORDER BY sample_id, turn LIMIT 50")
def pairs_distinct_first_n(spark: SparkSession, d: str) -> DataFrame:
    return chat.distinct_pairs(chat_pairs(spark, d), ["sample_id", "turn"], 50)


@query(f"SELECT DISTINCT prompt, chosen FROM ({_PAIRS}) p WHERE NOT EXISTS (SELECT 1 FROM ({_PAIRS}) q WHERE q.sample_id % 3 = 0 AND q.prompt = p.prompt AND q.chosen = p.chosen)")
def pairs_resume_anti(spark: SparkSession, d: str) -> DataFrame:
    pairs = chat_pairs(spark, d)
    return chat.not_done(pairs.select("prompt", "chosen").distinct(), pairs.filter("sample_id % 3 = 0"))


@query("SELECT pair_id, prompt AS question, chosen AS answer FROM preference_samples WHERE prompt <> '' AND chosen <> ''")
def instruction_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples").select("pair_id", F.to_variant_object(F.struct(F.col("prompt").alias("question"), F.col("chosen").alias("answer"))).alias("row"))
    m = rows.select("pair_id", chat.instruction_messages(F.col("row")).alias("m")).filter("m IS NOT NULL")
    return m.select("pair_id", F.col("m")[0]["content"].alias("question"), F.col("m")[1]["content"].alias("answer"))


@query("SELECT pair_id, CASE pair_id % 4 WHEN 0 THEN CASE WHEN prompt <> '' AND chosen <> '' THEN 'instruction' END WHEN 1 THEN 'text' WHEN 2 THEN 'messages' END AS kind FROM preference_samples")
def sample_dispatch(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples")
    k = F.col("pair_id") % 4
    as_json = (
        F.when(k == 0, F.to_json(F.struct(F.col("prompt").alias("instruction"), F.col("chosen").alias("output"))))
        .when(k == 1, F.to_json(F.struct(F.coalesce("chosen", F.lit("")).alias("text"))))
        .when(k == 2, F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("prompt", F.lit("")).alias("content"))).alias("messages"))))
        .otherwise(F.lit("17"))
    )
    return rows.select("pair_id", chat.sample_kind(F.parse_json(as_json)).alias("kind"))


# --- tokens -------------------------------------------------------------------------------------------------------------
def token_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "token_rows")


@query("""WITH c AS (SELECT seq_id, k, input_ids[k * 512 + 1 : k * 512 + 512] AS i, labels[k * 512 + 1 : k * 512 + 512] AS l FROM token_rows, range(0, 1000) r(k) WHERE k * 512 < len(input_ids))
SELECT seq_id, k::BIGINT AS chunk_no, len(i)::BIGINT AS n, list_sum(i)::BIGINT AS total FROM c WHERE len(i) > 1 AND len(list_filter(l[2:], lambda x: x <> -100)) > 0""")
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens.chunk_rows(token_rows(spark, d), "seq_id", 512)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("seq_id", F.col("chunk_no").cast("long"), F.size("input_ids").cast("long").alias("n"), total.alias("total"))


@query("""WITH RECURSIVE r AS (SELECT source_name, seq_id, len(input_ids) AS n, row_number() OVER (PARTITION BY source_name ORDER BY seq_id) AS k FROM token_rows WHERE len(input_ids) BETWEEN 1 AND 2048),
f AS (SELECT source_name, seq_id, n, k, 0::BIGINT AS bin, n AS used FROM r WHERE k = 1
UNION ALL SELECT r.source_name, r.seq_id, r.n, r.k, CASE WHEN f.used + r.n > 2048 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + r.n > 2048 THEN r.n ELSE f.used + r.n END FROM f JOIN r ON r.source_name = f.source_name AND r.k = f.k + 1),
c AS (SELECT source_name, seq_id, len(input_ids) AS n, unnest(range(0, len(input_ids), 2048)) AS start FROM token_rows WHERE len(input_ids) > 2048)
SELECT source_name, seq_id, 0::BIGINT AS start, n::BIGINT AS n, bin FROM f
UNION ALL SELECT source_name, seq_id, start, least(2048, n - start)::BIGINT, -row_number() OVER (PARTITION BY source_name ORDER BY seq_id, start) FROM c""")
def pack_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Rows above the capacity come out in chunks, which leave the open bin open."""
    names = read_table(spark, d, "sources").select("source_name", F.xxhash64("source_name").alias("shard"))
    rows = token_rows(spark, d).filter("size(input_ids) > 0").select(F.xxhash64("source_name").alias("shard"), "seq_id", F.size("input_ids").alias("n"))
    return tokens.greedy_packs(rows, "shard", "seq_id", "n", 2048).join(names, "shard").select("source_name", "seq_id", "start", "n", "bin")


@query("""SELECT seq_id, list_sum(list_transform(seq_lens, lambda n: (n::BIGINT * (n - 1)) // 2))::BIGINT AS positions, list_sum(list_transform(seq_lens, lambda n, i: n::BIGINT * (i - 1)))::BIGINT AS documents FROM token_rows WHERE len(seq_lens) > 0""")
def packed_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = token_rows(spark, d).filter("size(seq_lens) > 0")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("seq_id", add(tokens.position_ids(F.col("seq_lens"))).alias("positions"), add(tokens.document_ids(F.col("seq_lens"))).alias("documents"))


@query("""WITH b AS (SELECT seq_id, seq_id // 8 AS batch_no, len(input_ids) AS n, list_sum(input_ids) AS s, list_sum(labels) AS l, max(len(input_ids)) OVER (PARTITION BY seq_id // 8) AS w FROM token_rows WHERE len(input_ids) > 0)
SELECT seq_id, batch_no::BIGINT AS batch_no, w::BIGINT AS width, (s + 3 * (w - n))::BIGINT AS ids, (l - 100 * (w - n))::BIGINT AS labels, n::BIGINT AS mask FROM b""")
def collate_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = tokens.collated(token_rows(spark, d).filter("size(input_ids) > 0"), "seq_id", 8, 3)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("seq_id", F.col("batch_no").cast("long"), F.size("input_ids").cast("long").alias("width"), add("input_ids").alias("ids"), add("labels").alias("labels"), add("attention_mask").alias("mask"))


@query("""WITH a AS (SELECT seq_id, input_ids[1:40] AS p, list_concat(input_ids[41:], [2]) AS t FROM token_rows WHERE len(input_ids) > 0),
k AS (SELECT seq_id, p, CASE WHEN len(t) > 256 THEN t[len(t) - 255 :] ELSE t END AS t FROM a),
h AS (SELECT seq_id, CASE WHEN 256 - len(t) <= 0 THEN [] WHEN len(p) > 256 - len(t) THEN p[len(p) - (256 - len(t)) + 1 :] ELSE p END AS p, t FROM k)
SELECT seq_id, (len(p) + len(t))::BIGINT AS n, (coalesce(list_sum(p), 0) + list_sum(t))::BIGINT AS ids, (list_sum(t) - 100 * len(p))::BIGINT AS labels FROM h""")
def dpo_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = token_rows(spark, d).filter("size(input_ids) > 0")
    ids, labels = tokens.preference_sequence(F.slice("input_ids", 1, 40), F.slice(F.col("input_ids"), F.lit(41), F.size("input_ids")), 2, 256)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("seq_id", F.size(ids).cast("long").alias("n"), add(ids).alias("ids"), add(labels).alias("labels"))


@query("SELECT seq_id, list_sum(CASE WHEN len(input_ids) <= 64 THEN input_ids ELSE list_concat(input_ids[1:1], input_ids[len(input_ids) - 62 :]) END)::BIGINT AS ids FROM token_rows WHERE len(input_ids) > 0")
def recent_prompt(spark: SparkSession, d: str) -> DataFrame:
    kept = tokens.recent_prompt(F.col("input_ids"), 64)
    return token_rows(spark, d).filter("size(input_ids) > 0").select("seq_id", F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query("SELECT source_name, count(*) AS sequences, sum(len(input_ids))::BIGINT AS tokens, sum(coalesce(len(seq_lens), 1))::BIGINT AS documents FROM token_rows WHERE input_ids IS NOT NULL GROUP BY source_name")
def token_store_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = token_rows(spark, d).filter("input_ids IS NOT NULL")
    return rows.groupBy("source_name").agg(F.count("*").alias("sequences"), F.sum(F.size("input_ids")).alias("tokens"), F.sum(F.coalesce(F.size("seq_lens"), F.lit(1))).alias("documents")).withColumn("tokens", F.col("tokens").cast("long"))


# --- vectors ------------------------------------------------------------------------------------------------------------
def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str, str]:
    """All vectors, and the stated set of queries among them."""
    e = read_table(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding"


_SCORED = "SELECT q.vec_id AS query_id, m.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings m WHERE q.vec_id % 50 = 0"


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS k FROM ({_SCORED})) WHERE k <= 5")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(*_asked(spark, d), 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT query_id, round(1 - greatest(0, max(similarity)), 6) AS novelty FROM ({_SCORED}) WHERE query_id <> id GROUP BY query_id")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    return vectors.novelty(*_asked(spark, d)).withColumn("novelty", F.round("novelty", 6))


@query("""WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS z FROM embeddings),
x AS (SELECT label, unnest(range(0, len(v))) AS axis, unnest(list_transform(v, lambda c: c / z)) AS c FROM u)
SELECT label, axis::INT AS axis, round(avg(c), 8) AS value FROM x GROUP BY ALL""")
def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(read_table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 8))


@query("SELECT event_id, round(0.55 * least(1, value / 100) + 0.3 * exp(-ln(2) * (event_id % 97) / 24) + 0.15 * least(1, ln(1 + user_id) / ln(8)), 8) AS score FROM events ORDER BY score DESC, event_id LIMIT 100")
def retention_topn(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    score = 0.55 * F.least(F.lit(1.0), F.col("value") / 100) + 0.3 * N.recency((F.col("event_id") % 97).cast("double"), 24.0) + 0.15 * N.support_bonus(F.col("user_id"))
    return vectors.retained(e.select("event_id", F.round(score, 8).alias("score")), "score", "event_id", 100)


@query(f"""WITH n AS (SELECT query_id, 1 - greatest(0, max(similarity)) AS novelty FROM ({_SCORED}) WHERE query_id <> id GROUP BY query_id)
SELECT query_id, round(0.55 * least(1, value / 100) + 0.45 * novelty, 6) AS salience FROM n JOIN events ON event_id = query_id WHERE 0.55 * least(1, value / 100) + 0.45 * novelty >= 0.2""")
def observe_salience(spark: SparkSession, d: str) -> DataFrame:
    surprise = read_table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.least(F.lit(1.0), F.col("value") / 100).alias("surprise"))
    return vectors.observed(vectors.novelty(*_asked(spark, d)), surprise, "query_id", 0.2).withColumn("salience", F.round("salience", 6))


@query("SELECT event_id, round(pow(least(value, 4 * (SELECT avg(value) FROM events)), 0.6), 8) AS priority FROM events ORDER BY pow(least(value, 4 * (SELECT avg(value) FROM events)), 0.6) DESC, event_id LIMIT 64")
def replay_top(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.replay_priority(read_table(spark, d, "events").select("event_id", "value"), "value", 0.6, 64, "event_id")
    return rows.select("event_id", F.round("priority", 8).alias("priority"))


@query()
def replay_sample(spark: SparkSession, d: str) -> DataFrame:
    return vectors.weighted_sample(read_table(spark, d, "events").select("event_id", "value"), "event_id", "value", 64, 7)


def sql_mmr(scored: str, k: int) -> str:
    """Greedy diverse choice from ``query_id, id, score``."""
    return f"""WITH RECURSIVE s AS MATERIALIZED ({scored}),
v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT DISTINCT query_id, 0 AS rank, NULL::BIGINT AS id, []::DOUBLE[][] AS near, []::BIGINT[] AS ids FROM s
UNION ALL SELECT query_id, rank + 1, b.id, list_append(near, b.e), list_append(ids, b.id) FROM (
  SELECT f.query_id, f.rank, f.near, f.ids, min({{'v': -round(s.score - 0.2 * greatest(0, coalesce(list_max(list_transform(f.near, lambda x: list_cosine_similarity(x, v.e))), 0)), 12), 'id': s.id, 'e': v.e}}) AS b
  FROM f JOIN s ON s.query_id = f.query_id JOIN v ON v.id = s.id WHERE f.rank < {k} AND NOT list_contains(f.ids, s.id) GROUP BY ALL))
SELECT query_id, rank, id FROM f WHERE rank > 0"""


@query(sql_mmr(f"SELECT query_id, id, round(similarity, 12) AS score FROM ({_SCORED})", 8))
def mmr_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Diverse retrieval by similarity alone."""
    return vectors.diverse(*_asked(spark, d), 8, 40)


_AGED = "0.2 * ((m.vec_id % 10) / 10.0) + 0.1 * exp(-ln(2) * (m.vec_id % 97) / 24) + 0.05 * least(1, ln(1 + m.vec_id % 5) / ln(8))"


@query(sql_mmr(f"SELECT query_id, id, round(0.65 * greatest(0, round(similarity, 12)) + bonus, 12) AS score FROM (SELECT q.vec_id AS query_id, m.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS similarity, {_AGED} AS bonus FROM embeddings q, embeddings m WHERE q.vec_id % 50 = 0) WHERE similarity >= 0.1", 6))
def memory_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Diverse retrieval by weighted score above a threshold; salience, age and support come from the id."""
    e, q, *names = _asked(spark, d)
    k = F.col("vec_id")
    e = e.select("vec_id", "embedding", ((k % 10) / 10).alias("s"), (k % 97).cast("double").alias("age"), (k % 5).alias("n")).withColumn("bonus", vectors.memory_bonus("s", "age", "n", 24.0))
    return vectors.diverse(e, q, *names, 6, 60, weight=0.65, bonus="bonus", least=0.1)


_CLUSTERS = """r AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
f AS (SELECT label, k, vec_id AS id, vec_id AS anchor, [{'id': vec_id, 'e': e}] AS held FROM r WHERE k = 1
UNION ALL SELECT r.label, r.k, r.vec_id, coalesce(m.id, r.vec_id), CASE WHEN m.id IS NULL THEN list_append(f.held, {'id': r.vec_id, 'e': r.e}) ELSE f.held END
FROM f JOIN r ON r.label = f.label AND r.k = f.k + 1, LATERAL (SELECT list_filter(f.held, lambda h: list_cosine_similarity(h.e, r.e) >= 0.25)[1].id AS id) m)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT label, anchor, id FROM f")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of similar vectors within each label."""
    return vectors.clusters(read_table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.25)


# --- evaluation ---------------------------------------------------------------------------------------------------------
def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


@query("SELECT round(sum(value * user_id) / sum(user_id), 8) AS loss, sum(user_id)::BIGINT AS tokens, 0::BIGINT AS skipped FROM events")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.weighted_loss(events(spark, d), "value", "user_id").withColumn("loss", F.round("loss", 8))


@query("SELECT event_type, round(exp(least(avg(value) / 100, 700)), 8) AS perplexity FROM events GROUP BY event_type")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.avg("value").alias("v")).select("event_type", F.round(N.perplexity(F.col("v") / 100), 8).alias("perplexity"))


@query("SELECT round(avg(ln(1 + exp(-0.1 * (value - user_id)))), 8) AS loss, round(avg(greatest(0, 1 - 0.1 * (value - user_id))), 8) AS hinge, round(avg(CASE WHEN value > user_id THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM events")
def dpo_loss(spark: SparkSession, d: str) -> DataFrame:
    c, r, z = F.col("value"), F.col("user_id").cast("double"), F.lit(0.0)
    return events(spark, d).agg(F.round(F.avg(N.preference_loss(c, r, z, z)), 8).alias("loss"), F.round(F.avg(N.preference_loss(c, r, z, z, hinge=True)), 8).alias("hinge"), F.round(F.avg((c > r).cast("double")), 8).alias("accuracy"))


_VOTE = "SELECT event_id // 3 AS prompt, lower(event_type) AS answer, count(*) AS votes, min(event_id) AS \"first\", sum(count(*)) OVER (PARTITION BY event_id // 3) AS candidates FROM events GROUP BY event_id // 3, lower(event_type)"


@query(f'SELECT prompt::BIGINT AS prompt, answer, votes, candidates::BIGINT AS candidates, "first" FROM ({_VOTE}) WHERE 2 * votes > candidates AND answer <> \'\'')
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.floor(F.col("event_id") / 3).alias("prompt"), "event_type", "event_id")
    return evaluate.majority(rows, "prompt", F.lower("event_type"), "event_id")


@query("SELECT (event_id // 500)::BIGINT AS window_no, count(*) AS steps, round(sum(value), 4) AS loss FROM events GROUP BY ALL")
def log_window_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.log_windows(events(spark, d), "event_id", 500, loss="value").withColumn("loss", F.round("loss", 4))


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_value(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.last_value(events(spark, d), "user_id", "event_id", "value")


@query("SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value_before, value FROM events")
def value_changes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.changes(events(spark, d), "user_id", "event_id", "value")


@query("""WITH b AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events),
i AS (SELECT *, best IS NULL OR value < best AS better FROM b)
SELECT user_id, event_id, value, best, better, no - max(CASE WHEN better THEN no END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stale FROM i""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.running_best(events(spark, d), "user_id", "event_id", "value").withColumn("stale", F.col("stale").cast("long"))


@query("SELECT step, round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * least(1, (step - 100) / 900.0))) END, 12) AS rate FROM range(0, 1000) r(step)")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), F.round(N.learning_rate(F.col("id"), 1000, 100, 0.001, 0.0001), 12).alias("rate"))


@query("""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, k, value AS ema FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, f.ema * 0.9 + r.value * 0.1 FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM f GROUP BY user_id""")
def ema_fold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ema(events(spark, d), "user_id", "event_id", "value", 0.1).withColumn("ema", F.round("ema", 6))


@query("""WITH e AS (SELECT user_id, event_id, exp(value / 10 - max(value / 10) OVER (PARTITION BY user_id)) AS x FROM events),
p AS (SELECT user_id, event_id, x / sum(x) OVER (PARTITION BY user_id) AS p FROM e)
SELECT user_id, count(*) AS kept FROM (SELECT user_id, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) WHERE b <= 0.9 GROUP BY user_id""")
def nucleus_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", (F.col("value") / 10).alias("logit"))
    return evaluate.nucleus(rows, "user_id", "event_id", "logit", 0.9).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("""SELECT label, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS deviation, round(sqrt(avg(x * x)), 8) AS rms, round(max(abs(x)), 8) AS abs_max, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS zero_share, 1.0::DOUBLE AS finite_share
FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label""")
def activation_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x"))
    out = evaluate.activation_stats(rows, "label", "x")
    return out.select("label", *[F.round(c, 8).alias(c) for c in ("mean", "deviation", "rms", "abs_max")], "zero_share", "finite_share")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice NULLS LAST, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return audit.first_of_group(rows, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 3, "o_orderkey")


@query("SELECT doc_id, ((('0x' || substr(sha256(text), 1, 8))::BIGINT % 2147483648) * 4294967296 + ('0x' || substr(sha256(text), 9, 8))::BIGINT) AS seed FROM documents WHERE text IS NOT NULL")
def candidate_seeds(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", N.seed_of(F.col("text")).alias("seed"))


@query("SELECT coalesce(a.source_name, b.source_name) AS source_name, a.source_name IS NULL AS missing, b.source_name IS NULL AS unused FROM (SELECT DISTINCT source AS source_name FROM documents) a FULL JOIN (SELECT source_name FROM sources WHERE list_contains(stages, 'sft')) b USING (source_name) WHERE a.source_name IS NULL OR b.source_name IS NULL")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the corpus against those that the policy names for a stage."""
    a = docs(spark, d).select(F.col("source").alias("a")).distinct()
    b = read_table(spark, d, "sources").filter(F.array_contains("stages", "sft")).select(F.col("source_name").alias("b"))
    both = a.join(b, F.col("a") == F.col("b"), "full").filter("a IS NULL OR b IS NULL")
    return both.select(F.coalesce("a", "b").alias("source_name"), F.col("a").isNull().alias("missing"), F.col("b").isNull().alias("unused"))


@query()
def clean_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "text_samples").filter("text IS NOT NULL")
    return rows.select("sample_id", F.sha2(X.clean_text(F.col("text")), 256).alias("hash"))


@query()
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query("SELECT sample_id, sha256(" + "replace(" * len(X.PRESERVED_TAGS) + "text" + "".join(f", '{t}', '{t.replace('<', '‹').replace('>', '›')}')" for t in sorted(X.PRESERVED_TAGS, key=len, reverse=True)) + ") AS hash FROM text_samples WHERE text IS NOT NULL")
def escape_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "text_samples").filter("text IS NOT NULL").select("sample_id", F.sha2(X.escape_special_tokens(F.col("text")), 256).alias("hash"))


@query("SELECT pair_id, prompt, chosen, rejected FROM preference_samples WHERE prompt <> '' AND chosen <> '' AND rejected <> ''")
def preference_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples").select("pair_id", F.to_variant_object(F.struct("prompt", "chosen", "rejected")).alias("row"))
    return rows.select("pair_id", chat.preference_of(F.col("row")).alias("p")).filter("p IS NOT NULL").select("pair_id", "p.*")


@query("SELECT pair_id, prompt, chosen, rejected FROM preference_samples WHERE prompt <> '' AND chosen <> '' AND rejected <> ''")
def preference_scan(spark: SparkSession, d: str) -> DataFrame:
    """Preference rows read for evaluation, where none is refused."""
    rows = read_table(spark, d, "preference_samples").select("pair_id", F.to_variant_object(F.struct("prompt", "chosen", "rejected")).alias("row"))
    return chat.preferences(rows, "pair_id", "row", "evaluation")


_PREF = ("prompt", "chosen", "rejected")


@query("SELECT pair_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(sql_has(c, n) for c in _PREF)} THEN '{n}' END" for n in SQL_PATTERNS) + ", CASE WHEN " + " OR ".join(_CARD.replace("§", c) for c in _PREF) + " THEN 'payment_card' END], lambda x: x IS NOT NULL)), ',') AS found FROM preference_samples")
def preference_rejections(spark: SparkSession, d: str) -> DataFrame:
    found = F.concat(*[F.coalesce(audit.categories(F.col(c)), F.array().cast("array<string>")) for c in _PREF])
    return read_table(spark, d, "preference_samples").select("pair_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("found"))


@query("SELECT pair_id, 'Translate this ' || source_name || ' text into English.' || chr(10) || prompt AS request FROM preference_samples WHERE prompt IS NOT NULL")
def translation_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples").filter("prompt IS NOT NULL")
    return rows.select("pair_id", X.translation_prompt(F.col("prompt"), F.col("source_name"), F.lit("English")).alias("request"))


@query("SELECT pair_id, '<user>' || chr(10) || prompt || chr(10) || '<assistant>' || chr(10) AS request FROM preference_samples WHERE prompt IS NOT NULL")
def inference_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "preference_samples").filter("prompt IS NOT NULL")
    return rows.select("pair_id", X.inference_prompt(F.lit(None).cast("string"), F.col("prompt")).alias("request"))


@query("SELECT item_id FROM eval_items WHERE list_sort(map_keys(choices)) <> ['A', 'B', 'C', 'D'] OR answer NOT IN ('A', 'B', 'C', 'D')")
def choice_item_problems(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.item_problems(read_table(spark, d, "eval_items"), "item_id", "choices", "answer", ("A", "B", "C", "D")).select("item_id")


@query("""WITH o AS (SELECT answer, CASE WHEN item_id % 3 = 0 THEN ' ' || answer || ' ' WHEN item_id % 3 = 1 THEN 'A' ELSE 'none' END AS output FROM eval_items),
l AS (SELECT answer, CASE WHEN trim(output) IN ('A', 'B', 'C', 'D') THEN trim(output) END AS label FROM o)
SELECT count(*) AS items, count(*) FILTER (label = answer) AS correct, round(avg(CASE WHEN label = answer THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(CASE WHEN label IS NOT NULL THEN 1.0 ELSE 0.0 END), 8) AS parse_rate FROM l""")
def pilot_metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 3
    output = F.when(k == 0, F.concat(F.lit(" "), F.col("answer"), F.lit(" "))).when(k == 1, "A").otherwise("none")
    rows = read_table(spark, d, "eval_items").select("answer", X.choice_label(output, ("A", "B", "C", "D")).alias("label"))
    return evaluate.pilot_metrics(rows, F.col("label"), F.col("answer")).withColumn("accuracy", F.round("accuracy", 8)).withColumn("parse_rate", F.round("parse_rate", 8))


@query("SELECT count(*) AS probes, round(avg(CASE WHEN contains(chosen, prompt) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM preference_samples")
def memory_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.containment_accuracy(read_table(spark, d, "preference_samples"), "chosen", "prompt").withColumn("accuracy", F.round("accuracy", 8))


def _labels(samples: DataFrame) -> DataFrame:
    rows = samples.filter("kind = 'sft' AND text <> '' AND size(labels_mask) = length(text)")
    ids = rows.select("sample_id", tokens.code_point_tokens(F.col("text")).alias("ids"), "labels_mask")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.select("sample_id", F.size("ids").cast("long").alias("n"), add("ids").alias("ids"), add(tokens.assistant_labels(F.col("ids"), F.col("labels_mask"))).alias("labels"))


_POINTS = "list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: 20 + unicode(c) % 200)"


@query(f"""WITH t AS (SELECT sample_id, {_POINTS} AS p, labels_mask AS m FROM text_samples WHERE kind = 'sft' AND text <> '' AND len(labels_mask) = length(text))
SELECT sample_id, (len(p) + 2)::BIGINT AS n, (list_sum(p) + 3)::BIGINT AS ids, (list_sum(list_transform(p, lambda x, i: CASE WHEN m[i] = 1 THEN x ELSE -100 END)) - 100 + CASE WHEN m[-1] = 1 THEN 2 ELSE -100 END)::BIGINT AS labels FROM t""")
def assistant_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(read_table(spark, d, "text_samples"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS mean,
coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, true) AS begins FROM events""")
def segment_means(spark: SparkSession, d: str) -> DataFrame:
    out = tokens.segment_means(events(spark, d), "user_id", "event_type", "event_id", "value")
    return out.select("user_id", "event_id", F.round("mean", 6).alias("mean"), "begins")


# --- streaming ----------------------------------------------------------------------------------------------------------
def _landed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files: its folder, or the one file of that name."""
    kind = read_table(spark, d, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    reader = spark.readStream.schema(kind)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def run_to_table(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """Run a stream over what has landed and return its result table; in update mode the last row of each key stays."""
    spark = stream.sparkSession
    held: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        held.append(materialize(batch.withColumn("_batch", F.lit(number)), "stream"))

    stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    if not held:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return held[-1].drop("_batch")
    rows = reduce(DataFrame.unionByName, held)
    if mode == "append" or key is None:
        return rows.drop("_batch")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("r"))
    return last.select("r.*")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    stream = flows.window_counts(_landed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return run_to_table(stream, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"SELECT source, count(*) AS scanned, {', '.join(f'count(*) FILTER ({sql_has("text", n)}) AS {n}' for n in SQL_PATTERNS)}, count(*) FILTER ({_CARD.replace('§', 'text')}) AS payment_card FROM documents GROUP BY source")
def stream_audit(spark: SparkSession, d: str) -> DataFrame:
    return run_to_table(flows.audit_stream(_landed(spark, d, "documents"), "source", "text"), "complete")


@query("SELECT count(DISTINCT text) AS texts FROM documents WHERE text IS NOT NULL")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each text once, by the time it was collected; a missing time counts as the earliest, and nothing is late in one batch."""
    at = F.coalesce(F.col("collected_at").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"))
    rows = _landed(spark, d, "documents").filter("text IS NOT NULL").withColumn("seen_at", at)
    return run_to_table(flows.first_seen(rows, "text", "seen_at", "36500 days").select("digest"), "append").agg(F.count("digest").alias("texts"))


@query(SQL["ema_fold"])
def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    """The moving average as a stream with state, rows of a batch in order of their id."""
    stream = flows.ema_stream(_landed(spark, d, "events"), "user_id", "value", 0.1, "event_id")
    return run_to_table(stream, "update", "user_id").withColumn("ema", F.round("ema", 6))


# Further queries register themselves.
from quern.plans import catalog_files, catalog_more  # noqa: E402, F401
