"""Queries over crafted rows and arithmetic that the given tables do not exercise, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numeric as N
from quern.functions import text as X
from quern.operators import audit, chat, evaluate, governance, sampling, tokens, vectors
from quern.plans.catalog import _CLUSTERS, query
from quern.plans.shared import read_table


def literal(x: object) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return f"{x!r}::{'DOUBLE' if isinstance(x, float) else 'BIGINT'}" if x == x and abs(x) != float("inf") else f"'{x}'::DOUBLE"
    return "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '").replace("\0", "") + "'"


def values(names: str, rows: list[tuple]) -> str:
    """Stated rows as SQL."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


# --- text: stated cases -------------------------------------------------------------------------------------------------
#: Raw text and what cleaning has to make of it.
CLEANED = [
    (1, "  two   words \n\t here ", "two words here"),
    (2, "ＡＢＣ１２３", "ABC123"),
    (3, "Tom &amp; Ann &lt;3 &quot;x&quot;", 'Tom & Ann <3 "x"'),
    (4, "<p>one</p><br/>two", "one two"),
    (5, "<user>stays<assistant> and <b>goes</b>", "<user>stays<assistant> and goes"),
    (6, "bell\x07 and del\x7f gone�", "bell and del gone"),
    (7, "ﬁne ½ ㎏", "fine 1⁄2 kg"),
    (8, "", ""),
    (9, None, ""),
    (10, "a b　c d", "a b c d"),
    (11, "&lt;user&gt; &lt;i&gt;x&lt;/i&gt;", "<user> x"),
    (12, "1 < 2 and 3 > 2", "1 2"),
    (13, "ｶﾞ 한", "ガ 한"),
]


@query(values("id, text", [(i, out) for i, _, out in CLEANED]))
def clean_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, raw) for i, raw, _ in CLEANED], "id long, raw string")
    return rows.select("id", X.clean_text(F.col("raw")).alias("text"))


#: Letters whose full casefold is not their lower case, and what they fold to.
FOLDED = [("Straße", "strasse"), ("\ufb03 \ufb00", "ffi ff"), ("ΟΔΟΣ", "οδοσ"), ("\u017fharp", "sharp"), ("\u01f0", "j\u030c"), ("\u0390", "\u03b9\u0308\u0301"), ("\u0130", "i\u0307"), ("\u1e9e", "ss"), ("\u0149", "\u02bcn"), ("\u13f8", "\u13f0")]


@query(values("text, hash", [(raw, hashlib.sha256(out.encode()).hexdigest()) for raw, out in FOLDED]))
def fold_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(raw,) for raw, _ in FOLDED], "text string")
    return rows.select("text", X.content_hash(F.col("text")).alias("hash"))


#: Chats as they come, and how they read: rendered text, code points the assistant wrote, key without reasoning.
CHATS = [
    (1, '[{"role": "User", "content": "hi"}, {"from": "gpt", "value": "yes"}]', "<user>\nhi\n<assistant>\nyes\n", 16, 'messages:[{"content":"hi","role":"user"},{"content":"yes","role":"assistant"}]'),
    (2, '[{"role": "system", "content": "be kind"}, {"from": "human", "text": "why?"}, {"role": "assistant", "content": "so", "reasoning": "think", "reasoning_mode": " HIGH "}]', "<system>\nbe kind\n<user>\nwhy?\n<reasoning:high>\n<assistant>\nthink\n<reasoning:off>\nso\n", 54, 'messages:[{"content":"be kind","role":"system"},{"content":"why?","role":"user"},{"content":"so","role":"assistant"}]'),
    (3, '["not a message", 7, {"content": "no role"}, {"role": "bot", "content": null, "reasoning": "kept"}]', "<user>\nno role\n<reasoning:medium>\n<assistant>\nkept\n<reasoning:off>\n\n", 53, 'messages:[{"content":"no role","role":"user"},{"content":"","role":"assistant"}]'),
    (4, '[{"role": "user", "content": "say <assistant> twice"}, {"role": "tool", "content": "42"}]', "<user>\nsay ‹assistant› twice\n<tool>\n42\n", 0, 'messages:[{"content":"say <assistant> twice","role":"user"},{"content":"42","role":"tool"}]'),
    (5, '{"role": "user"}', "", 0, "messages:[]"),
    (6, '[{"role": "user", "content": "a", "reasoning": "ignored"}]', "<user>\na\n", 0, 'messages:[{"content":"a","role":"user"}]'),
]


@query(values("id, text, assistant_chars, split_key", [(i, *rest) for i, _, *rest in CHATS]))
def message_cases(spark: SparkSession, d: str) -> DataFrame:
    """Names of roles and contents, things that are no message, reasoning with its mode, control tokens inside contents."""
    rows = spark.createDataFrame([(i, raw) for i, raw, *_ in CHATS], "id long, raw string")
    m = rows.select("id", X.normalize_messages(F.parse_json("raw")).alias("m"))
    m = m.select("id", "m", X.render_segments(F.col("m")).alias("s"))
    wrote = F.aggregate(X.assistant_mask(F.col("s")), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("id", X.render_messages(F.col("s")).alias("text"), wrote.alias("assistant_chars"), X.visible_split_key(F.col("m")).alias("split_key"))


@query(values("id", [(1,), (5,)]))
def token_injection_cases(spark: SparkSession, d: str) -> DataFrame:
    """Control tokens count in pretraining texts only, and only as they are written."""
    rows = [(1, "pretrain", "a <user> b"), (2, "sft", "<user>\nhi"), (3, "pretrain", "< user > and <USER>"), (4, "pretrain", None), (5, "pretrain", "end<reasoning:off>"), (6, "pretrain", "")]
    found = audit.categories(F.col("text"), X.PRESERVED_TAGS, F.col("kind"))
    return spark.createDataFrame(rows, "id long, kind string, text string").filter(F.array_contains(found, "special_token_injection")).select("id")


@query("SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN '' ELSE '<system>' || chr(10) || source_name || chr(10) END || '<user>' || chr(10) || prompt || chr(10) || CASE WHEN pair_id % 2 = 0 THEN '<reasoning:high>' || chr(10) ELSE '' END || '<assistant>' || chr(10) AS request FROM preference_samples WHERE prompt IS NOT NULL")
def inference_prompts_full(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with and without a system part and a mode of reasoning."""
    rows = read_table(spark, d, "preference_samples").filter("prompt IS NOT NULL").withColumn("system", F.when(F.col("pair_id") % 3 != 0, F.col("source_name")))
    cue = F.when(F.col("pair_id") % 2 == 0, X.inference_prompt(F.col("system"), F.col("prompt"), "high")).otherwise(X.inference_prompt(F.col("system"), F.col("prompt")))
    return rows.select("pair_id", cue.alias("request"))


@query("SELECT item_id, left('Relevant memories:' || chr(10) || '- ' || question || ' (relevance=0.500)' || chr(10) || '- ' || answer || ' (relevance=0.250)', 200) AS context FROM eval_items WHERE question IS NOT NULL AND answer IS NOT NULL")
def memory_context(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "eval_items").filter("question IS NOT NULL AND answer IS NOT NULL")
    memories = F.array(F.struct(F.col("question").alias("text"), F.lit(0.5).alias("relevance")), F.struct(F.col("answer").alias("text"), F.lit(0.25).alias("relevance")))
    return rows.select("item_id", X.memory_lines(memories, 200).alias("context"))


@query("SELECT item_id, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS answer FROM eval_items")
def normalized_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "eval_items")
    return rows.select("item_id", F.when(F.col("answer").isNotNull(), X.normalized_answer(F.concat(F.lit("  "), F.upper("answer"), F.lit("\n")))).alias("answer"))


# --- numbers ------------------------------------------------------------------------------------------------------------
@query("SELECT id::BIGINT AS id, ceil(32768 / (4 * 512 * 2))::BIGINT AS gathered, greatest(1, 3 * ceil(greatest(1, id) / ceil(32768 / (4 * 512 * 2))))::BIGINT AS steps FROM range(0, 300) r(id)")
def batch_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    gathered, steps = tokens.batch_steps(F.col("id"), 3, 4, 512, 32768, 2)
    return spark.range(300).select("id", gathered.cast("long").alias("gathered"), steps.cast("long").alias("steps"))


@query("SELECT id::BIGINT AS id, floor(id * 0.35)::INT AS budget, CASE WHEN id % 2 = 0 THEN 10.0 - id ELSE id - 10.0 END::DOUBLE AS better, round(0.001 * id / greatest(id - 50, 1), 10) AS ratio, round(CASE WHEN id < 10 THEN 0.001 * (id + 1) / 10 ELSE 0.0001 + 0.0009 * (1 - least(1, (id - 10) / 90.0)) END, 12) AS rate FROM range(0, 100) r(id)")
def training_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Token budget, improvement by direction, ratio of an update, linear schedule."""
    k = F.col("id").cast("double")
    way = F.when(F.col("id") % 2 == 0, "minimize").otherwise("maximize")
    rate = N.learning_rate(F.col("id"), 100, 10, 0.001, 0.0001, "linear")
    return spark.range(100).select("id", N.token_budget(F.col("id"), 0.35).alias("budget"), N.improvement(F.lit(10.0), k, way).alias("better"), F.round(N.update_ratio(F.lit(0.001), k, F.greatest(k - 50, F.lit(1.0))), 10).alias("ratio"), F.round(rate, 12).alias("rate"))


@query("SELECT seq_id, round(coalesce(list_sum(list_transform(range(1, len(labels)), lambda i: CASE WHEN labels[i + 1] <> -100 THEN -((labels[i + 1] % 7) + 1) / 10.0 ELSE 0 END)), 0), 6)::DOUBLE AS logprob FROM token_rows WHERE len(labels) > 1")
def sequence_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Summed log-probabilities of the labels that count, of given log-probabilities."""
    rows = read_table(spark, d, "token_rows").filter("size(labels) > 1")
    logps = F.transform(F.slice(F.col("labels"), F.lit(2), F.size("labels") - 1), lambda y: -((y % 7) + 1) / F.lit(10.0))
    return rows.select("seq_id", F.round(evaluate.sequence_logprob(F.col("labels"), logps), 6).alias("logprob"))


@query()
def masked_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One corrupted block of every row; drawn by hash, so tests check what it has to be rather than SQL."""
    rows = read_table(spark, d, "token_rows").filter("size(input_ids) > 0")
    rows = rows.select("seq_id", "input_ids", F.coalesce("labels", "input_ids").alias("labels"), F.coalesce("seq_lens", F.array(F.size("input_ids"))).alias("lens"))
    return tokens.masked_blocks(rows, "seq_id", "input_ids", "labels", "lens", 4, 16, 0.5)


_LOGITS = "SELECT user_id, event_id, value / 10 AS x FROM events"


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 10).alias("logit"))


@query(f"""WITH t AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY x DESC) AS k FROM ({_LOGITS})) WHERE k <= 6),
p AS (SELECT user_id, event_id, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY user_id) AS p FROM (SELECT *, max(x) OVER (PARTITION BY user_id) AS m FROM t))
SELECT user_id, event_id, round(p, 8) AS p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) WHERE b <= 0.95""")
def top_k_nucleus(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nucleus(_logits(spark, d), "user_id", "event_id", "logit", 0.95, 6).withColumn("p", F.round("p", 8))


@query(f"""WITH p AS (SELECT user_id, event_id, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY user_id) AS p FROM (SELECT *, max(x) OVER (PARTITION BY user_id) AS m FROM ({_LOGITS})))
SELECT user_id, round(-sum(p * ln(greatest(p, 1e-12))), 6) AS entropy, array_to_string((list(event_id ORDER BY p DESC, event_id))[1:5], ',') AS tokens, round(max(p), 8) AS likeliest FROM p GROUP BY user_id""")
def top_trace(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.trace(_logits(spark, d), "user_id", "event_id", "logit")
    return out.select("user_id", F.round("entropy", 6).alias("entropy"), F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), F.round(F.col("probabilities")[0], 8).alias("likeliest"))


@query("SELECT user_id, round(least(1, greatest(0, avg(value / 20) / ln(32000))), 8) AS surprise FROM events GROUP BY user_id")
def output_surprise(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("user_id", (F.col("value") / 20).alias("entropy"))
    return evaluate.surprise(rows, "user_id", "entropy", 32000).withColumn("surprise", F.round("surprise", 8))


# --- evaluation ---------------------------------------------------------------------------------------------------------
@query("SELECT round((1.5 * 4 + 2.0 * 6 + 0.0 * 2) / 12, 8)::DOUBLE AS loss, 12::BIGINT AS tokens, 3::BIGINT AS skipped")
def weighted_loss_cases(spark: SparkSession, d: str) -> DataFrame:
    """Losses that are null or no number are left out and counted, however many tokens they have."""
    rows = spark.createDataFrame([(1.5, 4), (2.0, 6), (float("nan"), 100), (None, 7), (float("nan"), 1), (0.0, 2)], "loss double, tokens long")
    return evaluate.weighted_loss(rows, "loss", "tokens").withColumn("loss", F.round("loss", 8))


@query("SELECT count(*) AS probes, round(avg(CASE WHEN item_id % 3 <> 0 AND choices IS NOT NULL AND answer IS NOT NULL THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM eval_items")
def memory_probes(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that hold the remembered key or another one, or nothing."""
    key = F.concat(F.lit("<"), F.col("item_key"), F.lit(">"))
    output = F.when(F.col("item_id") % 3 == 0, F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("it was <x"), F.col("item_key"), F.lit(">")))).otherwise(F.concat(F.lit("I remember "), key, F.lit(".")))
    rows = read_table(spark, d, "eval_items").select(output.alias("output"), key.alias("answer"))
    return evaluate.containment_accuracy(rows, "output", "answer").withColumn("accuracy", F.round("accuracy", 8))


@query("SELECT round(sum(length(text) / 100.0 * length(text)) / sum(length(text)), 8)::DOUBLE AS loss, sum(length(text))::BIGINT AS tokens, 0::BIGINT AS skipped FROM documents WHERE text <> ''")
def checkpoint_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss of a plugged-in model; here one whose loss grows with the length of a text."""

    def load():  # noqa: ANN202
        import pyarrow.compute as pc

        def score(batch):  # noqa: ANN001, ANN202
            n = pc.utf8_length(batch.column(0))
            return pc.divide(pc.cast(n, "double"), 100.0), pc.cast(n, "int64")

        return score

    rows = evaluate.scored(read_table(spark, d, "documents").filter("text <> ''"), ["text"], load)
    return evaluate.weighted_loss(rows, "loss", "tokens").withColumn("loss", F.round("loss", 8))


@query(values("step, at_step, key, before, after", [(10, 5, "rate", 0.1, 0.2), (10, 10, "rate", 0.2, 0.3), (10, 10, "drop", 0.0, 0.5), (20, 11, "rate", 0.3, 0.05), (40, 40, "drop", 0.5, 0.1)]))
def patches_due(spark: SparkSession, d: str) -> DataFrame:
    """Patches applied at the first step looked at that is not before their own; the one at step 41 never is."""
    patches = spark.createDataFrame([(10, 1, "rate", 0.3), (5, 0, "rate", 0.2), (10, 2, "drop", 0.5), (11, 3, "rate", 0.05), (40, 4, "drop", 0.1), (41, 5, "rate", 1.0)], "at_step long, no long, key string, value double")
    settings = spark.createDataFrame([("rate", 0.1), ("drop", 0.0)], "key string, value double")
    return evaluate.due_patches(patches, settings, spark.createDataFrame([(s,) for s in (0, 10, 20, 30, 40)], "step long"))


_STATE = "(abs(e.value - f.mean) / sqrt(greatest(0.9 * f.spread + 0.1 * (e.value - f.mean) * (e.value - f.mean), 1e-8)) / 4)"


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, value, user_id % 5 AS norm, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, value AS mean, greatest(1e-6, value * value * 0.01) AS spread, 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, 0.0::DOUBLE AS t, 1.0::DOUBLE AS p FROM r WHERE k = 1
UNION ALL SELECT user_id, event_id, k, mean, spread, s, a, t, least(1.2, greatest(0.8, 1 + 0.2 * a - 0.1 * t)) FROM (
 SELECT user_id, event_id, k, mean, spread, s, a, least(1, greatest(0, t + 0.01 * 0.5 * (norm / (1.0 + norm) + s) - 0.005 * (1 - a))) AS t FROM (
  SELECT user_id, event_id, k, mean, spread, s, 0.9 * a + 0.1 * s AS a, t, norm FROM (
   SELECT e.user_id, e.event_id, e.k, 0.9 * f.mean + 0.1 * e.value AS mean, 0.9 * f.spread + 0.1 * (e.value - f.mean) * (e.value - f.mean) AS spread, least(1, {_STATE}) AS s, f.a, f.t, e.norm
   FROM f JOIN r e ON e.user_id = f.user_id AND e.k = f.k + 1))))
SELECT user_id, event_id, round(s, 6) AS surprise, round(a, 6) AS arousal, round(t, 6) AS fatigue, round(p, 6) AS plasticity FROM f""")
def modulation(spark: SparkSession, d: str) -> DataFrame:
    """Surprise, arousal, fatigue and plasticity after every step of a log."""
    rows = read_table(spark, d, "events").select("user_id", "event_id", "value", (F.col("user_id") % 5).cast("double").alias("norm"))
    out = evaluate.modulated(rows, "user_id", "event_id", "value", "norm", decay=0.9)
    return out.select("user_id", "event_id", *[F.round(c, 6).alias(c) for c in ("surprise", "arousal", "fatigue", "plasticity")])


@query(values("arm, metric, mean, complete", [("base", "loss", 1.5, True), ("base", "acc", 0.55, True), ("wide", "loss", 1.25, True), ("wide", "acc", 0.5, False), ("deep", "loss", 2.0, False), ("deep", "acc", None, False)]))
def arm_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over seeds; a cell that is missing, repeated or not finite makes its arm and metric incomplete. Other arms do not count."""
    rows = [("base", 1, "loss", 1.0), ("base", 2, "loss", 2.0), ("base", 1, "acc", 0.5), ("base", 2, "acc", 0.6), ("wide", 1, "loss", 1.0), ("wide", 2, "loss", 1.5), ("wide", 1, "acc", 0.5), ("wide", 2, "acc", float("nan")), ("deep", 1, "loss", 2.0), ("deep", 1, "loss", 2.0), ("deep", 2, "loss", 2.0), ("other", 1, "loss", 9.0), ("base", 3, "loss", 9.0)]
    results = spark.createDataFrame(rows, "arm string, seed long, metric string, value double")
    return evaluate.arm_results(results, ["base", "wide", "deep"], [1, 2], ["loss", "acc"])


@query(values("id, reason", [(None, "no id"), ("b", "repeated id"), ("b", "repeated id"), ("c", "question"), ("d", "labels"), ("e", "labels"), ("f", "choices"), ("g", "answer"), ("h", "answer")]))
def strict_items(spark: SparkSession, d: str) -> DataFrame:
    """Everything a strict loader of multiple-choice items refuses."""
    ab = {"A": "x", "B": "y"}
    rows = [("a", "q", ab, "A"), (None, "q", ab, "A"), ("b", "q", ab, "A"), ("b", "q", ab, "B"), ("c", " ", ab, "A"), ("d", "q", {"A": "x"}, "A"), ("e", "q", None, "A"), ("f", "q", {"A": "x", "B": " "}, "A"), ("g", "q", ab, "C"), ("h", "q", ab, None)]
    return evaluate.item_problems(spark.createDataFrame(rows, "id string, question string, choices map<string,string>, answer string"), "id", "choices", "answer", ("A", "B"), ("question",))


# --- splits and choices -------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'valid' ELSE 'train' END AS split FROM documents")
def fallback_test(spark: SparkSession, d: str) -> DataFrame:
    """Without validation rows the test rows validate."""
    rows = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    return sampling.with_fallback(rows, "split", "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id = max(doc_id) OVER () THEN 'valid' ELSE 'train' END AS split FROM documents")
def fallback_last(spark: SparkSession, d: str) -> DataFrame:
    """Without either the last training row does."""
    return sampling.with_fallback(read_table(spark, d, "documents").select("doc_id", F.lit("train").alias("split")), "split", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Without test rows the validation rows are used."""
    rows = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "valid").otherwise("train").alias("split"))
    return sampling.evaluation_rows(rows, "split").select("doc_id")


@query("SELECT source_name, length(source_name) % 2 = 0 AS allowed FROM sources UNION ALL SELECT 'nowhere', false")
def requested_sources(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "sources").select("source_name")
    return sampling.requested(s.unionByName(spark.createDataFrame([("nowhere",)], "source_name string")), s.filter(F.length("source_name") % 2 == 0), "source_name")


@query(values("path, stage", [("/b", "sft")]))
def checkpoint_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first complete stage, as the wanted path is not complete."""
    rows = spark.createDataFrame([("/a", "pretrain", True), ("/b", "sft", True), ("/c", "dpo", False), ("/d", "other", True)], "path string, stage string, complete boolean")
    return governance.first_complete(rows, "/c").select("path", "stage")


# --- memory -------------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_CLUSTERS},
c AS (SELECT label, anchor, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT f.label, f.anchor, unnest(range(0, len(r.e))) AS axis, unnest(r.e) / sqrt(list_sum(list_transform(r.e, lambda y: y * y))) AS v, greatest(0.05, (r.vec_id % 10) / 10.0) AS w FROM f JOIN r ON r.vec_id = f.id),
g AS (SELECT label, anchor, list(v ORDER BY axis) AS e FROM (SELECT label, anchor, axis, sum(v * w) / sum(w) AS v FROM x GROUP BY ALL) GROUP BY ALL),
o AS (SELECT c.label, c.anchor, c.n, g.e, row_number() OVER (PARTITION BY c.label ORDER BY c.anchor) AS k FROM c JOIN g USING (label, anchor)),
h AS (SELECT label, k, [{{'e': list_transform(e, lambda y: y / sqrt(list_sum(list_transform(e, lambda z: z * z)))), 'n': n, 'first': anchor}}] AS held FROM o WHERE k = 1
UNION ALL SELECT o.label, o.k, CASE WHEN m.i IS NULL THEN list_append(h.held, {{'e': m.u, 'n': o.n, 'first': o.anchor}}) ELSE list_transform(h.held, lambda y, i: CASE WHEN i = m.i THEN {{'e': list_transform(y.e, lambda z, j: (z * y.n + m.u[j] * o.n) / (y.n + o.n)), 'n': y.n + o.n, 'first': y.first}} ELSE y END) END
FROM h JOIN o ON o.label = h.label AND o.k = h.k + 1, LATERAL (SELECT list_transform(o.e, lambda y: y / sqrt(list_sum(list_transform(o.e, lambda z: z * z)))) AS u, list_position(list_transform(h.held, lambda y: list_cosine_similarity(y.e, o.e) >= 0.25), true) AS i) m)
SELECT label, unnest(held).first AS anchor, unnest(held).n::BIGINT AS support FROM h WHERE k = (SELECT max(k) FROM o WHERE o.label = h.label)""")
def memory_gists(spark: SparkSession, d: str) -> DataFrame:
    """What clusters leave behind, later clusters merged into the first gist that is like them."""
    rows = read_table(spark, d, "embeddings").withColumn("salience", (F.col("vec_id") % 10) / 10)
    return vectors.gists(rows, "label", "vec_id", "embedding", "salience", 0.25).select("label", F.col("members")[0].alias("anchor"), "support")


@query("SELECT vec_id, CASE vec_id % 25 WHEN 1 THEN 'size' WHEN 2 THEN 'not finite' WHEN 3 THEN 'zero' WHEN 4 THEN 'salience' WHEN 5 THEN 'salience' END AS reason FROM embeddings WHERE vec_id % 25 BETWEEN 1 AND 5")
def memory_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id") % 25
    e = F.col("embedding").cast("array<double>")
    vector = F.when(k == 1, F.slice(e, 1, 3)).when(k == 2, F.transform(e, lambda x: F.lit(float("nan")))).when(k == 3, F.transform(e, lambda x: F.lit(0.0))).otherwise(e)
    salience = F.when(k == 4, F.lit(1.5)).when(k == 5, F.lit(None).cast("double")).otherwise(F.lit(0.5))
    rows = read_table(spark, d, "embeddings").select("vec_id", vector.alias("v"), salience.alias("s"))
    return vectors.memory_problems(rows, "vec_id", "v", "s", 64)


@query("SELECT label, axis::INT AS axis, round(sum(v * w) / sum(w), 8) AS value FROM (SELECT label, unnest(range(0, len(e))) AS axis, unnest(e) / z AS v, w FROM (SELECT label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS z, greatest(0.05, (vec_id % 4) / 4.0) AS w FROM embeddings)) GROUP BY ALL")
def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").withColumn("w", (F.col("vec_id") % 4) / 4)
    return vectors.centroids(rows, "label", "embedding", "w").withColumn("value", F.round("value", 8))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY least(value, 80) DESC, event_id) AS k FROM events) WHERE k <= 2")
def replay_eviction(spark: SparkSession, d: str) -> DataFrame:
    """A buffer for each owner of two rows at most: what stays when the weakest goes as better rows come."""
    rows = read_table(spark, d, "events").select("user_id", "event_id", (-F.least(F.col("value"), F.lit(80.0))).alias("minus"))
    return audit.first_of_group(rows, ["user_id"], ["minus", "event_id"], 2, "event_id").select("user_id", "event_id")


@query("SELECT pair_id, prompt AS question, rejected AS answer FROM preference_samples WHERE prompt <> '' AND rejected <> ''")
def instruction_context(spark: SparkSession, d: str) -> DataFrame:
    """Instruction rows under other names, with an empty context."""
    rows = read_table(spark, d, "preference_samples").select("pair_id", F.to_variant_object(F.struct(F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.col("rejected").alias("output"))).alias("row"))
    m = rows.select("pair_id", chat.instruction_messages(F.col("row")).alias("m")).filter("m IS NOT NULL")
    return m.select("pair_id", F.col("m")[0]["content"].alias("question"), F.col("m")[1]["content"].alias("answer"))
