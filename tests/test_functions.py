"""Functions and sources against plain Python on crafted rows."""

import html
import json
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import numeric as N
from quern.functions import text as X
from quern.operators import audit, chat, evaluate, governance, sampling, tokens, vectors
from quern.plans.catalog import QUERIES
from quern.plans.shared import attach_by_key
from quern.sources import files, sinks
from quern.streaming import flows

TEXTS = ["Ａ\0<b>x</b> <assistant>", "&lt;b&gt;bold&lt;/b&gt; &amp; ﬁne", "  a\tb　c\x07 ", "", None, "<user>keep</user> <pad>", "é ß ﬁ �", "a<>b < c > d"]


def plain_clean(t):
    t = html.unescape(unicodedata.normalize("NFKC", t or ""))
    t = re.sub(r"<[^>]+>", lambda m: m[0] if m[0] in X.PRESERVED_TAGS else " ", t)
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]", "", t)
    return re.sub(r"\s+", " ", t).strip()


def test_clean_text(spark, sf):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.clean_text(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [plain_clean(t) for t in TEXTS]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", X.clean_text(F.col("text")).alias("c"))
    assert all(r.c == plain_clean(r.text) for r in docs.collect())


def test_content_hash_folds_case_and_space(spark):
    rows = spark.createDataFrame([("Straße  X",), ("STRASSE x ",), (" strasse x",)], "t string")
    assert rows.select(X.content_hash(F.col("t"))).distinct().count() == 1


def test_messages(spark):
    raw = [{"from": "human", "value": "hi <user>"}, 7, {"role": "assistant", "content": "yes", "reasoning": "why", "reasoning_mode": "HIGH "}, {"role": "odd", "text": "z"}]
    df = spark.createDataFrame([(json.dumps(raw),), ('{"no": 1}',)], "j string").select(X.normalize_messages(F.parse_json("j")).alias("m"))
    rows = df.collect()
    assert [(m.role, m.content, m.reasoning, m.reasoning_mode) for m in rows[0].m] == [("user", "hi <user>", None, None), ("assistant", "yes", "why", "high"), ("odd", "z", None, None)]
    assert rows[1].m == []
    out = df.limit(1).select(X.render_segments(F.col("m")).alias("s")).select(X.render_messages(F.col("s")).alias("t"), X.assistant_mask(F.col("s")).alias("k")).first()
    want = "<user>\nhi ‹user›\n", "<reasoning:high>\n<assistant>\nwhy\n<reasoning:off>\nyes\n", "<odd>\nz\n"
    assert out.t == "".join(want) and list(out.k) == [0] * len(want[0]) + [1] * len(want[1]) + [0] * len(want[2])
    bad = spark.createDataFrame([('[{"role": "assistant", "reasoning_mode": "wild"}]',)], "j string")
    with pytest.raises(Exception, match="reasoning_mode"):
        bad.select(X.normalize_messages(F.parse_json("j"))).collect()


def test_luhn(spark):
    cases = {"4111111111111111": True, "4111111111111112": False, "0000000000000000": False, "79927398713": False, "378282246310005": True}
    rows = spark.createDataFrame([(k,) for k in cases], "d string").select("d", N.luhn(F.col("d")).alias("ok")).collect()
    assert {r.d: r.ok for r in rows} == cases


def test_choice_template_is_expanded_once(spark):
    df = spark.createDataFrame([("is {choices} fun?", {"B": "no", "A": "yes {labels}"})], "q string, c map<string,string>")
    assert df.select(X.choice_prompt(F.col("q"), F.col("c"))).first()[0] == "is {choices} fun?\nA. yes {labels}\nB. no\nAnswer with one of A, B."


def test_perplexity_rejects_bad_losses(spark):
    df = spark.createDataFrame([(1.0,), (1e6,)], "x double").select(N.perplexity(F.col("x")).alias("p"))
    assert [round(r.p, 6) for r in df.collect()][0] == round(math.e, 6)
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(-1.0,)], "x double").select(N.perplexity(F.col("x"))).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n\n{"text": "two"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"text": "x"}, {"items": [{"text": "y"}]}, {"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a"}, {"text": "b"}]}]}]}]}))
    (tmp_path / "c.txt").write_text("whole\nfile")
    (tmp_path / "d.csv").write_text('text,lang\n"a, ""b""",en\n')
    (tmp_path / "e.tsv").write_text("text\tlang\n1\tko\n")
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    read = lambda n: [json.loads(r.j) for r in files.read_rows(spark, f"{tmp_path}/{n}").orderBy("path", "row_no").select(F.to_json("row").alias("j")).collect()]
    assert read("a.jsonl") == [{"text": "one"}, {"text": "two"}]
    assert [r.get("text", r.get("output")) for r in read("b.json")] == ["x", "y", "a"]
    assert read("c.txt") == [{"text": "whole\nfile"}]
    assert read("d.csv") == [{"text": 'a, "b"', "lang": "en"}] and read("e.tsv") == [{"text": "1", "lang": "ko"}]
    with pytest.raises(Exception, match="bad.jsonl"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl").collect()
    assert files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", strict=False).count() == 0
    assert len(files.expand(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/a.jsonl"])) == 2
    scan = files.union_scan(spark, [{"name": "s", "path": f"{tmp_path}/a.jsonl"}, {"name": "t", "path": f"{tmp_path}/c.txt"}])
    assert {(r.source_name, r.n) for r in scan.groupBy("source_name").agg(F.count("*").alias("n")).collect()} == {("s", 2), ("t", 1)}
    with pytest.raises(FileNotFoundError):
        files.union_scan(spark, [{"name": "s", "path": f"{tmp_path}/none*.jsonl"}])
    lock = governance.source_lock(spark, [{"name": "s", "path": f"{tmp_path}/a.jsonl"}, {"name": "e", "path": f"{tmp_path}/a.jsonl", "purpose": "evaluation"}])
    assert governance.purpose_conflicts(lock).count() == 1 and governance.lock_changes(lock, lock).count() == 0
    sums = files.checksums(files.file_list(spark, [f"{tmp_path}/a.jsonl"])).first()
    assert (sums.bytes, sums.newlines) == (33, 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1.5), (None, None)], "text string, x double")
    sinks.write_jsonl(df, f"{tmp_path}/o")
    assert {r.value for r in spark.read.text(f"{tmp_path}/o").collect()} == {'{"text":"a\\nb","x":1.5}', '{"text":null,"x":null}'}
    sinks.write_tokenizer_corpus(df, "text", f"{tmp_path}/c")
    assert [r.value for r in spark.read.text(f"{tmp_path}/c").collect()] == ["a b"]
    with pytest.raises(Exception, match="finite"):
        sinks.write_jsonl(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/n")


def test_denylist_file(spark, tmp_path):
    h = "AB" * 32
    (tmp_path / "d").write_text(f"# note\n\n{h}\n{h.lower()}\n")
    assert [r.hash for r in files.read_denylist(spark, f"{tmp_path}/d").collect()] == [h.lower()]
    (tmp_path / "e").write_text("xyz\n")
    with pytest.raises(Exception, match="SHA-256"):
        files.read_denylist(spark, f"{tmp_path}/e").collect()


def test_hot_keys_keep_all_rows(spark):
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 7000).cast("string"))).alias("key"))
    facts = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out = attach_by_key(rows, facts, "key", "id", "n", 30_000)
    assert out.count() == 30_000 and out.filter("key = 'hot' AND least <> 0").count() == 0
    capped = audit.first_of_group(rows, ["key"], ["id"], 5, "id").filter("key = 'hot'")
    assert sorted(r.id for r in capped.collect()) == [0, 3, 6, 9, 12]


def test_final_chunks_and_packing(spark):
    df = spark.createDataFrame([(list(range(10, 17)),)], "a array<int>")
    assert df.select(tokens.with_final(F.col("a"), 3, 2)).first()[0] == [[10, 11, 2], [13, 14, 2], [16, 2]]
    items = spark.createDataFrame([(1, k, n) for k, n in enumerate((5, 5, 3, 8, 12, 1))] + [(2, 0, 4)], "s int, k int, n int")
    got = {(r.s, r.k): r.bin for r in tokens.greedy_bins(items, "s", "k", "n", 10).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 4, (2, 0): 0}


def test_diverse_and_clusters(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(30)], "id long, owner int, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in vectors.clusters(df, "owner", "id", "vec", 0.5).collect():
        got[r.id] = r.anchor
    want = {}
    for i in range(30):
        if i not in want:
            want[i] = i
            for j in range(i + 1, 30):
                if j not in want and j % 2 == i % 2 and u[i] @ u[j] >= 0.5:
                    want[j] = i
    assert got == want
    picked = [r.id for r in vectors.diverse(df, df.filter("id = 0"), "id", "vec", 5, 30).orderBy("rank").collect()]
    chosen = []
    for _ in range(5):
        best = max((i for i in range(30) if i not in chosen), key=lambda i: (round(u[0] @ u[i] - 0.2 * max([0, *(u[i] @ u[j] for j in chosen)]), 12), -i))
        chosen.append(best)
    assert picked == chosen


def test_settings_diff():
    a, b = {"x": {"y": 1, "z": [1]}, "w": 1}, {"x": {"y": 1.0, "z": [1]}, "v": 2}
    assert governance.changed_settings(a, b) == ["v", "w", "x.y"]
    assert governance.undeclared_changes(a, b, {"v", "q"}, ("x",)) == (["w"], ["q"])


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "source string, doc_id long, text string")
    deny = spark.createDataFrame([], "hash string")
    assert audit.audit(none, "source", "doc_id", "text", deny).count() == 0
    assert sampling.deduplicated(none, "text", "doc_id").count() == 0
    assert sampling.positional_split(none, "doc_id").count() == 0


def test_ema_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = flows.ema_stream(flows.read_landing(spark, f"{tmp_path}/in", "k string, v double"), "k", "v", 0.5)
    stream.writeStream.outputMode("update").format("memory").queryName("ema_out").trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.ema) for r in spark.table("ema_out").collect()} == {("a", 2.0), ("b", 2.0)}


def test_weighted_sample_follows_weights(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w"))
    a = vectors.weighted_sample(df, "id", "w", 400, 1)
    heavy = a.filter("id < 1000").count()
    assert a.count() == 400 and 320 <= heavy <= 390
    assert {r.id for r in a.collect()} == {r.id for r in vectors.weighted_sample(df, "id", "w", 400, 1).collect()}


def test_memory_lines_and_answers(spark):
    m = spark.createDataFrame([([("hello", 0.5)],)], "m array<struct<text string, relevance double>>")
    assert m.select(X.memory_lines(F.col("m"), 30)).first()[0] == "Relevant memories:\n- hello (relevance=0.500)"[:30]
    assert m.select(X.normalized_answer(F.lit(" STRAẞE  <b>x</b> "))).first()[0] == "strasse x"


def test_masked_blocks(spark, sf):
    rows = {r.seq_id: r for r in spark.read.parquet(f"{sf}/token_rows.parquet").collect()}
    out = QUERIES["masked_blocks"](spark, sf).collect()
    assert out
    for r in out:
        src = rows[r.seq_id]
        labels = src.labels or src.input_ids
        hit = [i for i, y in enumerate(r.labels) if y != -100]
        assert hit and all(r.input_ids[i] == 4 and r.labels[i] == src.input_ids[i] and labels[i] != -100 for i in hit)
        assert all(a == b for i, (a, b) in enumerate(zip(r.input_ids, src.input_ids)) if i not in hit)
        assert r.start <= hit[0] and hit[-1] < r.end <= r.start + 16
        borders = [0]
        for n in src.seq_lens or [len(src.input_ids)]:
            borders.append(borders[-1] + n)
        inside = max(b for b in borders if b <= r.start)
        assert (r.start - inside) % 16 == 0 and all(b <= r.start or b >= r.end for b in borders)


def test_governance_of_settings(spark, tmp_path):
    settings = {"data": {"train": "/a", "none": None}, "ratio": {"a": 0.8, "b": 0.1, "c": 0.1}}
    hidden = governance.redacted(settings, {"data.train": "<local>", "data.none": "<local>", "data.gone.deep": "<local>"})
    assert hidden["data"] == {"train": "<local>", "none": None} and settings["data"]["train"] == "/a"
    assert governance.settings_problems(settings, {"ratio.a": (0, 0.5), "ratio.b": (0, 1), "x": (0, 1)}, ("ratio.a", "ratio.b", "ratio.c")) == ["ratio.a", "x"]
    assert governance.settings_problems({"r": {"a": 0.5, "b": True}}, {}, ("r.a", "r.b")) == ["r.a+r.b"]
    assert governance.template_problems("{question} {labels}", ("question", "choices", "labels")) == ["missing choices"]
    assert governance.template_problems(" ", ()) == ["blank"] and governance.template_problems("{x}", ()) == ["unknown x"]
    (tmp_path / "corpus.txt").write_text("one\ntwo\n")
    manifest = governance.corpus_manifest(spark, f"{tmp_path}/corpus.txt", {"policy": 1})
    assert (manifest["bytes"], manifest["lines"]) == (8, 2) and governance.manifest_problems(spark, f"{tmp_path}/corpus.txt", manifest, {"policy": 1}) == []
    (tmp_path / "corpus.txt").write_text("one\ntwa\n")
    assert governance.manifest_problems(spark, f"{tmp_path}/corpus.txt", manifest, {"policy": 2}) == ["files", "policy"]
    source = [{"name": "c", "path": f"{tmp_path}/corpus.txt"}]
    a = governance.data_signature(spark, source)
    assert governance.fingerprint("sft", settings, a) != governance.fingerprint("dpo", settings, a) and a == governance.data_signature(spark, source)
    (tmp_path / "m.yaml").write_text("pack: p\nsources:\n  - name: c\n    path: x\n")
    assert files.load_manifest(f"{tmp_path}/m.yaml") == [{"name": "c", "path": "x"}]
    (tmp_path / "n.json").write_text('{"sources": [], "other": 1}')
    with pytest.raises(ValueError, match="other"):
        files.load_manifest(f"{tmp_path}/n.json")


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"k": {i}}}\n' if i != 3777 else "{broken\n" for i in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        assert {(r.path[-7:], r.line_no) for r in files.jsonl_problems(spark, f"{tmp_path}/*.jsonl").collect()} == {("a.jsonl", 3778), ("b.jsonl", 3778)}
        with pytest.raises(ValueError, match=r"a\.jsonl:3778"):
            files.check_jsonl(spark, f"{tmp_path}/*.jsonl")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_tokenizer_checks(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a?c"), (3, None), (4, "ABC")], "id long, text string")

    def load():
        return (lambda t: [0 if c == "?" else ord(c) for c in t.lower()]), (lambda ids: "".join(map(chr, ids)))

    assert {tuple(r) for r in tokens.round_trip_problems(df, "id", "text", load, 0).collect()} == {(2, "unknown id"), (4, "other text")}
    assert tokens.digit_pieces(["a1", "12", "x", "١٢"]) == ["12", "١٢"]


def test_hot_keys_in_ordered_folds(spark):
    """One key holds a third of all rows: it is spread over blocks, and folds and running values stay exact."""
    rows = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("key"), ((F.col("id") * 7919) % 1000 / 10).alias("v"))
    data = sorted((r.id, r.key, r.v) for r in rows.collect())
    mean, best, before = {}, {}, {}
    for i, k, v in data:
        mean[k] = v if k not in mean else mean[k] * 0.9 + v * 0.1
    folded = {r.key: r.ema for r in evaluate.ema(rows, "key", "id", "v", 0.1).collect()}
    assert folded.keys() == mean.keys() and all(abs(folded[k] - x) < 1e-9 for k, x in mean.items())
    want_best, want_change = {}, {}
    for i, k, v in data:
        low, no, at = best.get(k, (None, 0, 0))
        better = low is None or v < low
        best[k] = (v if better else low, no + 1, no + 1 if better else at)
        want_best[i] = (low, better, no + 1 - best[k][2])
        want_change[i] = before.get(k)
        before[k] = v
    assert {r.id: (r.best, r.better, r.stale) for r in evaluate.running_best(rows, "key", "id", "v").collect()} == want_best
    assert {r.id: r.value_before for r in evaluate.changes(rows, "key", "id", "v").collect()} == want_change


def test_packing_goes_on_through_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, 3 + i % 5) for i in range(100)] + [(2, i, 25) for i in range(3)], "s long, k long, n long")
    monkeypatch.setattr(tokens, "PACK_RANGE", 30)
    out = tokens.greedy_packs(rows, "s", "k", "n", 10).collect()
    fill = {}
    for r in out:
        fill[r.s, r.bin] = fill.get((r.s, r.bin), 0) + r.n
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(3 + i % 5 for i in range(100)) + 75
    assert sorted({b for s, b in fill if s == 1}) == list(range(len({b for s, b in fill if s == 1})))
    assert sorted(b for s, b in fill if s == 2) == list(range(-9, 0))


def test_gists_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(i, i % 2, (base[i % 6] + rng.normal(scale=0.15, size=8)).tolist(), (i % 10) / 10) for i in range(120)]
    got = {(r.o, r.gist): r for r in vectors.gists(spark.createDataFrame(rows, "i long, o long, v array<double>, s double"), "o", "i", "v", "s", 0.9).collect()}
    unit = lambda x: np.asarray(x) / np.linalg.norm(x)
    want = {}
    for owner in (0, 1):
        own, used, held = [r for r in rows if r[1] == owner], set(), []
        for k, a in enumerate(own):
            if a[0] in used:
                continue
            cluster = [a, *(b for b in own[k + 1 :] if b[0] not in used and unit(a[2]) @ unit(b[2]) >= 0.9)]
            if len(cluster) < 2:
                continue
            used |= {b[0] for b in cluster}
            w = np.array([max(0.05, b[3]) for b in cluster])
            x = unit((np.stack([unit(b[2]) for b in cluster]) * w[:, None]).sum(0) / w.sum())
            near = next((g for g in held if g[0] @ x >= 0.9), None)
            if near is None:
                held.append([x, len(cluster), np.mean([b[3] for b in cluster])])
            else:
                near[0], near[1] = unit((near[0] * near[1] + x * len(cluster)) / (near[1] + len(cluster))), near[1] + len(cluster)
        want |= {(owner, k + 1): g for k, g in enumerate(held)}
    assert got.keys() == want.keys() and len(want) > 2
    for k, (x, n, s) in want.items():
        assert got[k].support == n and np.allclose(got[k].embedding, x) and abs(got[k].salience - s) < 1e-9


def test_preferences_for_training(spark):
    rows = spark.createDataFrame([(1, "p", "c", "r"), (2, "", "c", "r"), (3, "p", "write to a.b@mail.example", "r")], "i long, prompt string, chosen string, rejected string")
    rows = rows.select("i", F.to_variant_object(F.struct("prompt", "chosen", "rejected")).alias("row"))
    assert [r.i for r in chat.preferences(rows, "i", "row", "evaluation").orderBy("i").collect()] == [1, 3]
    assert [r.i for r in chat.preferences(rows.filter("i < 3"), "i", "row", "training").collect()] == [1]
    with pytest.raises(Exception, match="preference row 3 holds email"):
        chat.preferences(rows, "i", "row", "training").collect()


def test_logs_are_appended(spark, tmp_path):
    for step in (1, 2):
        sinks.append_log(spark.createDataFrame([(step, step / 2)], "step long, loss double"), f"{tmp_path}/log")
    rows = files.read_log(spark, f"{tmp_path}/log", ("step", "loss")).orderBy("step").collect()
    assert [(r.step, r.loss) for r in rows] == [("1", "0.5"), ("2", "1.0")] or [(r.step, r.loss) for r in rows] == [("1", "0.5"), ("2", "1")]


def test_repeated_questions(spark):
    items = spark.createDataFrame([(1, "Who?"), (2, " who? "), (3, "What?"), (4, None)], "i long, q string")
    found = {(r.kind, r["items"]) for r in audit.required_hashes(items, "i", F.col("q"), F.concat(F.col("q"), F.col("i").cast("string"))).collect()}
    assert found == {("question", 2), ("question", 1), ("prompt", 1)}
