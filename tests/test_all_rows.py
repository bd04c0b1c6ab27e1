"""Cases beyond the given tables, and queries without SQL against plain versions."""

import hashlib
import re

import numpy as np

from quern.functions import text as X
from quern.operators import tokens, vectors
from quern.plans.catalog import QUERIES
from tests.test_functions import plain_clean


def test_over_long_rows_are_packed_in_chunks(spark, sf):
    items = spark.createDataFrame([(1, k, n) for k, n in enumerate((8, 25, 1, 12, 10, 3))] + [(2, 0, 11)], "s int, k int, n int")
    got = {(r.s, r.k, r.start): (r.n, r.bin) for r in tokens.greedy_packs(items, "s", "k", "n", 10).collect()}
    assert got == {
        (1, 0, 0): (8, 0), (1, 1, 0): (10, -1), (1, 1, 10): (10, -2), (1, 1, 20): (5, -3), (1, 2, 0): (1, 0),
        (1, 3, 0): (10, -4), (1, 3, 10): (2, -5), (1, 4, 0): (10, 1), (1, 5, 0): (3, 2), (2, 0, 0): (10, -1), (2, 0, 10): (1, -2),
    }
    rows = spark.read.parquet(f"{sf}/token_rows.parquet").collect()
    assert sum(r.n for r in QUERIES["pack_greedy"](spark, sf).collect()) == sum(len(r.input_ids or ()) for r in rows if r.source_name)


def test_labels_rendering_and_cleaning_of_all_rows(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/text_samples.parquet").collect() if r.text is not None]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in rows:
        if r.kind == "sft" and r.text and r.labels_mask is not None and len(r.labels_mask) == len(r.text):
            ids = [20 + ord(c) % 200 for c in r.text]
            labels = [i if m == 1 else -100 for i, m in zip(ids, r.labels_mask)]
            want[r.sample_id] = (len(ids) + 2, sum(ids) + 3, sum(labels) - 100 + (2 if r.labels_mask[-1] == 1 else -100))
    got = {r.sample_id: (r.n, r.ids, r.labels) for r in QUERIES["assistant_labels"](spark, sf).collect()}
    assert got == want and any(not r.text.isascii() for r in rows if r.sample_id in want)
    talks = {}
    for r in rows:
        if r.kind == "sft" and r.text.startswith("<"):
            parts = [p for p in re.sub(r"(?m)^<(system|user|assistant)>\n", "\x01\\1\x02", r.text).split("\x01") if p]
            turns = [(p.partition("\x02")[0], p.rpartition("\x02")[2]) for p in parts]
            turns = [(role, re.sub(r"\n+$", "", c).strip(" ")) for role, c in turns]
            for tag in sorted(X.PRESERVED_TAGS, key=len, reverse=True):
                turns = [(role, c.replace(tag, tag.replace("<", "‹").replace(">", "›"))) for role, c in turns]
            segments = [(role, f"<{role}>\n{c}\n") for role, c in turns]
            talks[r.sample_id] = (digest("".join(t for _, t in segments)), sum(len(t) for role, t in segments if role == "assistant"))
    assert {r.sample_id: (r.text_hash, r.assistant_chars) for r in QUERIES["render_conversation"](spark, sf).collect()} == talks
    assert {r.sample_id: r.hash for r in QUERIES["clean_samples"](spark, sf).collect()} == {r.sample_id: digest(plain_clean(r.text)) for r in rows}


def test_diverse_choice_beyond_the_pool(spark):
    copies = [(i, [0.9, 0.436, 0.0]) for i in range(1, 51)]  # a hot group of one vector
    others = [(60, [0.88, -0.475, 0.0]), (61, [0.88, 0.0, 0.475]), (62, [-1.0, 0.0, 0.0])]
    memory = spark.createDataFrame([*copies, *others], "id long, v array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "id long, v array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in [*copies, *others]}
    want = []
    for _ in range(5):
        value = {i: u[0] - 0.2 * max([0, *(u @ unit[j] for j in want)]) for i, u in unit.items() if i not in want}
        want.append(max(value, key=lambda i: (round(value[i], 12), -i)))
    assert 60 in want[:3]
    for pool in (40, 60):
        got = vectors.diverse(memory, query, "id", "v", 5, pool).orderBy("rank")
        assert [r.id for r in got.collect()] == want


def test_clusters_of_a_hot_label(spark):
    df = spark.range(20_100).selectExpr("'hot' AS label", "id", "IF(id % 2 = 0, array(1D, 0D), array(0D, 1D)) AS v")
    got = {(r.anchor, r.n) for r in vectors.clusters(df, "label", "id", "v", 0.8).groupBy("anchor").count().withColumnRenamed("count", "n").collect()}
    assert got == {(0, 10_050), (1, 10_050)}
