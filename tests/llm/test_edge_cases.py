"""Every operator with nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import pytest

from quern.llm import p1_surrogates, p2_groups, p3_defects, p4_overlap, p5_pack, p6_collapse, p7_encode, p8_leak, p9_split

LONG = "Nobody traded her plain kettle, so the harbor stayed quiet. " * 4000
# Extra columns that clash with names the operators use inside.
EXTRA = ", text2 string, id string, term string, key string, n int, class string, spans string, label string, u int, v int, start int, length int"


def texts(spark, rows):
    full = [(i, s, t, m, *["x"] * 4, 1, "c", "s", "l", 1, 2, 3, 4) for i, s, t, m in rows]
    return spark.createDataFrame(full, "sample_id long, split_name string, text string, meta string" + EXTRA)


@pytest.fixture(scope="module")
def dirty(spark):
    return texts(
        spark,
        [
            (1, "train", None, None),
            (2, "valid", "", "{broken"),
            (3, "test", "  \n\t​", "[]"),
            (4, "train", LONG, '{"author": "Fern.12", "refs": [null, "kite-forum/1"]}'),
            (5, "valid", LONG.upper(), '{"author": null, "url": "http://www.kite-forum.example/1?x=2"}'),
            (6, None, LONG, '{"author": "anonymous"}'),
            (None, "train", "x@y.example and more", None),
            (7, "train", "same words here", '{"author": "fern-12"}'),
            (7, "train", "same words here", '{"author": "fern-12"}'),
            (8, "test", "Same... WORDS (here)", None),
            (9, "valid", "名前 は 名前", '{"entity": "none"}'),
        ],
    )


@pytest.fixture(scope="module")
def none(spark):
    return texts(spark, [])


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_p6(dirty, none):
    assert rows(p6_collapse.found(dirty)) == {(4, 5), (4, 6), (7, 8)}
    assert rows(p6_collapse.found(none)) == set()


def test_p4(dirty, none):
    assert rows(p4_overlap.found(dirty)) == {(4, 5), (7, 8)}
    assert rows(p4_overlap.found(none)) == set()


def test_p2(dirty, none):
    assert rows(p2_groups.found(dirty)) == {(4, 4), (4, 5), (4, 7)}
    assert rows(p2_groups.found(none)) == set()
    split = {r["sample_id"]: r["split"] for r in p2_groups.splits(dirty).collect()}
    assert set(split) == set(range(1, 10)) and split[4] == split[5] == split[7]
    assert set(split.values()) <= {"train", "valid", "test"}
    assert p2_groups.splits(none).count() == 0


def test_p1(dirty, none):
    found = p1_surrogates.found([(dirty, "t", "sample_id", "text")])
    assert rows(found) == set()
    assert rows(p1_surrogates.found([(none, "t", "sample_id", "text")])) == set()
    out = p1_surrogates.anonymized([(dirty, "t", "sample_id", "text")]).collect()
    assert len(out) == 11 and {r["rec_id"]: r["placeholder_text"] for r in out}[1] is None


def test_p7_p9(dirty, none):
    ids = {r["sample_id"]: r["ids"] for r in p7_encode.encode_corpus(dirty, "sample_id", "text").collect()}
    assert ids[1] == [] and ids[2] == [] and len(ids[4]) > 40_000
    assert p7_encode.encode_corpus(none, "sample_id", "text").count() == 0
    pieces = p9_split.split_oversized(dirty, "sample_id", "text").collect()
    assert {r["sample_id"] for r in pieces} == {4, 5, 6}
    assert max(r["n_tokens"] for r in pieces) <= 512
    assert p9_split.split_oversized(none, "sample_id", "text").count() == 0


def items(spark, data):
    return spark.createDataFrame(data, "item_id long, lang string, passage string, question string, doc_id string, text string")


def test_p8(spark, dirty, none):
    given = items(
        spark,
        [
            (1, "en", "her plain kettle so the harbor stayed quiet nobody traded", None, "z", "z"),
            (2, "en", "too short", "", "z", "z"),
            (3, None, None, None, None, None),
            (None, "en", LONG, LONG, "z", "z"),
            (4, "ja", "x", "y", "z", "z"),
        ],
    )
    args = ("sample_id", "text", given, "item_id", "lang", ["passage", "question"])
    assert rows(p8_leak.leaks(dirty, *args)) == {(4, 1), (5, 1), (6, 1)}
    assert rows(p8_leak.leaks(none, *args)) == set()
    assert rows(p8_leak.leaks(dirty, "sample_id", "text", items(spark, []), "item_id", "lang", ["passage"])) == set()


def test_p5(spark):
    schema = "seq_id long, input_ids array<int>, seq_lens array<int>, row_id string, length string, rank int, salt int"
    data = [
        (1, None, None, "a", "b", 1, 2),
        (2, [], None, "a", "b", 1, 2),
        (3, list(range(5000)), None, "a", "b", 1, 2),
        (4, [1, 2, 3, 3, 3], [2, 1], "a", "b", 1, 2),
        (4, [1, 2, 3, 3, 3], [2, 1], "a", "b", 1, 2),
        (5, [1, 2], [None, 1, 9], "a", "b", 1, 2),
        (None, [7], [1], "a", "b", 1, 2),
    ]
    out = p5_pack.pack(spark.createDataFrame(data, schema)).collect()
    place = sorted((r["seq_id"] or 0, r["item_no"], r["part_no"], r["start"], r["length"]) for r in out)
    assert place == sorted([(3, 0, 0, 0, 2048), (3, 0, 1, 2048, 2048), (3, 0, 2, 4096, 904), (4, 0, 0, 0, 2), (4, 0, 0, 0, 2), (4, 1, 0, 2, 1), (4, 1, 0, 2, 1), (5, 1, 0, 0, 1), (5, 2, 0, 1, 1), (0, 0, 0, 0, 1)])
    used = {}
    for r in out:
        for k in range(r["row_offset"], r["row_offset"] + r["length"]):
            assert (r["row_id"], k) not in used
            used[r["row_id"], k] = 1
    assert p5_pack.pack(spark.createDataFrame([], schema)).count() == 0


def test_p3(spark, sf):
    schema = "pair_id long, prompt string, chosen string, rejected string, side string, defect string"
    field = p3_defects.train(spark.read.parquet(f"{sf}/preference_samples.parquet"), "pair_id", "prompt", ("chosen", "rejected"))
    why = "Why did the kettle matter so much to Befu?"
    data = [
        (1, why, None, "", "x", "y"),
        (2, why, why, "Nobody painted her", "x", "y"),
        (3, why, "I'm sorry, but I can't help with that.", LONG, "x", "y"),
        (3, why, "I'm sorry, but I can't help with that.", LONG, "x", "y"),
        (4, None, "N/A", "Nobody painted her early letter, so the map stayed blue.", "x", "y"),
        (5, why, "Die Großmutter maß die kalte Kanne, und niemand bemerkte es im Labor.", "Nobody saw it.", "x", "y"),
        (None, why, None, None, "x", "y"),
    ]
    found = p3_defects.found(spark.createDataFrame(data, schema), field=field).collect()
    assert {tuple(r) for r in found} == {(1, "chosen", "empty"), (1, "rejected", "empty"), (2, "chosen", "echo"), (2, "rejected", "truncated"), (3, "chosen", "refusal"), (4, "chosen", "empty"), (5, "chosen", "wrong_language")}
    assert p3_defects.found(spark.createDataFrame([], schema)).count() == 0
