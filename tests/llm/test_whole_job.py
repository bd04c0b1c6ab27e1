"""Cases beyond the given tables: the operators do the whole job there, too."""

from pyspark.sql import functions as F

from quern.llm import p2_groups, p3_defects, p4_overlap, p6_collapse


def every(units, step, new):
    return [new(i) if i % step == step - 1 else u for i, u in enumerate(units)]


def test_overlap_of_spread_edits(spark):
    words = [f"word{i}" for i in range(100)]
    letters = [chr(0x4E00 + 7 * i) for i in range(100)]
    hits = [every(words, k, lambda i: f"other{k}x{i}") for k in (5, 6, 7)]
    hits_ja = [every(letters, k, lambda i: chr(0x8000 + 3 * i)) for k in (5, 10)]
    shifted = ["front"] * 10 + words[:90]  # ten words inserted, ten lost
    miss = every(words, 4, lambda i: f"away{i}")
    less = [*every(words, 5, lambda i: f"less{i}")[:-2], "less98", "less99"]
    held = [" ".join(x) for x in (*hits, shifted, miss, less)] + ["".join(x) for x in hits_ja]
    rows = [(1, "train", " ".join(words)), (2, "train", "".join(letters))] + [(10 + i, "valid", t) for i, t in enumerate(held)]
    got = {tuple(r) for r in p4_overlap.found(spark.createDataFrame(rows, "sample_id long, split_name string, text string")).collect()}
    assert got == {(1, 10), (1, 11), (1, 12), (1, 13), (2, 16), (2, 17)}


def test_records_written_with_escapes(spark):
    texts = [
        r'{"name": "caf\u00e9 \uac00", "note": "one\ntwo", "left": null}',
        "note: one two\nname: Café 가\nleft:",
        '{"left": null, "note": "one two", "name": "café 가"}',
        r"{name: caf\u00e9 \uac00, note: one\ntwo, left: null}",  # the letters of the first, but no record
        "note: one two\nname: Cafe 가\nleft:",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    assert {tuple(r) for r in p6_collapse.found(df).collect()} == {(0, 1), (0, 2), (0, 3)}


def test_language_asked_for_in_the_middle():
    context = "The letter below was found by the harbor master and he wants to read it to the crew. " * 2
    passage = " The boats were late and the crew sat on the pier with their tea, and nobody spoke. " * 3
    assert p3_defects.expected(context + "Please translate it into German for the crew:" + passage) == "de"
    assert p3_defects.expected(context + passage) == "en"


def test_long_labelled_lines_name():
    url = "https://www.kite-forum.example/post/7?" + "&".join(f"part{i}=value{i}" for i in range(40))
    names = [(k, p2_groups.normal(k, v)) for k, v, _ in p2_groups.names_in_text(f"Source: {url}\nAuthor: Ana Maria de la Cruz Ruiz\nTopic: one two three four five six seven eight nine")]
    assert names == [("source", "kiteforum/post7"), ("author", "anamariadelacruzruiz"), ("entity", "onetwothreefourfivesixseveneightnine")]


def test_records_joined_by_one_sequence(spark):
    """Two records of different fields have the same letters; what equals either belongs to one class."""
    texts = ['{"ab": "c", "d": "e"}', '{"a": "bc", "d": "e"}', "d: e\na: bc", "d: e\nab: c", "d: e\na: bx"]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id long, text string")
    assert {tuple(r) for r in p6_collapse.found(df).collect()} == {(0, 1), (0, 2), (0, 3)}


def test_report_counts_the_pairs_found(spark, sf):
    """Counts by classes against the pairs written out, on the given table and on hot classes."""
    given = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/text_samples.parquet")
    text = "one two three four five six seven eight nine ten"
    made = [(i, ("train", "valid", "test")[i % 3], "s", text if i % 2 else text.upper() + "!") for i in range(60)]
    made += [(100, "train", "s", text + " eleven"), (101, "valid", "t", "one two three four five six seven eight nine"), (102, "train", "t", '{"a": "b"}'), (103, "test", "t", "a: b"), (104, "test", "t", "alone")]
    hot = spark.createDataFrame(made, "sample_id long, split_name string, source_name string, text string")
    for df in (given, hot):
        pairs = p4_overlap.overlaps(df)
        of = df.select(F.col("sample_id").alias("eval_id"), "split_name", "source_name")
        want = pairs.join(of, "eval_id").groupBy("split_name", "source_name").agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("records"))
        assert {tuple(r) for r in p4_overlap.report(df).collect()} == {tuple(r) for r in want.collect()}
