"""Held-out accuracy of the clause tagger: trained on some rows, judged on sequences made from others."""

from quern.llm import p3_defects
from quern.llm.p3_defects import Context, Field, defect, training_data


def test_held_out_accuracy(spark, sf):
    rows = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/preference_samples.parquet").select("pair_id", "prompt", "chosen", "rejected").orderBy("pair_id").collect()
    pairs = [(r.pair_id, r.prompt, a) for r in rows for a in (r.chosen, r.rejected) if r.prompt and a]
    learn = training_data([(p, a) for i, p, a in pairs if i % 3 == 0])
    judge = training_data([(p, a) for i, p, a in pairs if i % 3], seed=11)
    field = Field.fit(learn)
    right = total = 0
    for x, y in judge:
        right += sum(a == b for a, b in zip(field.tag(x), y))
        total += len(y)
    print(f"held-out tags: {right} of {total} right")
    assert right >= 0.97 * total


def test_traps(spark, sf):
    rows = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/preference_samples.parquet").select("prompt", "chosen", "rejected").orderBy("pair_id").limit(600).collect()
    field = Field.fit(training_data([(r.prompt, a) for r in rows for a in (r.chosen, r.rejected) if r.prompt and a]))
    story = Context.of("Could you tell a short story about Befuzos and a curious ribbon?")
    plain = "Nobody carried her blue curtain on the third floor, so the dataset stayed patient."
    for sound in (
        "I can't recommend the walk there enough. " + plain,
        "Sorry for the slow start, here is the story. " + plain,
        '"I cannot help you," the ferry keeper told them, yet she did. ' + plain,
        plain + " :)",
        plain + '\nKind regards, Ysmund Brennvik',
    ):
        assert defect(field, story, sound) is None, sound
    assert defect(field, Context.of("What is 467 plus 508?"), "975") is None
    assert defect(field, Context.of("Is the list ready? Answer yes or no."), "Yes") is None
    assert defect(field, Context.of("List 3 things to check."), "1. old map\n2. new map\n3. red map") is None
    assert defect(field, Context.of("Translate this sentence into German: Nobody saw it."), "Niemand sah es im Labor.") is None
    assert defect(field, story, "Thank you for asking. I must decline this request. Please ask me something else.") == "refusal"
    assert defect(field, story, "You asked: " + story.prompt) == "echo"
    assert defect(field, story, plain + " We sketched a plain") == "truncated"


def test_lists_that_end_with_a_mark_and_unseen_refusals(spark, sf):
    df = spark.read.parquet(f"{sf}/preference_samples.parquet")
    field = p3_defects.train(df, "pair_id", "prompt", ("chosen", "rejected"))
    prompt = "Explain how Mezuz noticed the unfinished lamp."
    lines = ["The lamp stood by the river all winter.", "Nobody carried it home before the bell."]
    listed = "\n".join(f"{k}. {x}" for k, x in enumerate(lines, 1))
    ctx = p3_defects.Context.of(prompt)
    assert p3_defects.defect(field, ctx, listed) is None
    assert p3_defects.defect(field, ctx, listed + "\n3. ") == "truncated"
    assert p3_defects.defect(field, ctx, " ".join(lines) + " On ...") == "truncated"
    assert p3_defects.defect(field, ctx, "Apologies, Mezuz is not something I will describe.") == "refusal"
    assert p3_defects.clauses("Here:\n```\nrun(x)\n```\nDone.\n```\nrun(x)\n```")[1:] == ["\nrun(x)\n", "Done.", "\nrun(x)\n"]
