"""B9, B10 on literal messy answers."""

from sparqa.config import DEFAULT
from sparqa.operators import cleaning
from sparqa.operators.cleaning import dedup_sentences, format_answers


def dedup(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r.text for r in dedup_sentences(df).collect()}


def test_dedup_sentences(spark):
    got = dedup(spark, [
        "A. B. A. C",
        "First line. Second.\nfirst LINE.\nThird",
        "* item one. item two.\n- item one.\n+ new",
        "```\ncode. code.\n```\ncode. text",
        "",
        "  indented. indented.",
        "Ends with fence\n```",
    ])
    assert got[0] == "A. B. C."
    assert got[1] == "First line. Second.\nThird."
    assert got[2] == "* item one. item two.\n+ new."
    assert got[3] == "```\ncode. code.\n```\ncode. text."
    assert got[4] == ""
    assert got[5] == "indented."
    assert got[6] == "Ends with fence\n```"


def test_format_answers(spark):
    p = DEFAULT.prompt_prefix
    df = spark.createDataFrame([
        (1, f"{p}\nWhat is X?\nX is a thing. X is a thing.", "What is X?"),
        (2, '["one", "", "two"]', "q"),
        (3, "Context 1: fact one.\nAnswer: fact two", "q"),
        (4, None, "q"),
    ], "id long, raw string, question string")
    got = {r.id: r.response for r in format_answers(df, "id", "raw", "question").collect()}
    assert got[1] == "X is a thing."
    assert got[2] == "one\ntwo"
    assert got[3] == "fact one.\nfact two."
    assert got[4] == ""


MESSY = [
    "", None, " \n\t", "```", "```\na. a.\n```", "x.\n```\nx.\n\n```\nx. y?\n ``` z\nq. q.\n```",
    "- A. B\n  * a. c.  C.\n+ \n\n\n-b\n\u2003lead. Lead.  lead !", "one.\r\nONE.\x85two! two!\u2028 three", "a. b.\n" * 50, "....", "- x. - x.",
]


def test_a_text_is_deduplicated_in_its_row(spark):
    """No shuffle, and the same as by rows of lines and sentences."""
    df = spark.createDataFrame(list(enumerate(MESSY)), "id long, text string").repartition(8)
    out = dedup_sentences(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    want = {r.id: r.text for r in cleaning._dedup_together(df, "id", "text", "text").collect()}
    assert {r.id: r.text for r in out.collect()} == want


def test_repeated_and_missing_ids(spark):
    """Texts of one id count as one; a row without an id has an empty text."""
    rows = [(1, "A. B."), (1, "b. C."), (2, "A. a."), (None, "x. x."), (None, "y.")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(map(str, [(r.id, r.text) for r in dedup_sentences(df).collect()]))
    assert len(got) == 5 and got.count("(None, '')") == 2 and "(2, 'A.')" in got
    (one,) = {x for x in got if x.startswith("(1")}
    assert got.count(one) == 2 and "C." in one
    answers = format_answers(df.withColumn("q", df.text), "id", "text", None)
    assert answers.count() == 1 + 4 + 2
    assert [r.response for r in answers.where("id is null").collect()] == [None, None]


def test_a_long_text_takes_linear_time(spark):
    """Many lines, each said several times, by an Arrow function: a text of
    some megabytes is done in the time that its sentences take."""
    import time

    lines = [f"Line {i} says this. Line {i} says that! And line {i % 50} again?" for i in range(30_000)]
    text = "\n".join(["```", *lines[:3], "```", *lines, *lines, *(f"- {x}" for x in lines)])
    df = spark.createDataFrame([(1, text), (2, None), (3, "a.\tb.  a. c!\u00a0C! d? e  e? E e? D?")], "id long, text string")
    out = dedup_sentences(df)
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    begun = time.time()
    got = {r.id: r.text for r in out.collect()}
    assert time.time() - begun < 30
    first = [f"Line {i} says this. Line {i} says that!" + (f" And line {i} again?" if i < 50 else "") for i in range(30_000)]
    assert got == {1: "\n".join(["```", *lines[:3], "```", *first]), 2: "", 3: "a. b. c! d? e  e?"}
