"""Scalar text functions on literal rows."""

from pyspark.sql import functions as F

from sparqa.config import DEFAULT
from sparqa.functions import text as T


def one(spark, expr, value, value2=None):
    df = spark.createDataFrame([(value, value2)], "a string, b string")
    return df.select(expr).first()[0]


def test_preprocess_text(spark):
    assert one(spark, T.preprocess_text("a"), "  Hello   World  ") == "Hello World"
    assert one(spark, T.preprocess_text("a"), "Hello\n\n\nWorld\t\tTest") == "Hello World Test"
    # Unicode whitespace counts as whitespace
    assert one(spark, T.preprocess_text("a"), " x　 y\u0085") == "x y"
    assert one(spark, T.normalize_query("a"), "  What IS\tPython? ") == "what is python?"


def test_parse_list_items(spark):
    f = T.join_list_items(T.parse_list_items("a"), "format")
    assert one(spark, f, '["first", " second ", ""]') == "first\nsecond"
    assert one(spark, f, "['single', 'quoted']") == "single\nquoted"
    assert one(spark, f, '["a"] and ["b"]') is None
    assert one(spark, f, "plain text") is None
    llm = T.join_list_items(T.parse_list_items("a"), "llm")
    assert one(spark, llm, '["x", null, true, 3]') == "x\nNone\nTrue\n3"


def test_clean_context(spark):
    c = T.clean_context("a")
    assert one(spark, c, '["one", "", "two"]') == "one\ntwo"
    assert one(spark, c, "[not a list") == "[not a list"
    assert one(spark, c, "[broken, list]]") == "broken, list"
    assert one(spark, c, "  spaced \n\n out ") == "spaced out"


def test_clean_generated(spark):
    c = T.clean_generated("a")
    assert one(spark, c, "Context 1: Python is great") == "Python is great"
    assert one(spark, c, "Answer: yes\nQuestion: why\nsome Answer: kept") == "yes\nwhy\nsome Answer: kept"
    assert one(spark, c, '["a", "b"]') == "a\nb"
    assert one(spark, c, "x\n\n\n\ny") == "x\n\ny"


def test_strip_prompt_prefix(spark):
    p = DEFAULT.prompt_prefix
    f = T.strip_prompt_prefix("a", "b")
    assert one(spark, f, f"  {p}\n: What is X?\n The answer.", "what is x?") == "The answer."
    assert one(spark, f, f"{p} Other text", "what is x?") == "Other text"
    assert one(spark, f, "  no prefix here", "q") == "no prefix here"


def test_response_preview(spark):
    f = T.response_preview("a")
    assert one(spark, f, "x" * 100) == "x" * 100
    assert one(spark, f, "y" * 101) == "y" * 100 + "..."


def test_typed_list_items(spark):
    context, fmt = T.clean_context("a"), T.join_list_items(T.parse_list_items(F.col("a")), "format")
    assert one(spark, context, '["null","0","a"]') == "null\n0\na"
    assert one(spark, context, '["true", "false", "None", "", null, false, 0, 0.0, [], {}, 1]') == "true\nfalse\nNone\n1"
    assert one(spark, fmt, '["true", true, null, 0, ""]') == "true\nTrue\nNone\n0"
    assert one(spark, fmt, "['a', None, True, \"it's\", 'say \"x\"', 2]") == "a\nNone\nTrue\nit's\nsay \"x\"\n2"
    assert one(spark, context, "['a', None, True, False, '0']") == "a\nTrue\n0"
    for broken in ("['a', true]", '["a", broken]', '["a"] and ["b"]', "[1, 2", "['a', null]"):
        assert one(spark, fmt, broken) is None


def test_literals_against_python(spark):
    """Generated literals, well-formed and broken, nested and escaped, in JSON
    and Python spelling, against the json and ast modules."""
    import ast
    import json
    import random

    r = random.Random(9)

    def value(depth):
        pick = r.randrange(12 if depth else 8)
        if pick < 4:
            return "".join(r.choice("ab' \"\\\n\té,[]{}:#") for _ in range(r.randrange(6)))
        if pick < 8:
            return r.choice([0, 1, -2.5, 1e20, True, False, None, 0.0, 10**25])
        inner = [value(depth - 1) for _ in range(r.randrange(4))]
        return inner if pick < 10 else tuple(inner) if pick == 10 else {f"k{i}": x for i, x in enumerate(inner)}

    texts = []
    for _ in range(300):
        v = [value(2) for _ in range(r.randrange(5))]
        t = r.choice([repr, lambda x: json.dumps(x, ensure_ascii=r.random() < 0.5)])(v)
        if r.random() < 0.2:
            t = t[:-1] + ",]"
        if r.random() < 0.2:
            at = r.randrange(len(t))
            t = t[:at] + r.choice("x'\",]") + t[at + 1:]
        texts.append(t)
    texts += ["['a' 'b', (1,), b'x', 1+2j, {1, 2}, ...]", "[1, [2, (3, 'x'),],]", "[NaN, Infinity]", "[" * 5000 + "]" * 5000, "[]", "[not]", "['a'] + ['b']", "('a',)", None]

    def want(t):
        if t is None or not (t.startswith("[") and t.endswith("]")):
            return None
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(t)
                return [str(x) for x in got] if isinstance(got, list) else None
            except Exception:  # noqa: BLE001
                continue
        return None

    df = spark.createDataFrame(list(enumerate(texts)), "i long, a string").repartition(3)
    got = {x.i: x.items for x in df.select("i", T.parse_list_items("a").alias("items")).collect()}
    for i, t in enumerate(texts):
        assert (None if got[i] is None else [x.text for x in got[i]]) == want(t), t
    assert sum(v is not None for v in got.values()) > 200
    context = T.clean_context("a")
    assert one(spark, context, '["x", {"k": "v"}, ["n", 1], (), 0.0]') == "x\n{'k': 'v'}\n['n', 1]"
    assert one(spark, context, "['x', {'k': 'v'}, ('n', 1), (), 0.0]") == "x\n{'k': 'v'}\n('n', 1)"


def test_list_fixtures_are_lists(spark):
    import os

    import pytest

    from sparqa.plans import fixtures

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("test data not present")
    texts = fixtures.list_texts(spark, "/root/testdata/sf0.001")
    parsed = texts.where(T.parse_list_items(F.col("text")).isNotNull()).count()
    assert 0 < parsed < texts.count() and parsed > texts.count() / 4


def test_trimmed_characters_are_the_whitespace_class():
    import re

    ranges = re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", T.WS_CLASS)
    assert {chr(i) for a, b in ranges for i in range(int(a, 16), int(b or a, 16) + 1)} == set(T.WS_CHARS)
