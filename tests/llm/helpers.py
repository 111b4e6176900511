"""Fixtures and plain Python versions of the word rules."""

import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ba ce di fo gu le ma no pi ru sa te".split() for b in "bra cle dun fir gol his jam kor lix man".split()]


def lower(text):
    return text.translate(LOWER)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


def documents(spark, texts, more=""):
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    """Null, blank, tiny, odd and very long texts, and repeats of them."""
    long = prose(99, 40_000)
    return [None, "", " \n\t ", "one", "One", "a b", "é😀 日本 ñandú", "word " * 300, long, long, prose(98, 80), None, "x" * 50_000, "\x00\x1f|%$    "]


def with_odd_columns(df):
    """Extra columns whose names clash with added ones, and repeated rows."""
    from pyspark.sql import functions as F

    names = ["n_words", "shard", "slot", "kept", "score", "copy", "n", "key", "a", "cid", "component", "rule", "host", "labels", "spans", "k1"]
    return df.withColumns({c: F.lit("x") for c in names})
