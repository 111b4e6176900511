import hashlib
from collections import Counter

import pytest

from sparqa.llm import substrings

from .helpers import DOCS, SPACE, documents, edited, odd_texts, prose, with_odd_columns


def brute(rows, window):
    words = [SPACE.findall(t or "") for _, t in rows]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    shared, other = prose(1, 60), prose(2, 36)
    texts = odd_texts()
    texts += [f"{prose(s, 30)} {shared} {prose(s + 1000, 30)}" for s in range(10, 30)]
    texts += [f"{prose(40, 50)} {other} {prose(41, 9)} {other}", other, prose(42, 35), prose(42, 35) + " x", prose(43, 34), prose(43, 34)]
    texts += [edited(prose(44, 400), s, 0.01) for s in range(6)]
    texts += ["la " * 34, "lo " * 36, ("a b c " * 30) + prose(45, 40)]
    return texts


@pytest.mark.parametrize("window", [35, 8, 3])
def test_same_as_all_windows(spark, window):
    docs = with_odd_columns(documents(spark, corpus())).repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substrings.remove_repeats(docs, window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, window)


def test_kept_text(spark):
    s = prose(1, 40)
    docs = documents(spark, [f"head {s} tail", f"{s}  end", "alone"])
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(docs).collect()}
    assert got == {0: "head tail", 1: "end", 2: None}


def test_null_and_repeated_ids(spark):
    rows = [(None, prose(1, 50)), (None, prose(1, 50)), (3, prose(2, 50)), (3, prose(3, 50) + " " + prose(4, 40)), (3, prose(4, 40)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 35)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
