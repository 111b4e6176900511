import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparqa.llm import decontamination

from .helpers import ALNUM, DOCS, documents, lower, odd_texts, prose, with_odd_columns


def brute(rows, items, window):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        for i in range(max(len(w) - window + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def case(spark):
    items = [(i, prose(i, 30)) for i in range(20)] + [(20, "One"), (21, "two words"), (22, ""), (None, prose(50, 12)), (23, None), (11, prose(3, 30)), (24, "la " * 12)]
    texts = odd_texts()
    texts += [f"{prose(100 + i, 20)}. {prose(i, 30).upper()} {prose(200 + i, 20)}" for i in range(5)]
    texts += [" ".join(prose(7, 30).split()[3:13]), " ".join(prose(7, 30).split()[3:12]), "two, WORDS two words", "la " * 50, prose(50, 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return with_odd_columns(documents(spark, texts)).repartition(3), bench, items


@pytest.mark.parametrize("window", [10, 2])
@pytest.mark.parametrize("pass_bytes", [32 << 20, 700])
def test_same_as_all_windows(spark, monkeypatch, window, pass_bytes):
    monkeypatch.setattr(decontamination, "PASS_BYTES", pass_bytes)  # several passes give the same
    docs, bench, items = case(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = decontamination.decontaminate(docs, bench, window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == brute(rows, items, window)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = ["alpha beta gamma", " ".join(reversed(item.split())), "alpha " + prose(1, 60) + " beta " + prose(2, 60) + " gamma"] + [item.split()[i] for i in range(3, 10)] * 3
    got = {r.doc_id: r for r in decontamination.decontaminate(documents(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[0].near_items == ["1"] and got[1].near_items == ["1"] and got[2].near_items == []
    assert not got[1].contaminated


def brute_near(rows, items, window):
    docs = [(doc, ALNUM.findall(lower(text or ""))) for doc, text in rows]
    seen = Counter(x for _, w in docs for x in w)
    out = {doc: set() for doc, _ in docs}
    for item, text in items:
        t = ALNUM.findall(lower(text or ""))
        for i in range(max(len(t) - window + 1, min(len(t), 1))):
            x = t[i:i + window]
            terms = list(dict.fromkeys(sorted(x, key=lambda y: seen[y])))[:3]
            often = {y: 1 if len(terms) == 3 else x.count(y) for y in terms}
            for doc, w in docs:
                for p in (p for p, y in enumerate(w) if y == terms[0]):
                    around = w[max(0, p - decontamination.NEAR * window): p + decontamination.NEAR * window + 1]
                    if all(around.count(y) >= c for y, c in often.items()):
                        out[doc].add("" if item is None else str(item))
    return out


def test_proximity_of_all_windows(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, prose(i, 19)) for i in range(8)] + [(20, "One"), (21, "two words"), (22, ""), (None, prose(50, 12)), (24, "la " * 12)]
    tails = [" ".join(r.sample(t.split()[9:], 10)) for _, t in items[:8]]
    texts = [None, "", "one", "words in between two", "la " * 9, "la " * 11, prose(60, 300)] + [f"{prose(300 + i, 30)} {t} {prose(400 + i, 30)}" for i, t in enumerate(tails)]
    want = brute_near(list(enumerate(texts)), items, 10)
    assert all(str(i) in want[7 + i] for i in range(8))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for candidates in (1 << 19, 5):
        monkeypatch.setattr(decontamination, "CANDIDATES", candidates)
        got = decontamination.decontaminate(documents(spark, texts), bench).collect()
        assert {x.doc_id: set(x.near_items) for x in got} == want
        assert all(x.n_near == len(want[x.doc_id]) and x.near_sha256 == hashlib.sha256(",".join(sorted(want[x.doc_id])).encode()).hexdigest() for x in got)


def test_a_pass_is_bounded(spark):
    """What is broadcast stays within ARRAYS times the block's text."""
    items = [(i, prose(i, 150)) for i in range(400)]
    w = decontamination.Windows(items, 10)
    vocabulary = w.vocabulary
    w.rank(vocabulary, np.arange(len(vocabulary)))
    held = sum(x.nbytes for x in vars(w).values() if isinstance(x, np.ndarray))
    assert held < decontamination.ARRAYS * sum(len(t) for _, t in items)


def test_empty(spark):
    docs, bench, _ = case(spark)
    assert decontamination.decontaminate(spark.createDataFrame([], DOCS), bench).count() == 0
    got = decontamination.decontaminate(docs, bench.limit(0)).collect()
    assert len(got) == docs.count() and not any(r.contaminated or r.n_items for r in got)
