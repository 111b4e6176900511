import math
import random
from collections import Counter

import numpy as np
import pytest
from sparqa.llm import ranked_search

from .helpers import ALNUM, VOCABULARY, documents, lower, odd_texts, prose, with_odd_columns

ITEMS = "item_id long, text string"


def terms(text):
    return ALNUM.findall(lower(text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    every, words = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c, n in counted:
            m = 50 + (50 * n * every) // words
            score = sum(math.floor(1000 * math.log((2 * every + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def asked(spark, docs, items, k):
    out = ranked_search.search(docs, spark.createDataFrame(items, ITEMS), k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def corpus():
    r = random.Random(5)
    texts = odd_texts() + [prose(s, r.choice([3, 30, 200])) for s in range(300)]
    texts += [texts[40]] * 90 + ["Sole sole common", "common"] * 40  # copies and ties beyond k
    return texts


@pytest.mark.parametrize(("leaf", "most", "block"), [(32, 8192, 1 << 20), (2, 25, 150)])
def test_same_ranks_as_brute_force(spark, monkeypatch, leaf, most, block):
    """Also with small leaves and trees and several blocks of items."""
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    monkeypatch.setattr(ranked_search, "TREE_DOCS", most)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    texts = corpus()
    docs = with_odd_columns(documents(spark, texts)).repartition(3)
    items = [(s, prose(2000 + s, 25)) for s in range(12)] + [(20, "SOLE common"), (21, "nowheretobefound"), (22, ""), (23, None), (24, " .,; "),
             (25, "日本 é😀"), (20, "word"), (None, "common bace"), (26, " ".join(VOCABULARY))]
    assert asked(spark, docs, items, 7) == brute(list(enumerate(texts)), items, 7)


def test_missing_ids_and_repeats(spark):
    rows = [(None, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (1, "alpha beta"), (9, "gamma"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "alpha gamma")]
    assert asked(spark, docs, items, 50) == brute(rows, items, 50)
    assert [x[2] for x in sorted(asked(spark, docs, items, 4), key=lambda x: x[1])] == [9, 1, 3, 3]


def test_empty_tables(spark):
    docs = documents(spark, ["a b"])
    assert asked(spark, docs, [], 5) == []
    assert asked(spark, documents(spark, []), [(1, "a")], 5) == []
    assert asked(spark, documents(spark, [None, ""]), [(1, "a")], 5) == []


def test_a_subtree_below_the_kth_score_is_left_out(monkeypatch):
    """Branch and bound asks fewer documents than there are, with equal results."""
    rng = np.random.default_rng(1)
    vectors, m = [], rng.integers(50, 200, 2000)
    for i in range(2000):
        ranks = np.unique(np.minimum(rng.geometric(0.02, 12), 199))
        if i % 100 == 0:
            ranks = np.union1d(ranks, [198, 199])
        vectors.append((ranks, rng.integers(1, 4, len(ranks))))
    tree = ranked_search.Tree(vectors, m, 200)
    assert max(len(c) for c in tree.children) > 1
    seen = []
    real = ranked_search._scores
    monkeypatch.setattr(ranked_search, "_scores", lambda tf, m, w: seen.append(len(tf)) or real(tf, m, w))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    ranks, weights = np.array([3, 198, 199]), np.array([100, 5000, 6000])
    ids = np.arange(2000)
    got = tree.best(ranks, weights, empty, ids, np.zeros(2000, bool), 5)
    dense = np.zeros((2000, 200), np.int64)
    for i, (r, t) in enumerate(vectors):
        dense[i, r] = t
    scores = real(dense[:, ranks], m, weights)
    want = np.lexsort((ids, -scores))[:5]
    assert got[1].tolist() == want.tolist()
    assert got[0].tolist() == scores[want].tolist()
    assert sum(seen[1:]) < 1000
