import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparqa.llm import mixing, shared

from .helpers import DOCS, documents, odd_texts, prose, with_odd_columns


def uniform(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    k, term, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u and k < rate + 12 * math.sqrt(rate) + 31:
        k += 1
        term *= rate / k
        total += term
    return k


def brute(rows, weights, epochs, seed):
    """``rows``: (doc_id, source, text)."""
    n = Counter(s or "" for _, s, _ in rows)
    seen = Counter()
    others = sum(c for s, c in n.items() if s not in weights)
    given = sum(w for s, w in weights.items() if s in n)
    out = []
    for doc, s, text in rows:
        s, text = s or "", text or ""
        seen[doc, text, s] += 1
        share = weights[s] / (1 if others else given) if s in weights else (1 - given) * n[s] / others
        count = poisson(epochs * share * len(rows) / n[s], uniform(seed, doc, hashlib.md5(text.encode()).hexdigest(), seen[doc, text, s]))
        out += [(doc, c, count) for c in range(1, count + 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("weights,epochs", [({"src0": 0.5, "src1": 0.1}, 2.0), ({}, 1.0), ({"src0": 0.2, "src1": 0.2, "src2": 0.2}, 5.0), ({"nowhere": 0.4, "src2": 0.0}, 1.0)])
def test_same_counts(spark, weights, epochs):
    docs = with_odd_columns(documents(spark, odd_texts() * 10))
    rows = [(r.doc_id, r.source, r.text) for r in docs.select("doc_id", "source", "text").collect()]
    out = mixing.mix(docs, weights, epochs, 3)
    assert [c for c in docs.columns if c != "copy"] + ["mean_rate", "n_copies", "copy", "order_key"] == out.columns
    got = out.collect()
    assert sorted(((r.doc_id, r.copy, r.n_copies) for r in got), key=repr) == brute(rows, weights, epochs, 3)


def test_shares_and_order(spark):
    docs = documents(spark, [f"t {i}" for i in range(6000)])
    got = mixing.mix(docs, {"src0": 0.6}, 1.5, 1).collect()
    assert abs(len(got) / 9000 - 1) < 0.05
    assert abs(sum(r.source == "src0" for r in got) / len(got) - 0.6) < 0.03
    ids = [r.doc_id for r in got]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.45 < rising < 0.55  # no trace of the input order


def test_null_and_repeated(spark):
    docs = spark.createDataFrame([(None, "a", None), (None, "a", None), (1, None, "s"), (1, None, "s")] * 20, "doc_id long, text string, source string")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = mixing.mix(docs, {"s": 0.25}, 3.0, 9).collect()
    assert sorted(((r.doc_id, r.copy, r.n_copies) for r in got), key=repr) == brute(rows, {"s": 0.25}, 3.0, 9)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_rows_without_ids_are_drawn_one_by_one(spark, monkeypatch, limit):
    """Target shares hold, and the rows spread over the partitions, though all
    rows are the same but for their source."""
    monkeypatch.setattr(shared, "BROADCAST_KEYS", limit)
    docs = spark.createDataFrame([(None, "same", "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs, {"a": 0.7}, 1.0, 4)
    sources = Counter(r.source for r in out.collect())
    assert abs(sources["a"] / sum(sources.values()) - 0.7) < 0.03 and abs(sum(sources.values()) / 4000 - 1) < 0.06
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = [r["count"] for r in mixing.mix(docs, {"a": 0.7}, 1.0, 4).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(parts) > 2 and max(parts) < 0.5 * sum(parts)


def test_numbered(spark):
    rows = [(None, "x")] * 50 + [(1, "x")] * 30 + [(1, None)] * 20 + [(i, "y") for i in range(2, 40)]
    got = shared.numbered(spark.createDataFrame(rows, "a long, b string").repartition(7), ["a", "b"], "no").collect()
    assert sorted(((r.a, r.b, r.no) for r in got), key=repr) == sorted(((a, b, k) for (a, b), n in Counter(rows).items() for k in range(1, n + 1)), key=repr)


def test_many_sources_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    docs = documents(spark, [prose(i, 5) for i in range(50)])
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.copy, r.n_copies) for r in mixing.mix(docs, {"src0": 0.5}, 1.0, 2).collect()), key=repr) == brute(rows, {"src0": 0.5}, 1.0, 2)


def test_empty_and_refused(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS), {"src0": 0.5}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(documents(spark, ["a"]), {"src0": 1.5})
    with pytest.raises(ValueError):
        mixing.mix(documents(spark, ["a"] * 3000), {"src0": 0.5}, epochs=5000.0)
