"""The TF-IDF index and scores against a direct numpy
computation of the vectoriser rules."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sparqa.config import DEFAULT
from sparqa.functions.stopwords import ENGLISH_STOP_WORDS
from sparqa.operators import retrieval as R
from sparqa.operators.index import fit_index, transform_queries

STOP = set(ENGLISH_STOP_WORDS)


def toks(t):
    return [w for w in re.findall(r"[^\W]{2,}", t.lower()) if w not in STOP]


def direct(docs, queries, max_features):
    tfs = [Counter(toks(d)) for d in docs]
    total = Counter()
    for c in tfs:
        total.update(c)
    vocab = sorted(total, key=lambda w: (-total[w], w))[:max_features]
    n = len(docs)
    df = {w: sum(1 for c in tfs if w in c) for w in vocab}
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocab}

    def vec(c):
        v = {w: c[w] * idf[w] for w in vocab if w in c}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    dv = [vec(c) for c in tfs]
    out = {}
    for qi, q in enumerate(queries):
        qv = vec(Counter(toks(" ".join(q.split()).lower())))
        for di, d in enumerate(dv):
            s = sum(qv[w] * d.get(w, 0.0) for w in qv)
            if s > 0:
                out[(qi, di)] = round(s, 6)
    return out


DOCS = [
    "The quick brown fox jumps over the lazy dog.",
    "Spark runs distributed joins; joins shuffle data.",
    "Dogs and foxes are animals. Animals eat food.",
    "Café crème, naïve résumé: Unicode words count too.",
    "",
    "the and of",  # only stop words
    "Distributed data processing with Spark and Python python PYTHON.",
]
QUERIES = ["What do foxes eat?", "  distributed   SPARK joins ", "unicode café", "nothing matches here zzz"]


def test_scores_match_direct(spark):
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(DOCS)],
                                   "doc_id long, chunk_idx long, chunk_text string")
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, question string")
    for mf in (5000, 6):
        idx = fit_index(chunks, ["doc_id", "chunk_idx"], max_features=mf)
        qp = transform_queries(idx, qs)
        got = {(r.query_id, r.doc_id): r.score
               for r in R.cosine_scores(qp, idx.postings, ["doc_id", "chunk_idx"]).collect() if r.score > 0}
        want = direct(DOCS, QUERIES, mf)
        assert got.keys() == want.keys()
        for k in want:
            assert abs(got[k] - want[k]) <= 1e-6


def test_vocab_counts_all_chunks(spark):
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(DOCS)],
                                   "doc_id long, chunk_idx long, chunk_text string")
    v = fit_index(chunks, ["doc_id", "chunk_idx"]).vocab
    assert {r.n_docs for r in v.collect()} == {len(DOCS)}


def test_top_k_ties_and_threshold(spark):
    scores = spark.createDataFrame(
        [(1, 1, 0, 0.5), (1, 2, 0, 0.5), (1, 3, 0, 0.9), (1, 4, 0, 0.1), (2, 1, 0, 0.3)],
        "query_id long, doc_id long, chunk_idx long, score double")
    top = R.top_k_per_query(scores, ["doc_id", "chunk_idx"], 2, 0.2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in top] == [(1, 3, 1), (1, 2, 2), (2, 1, 1)]


def test_salted_join_equals_broadcast(spark):
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(DOCS)],
                                   "doc_id long, chunk_idx long, chunk_text string")
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, question string")
    idx = fit_index(chunks, ["doc_id", "chunk_idx"])
    qp = transform_queries(idx, qs)
    a = R.cosine_scores(qp, idx.postings, ["doc_id", "chunk_idx"], DEFAULT, small_queries=True)
    b = R.cosine_scores(qp, idx.postings, ["doc_id", "chunk_idx"], DEFAULT, small_queries=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_weights_are_computed_chunk_by_chunk(spark):
    """Neither a sort nor a shuffle of one row per (chunk, term)."""
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(DOCS)], "doc_id long, chunk_idx long, chunk_text string")
    plan = fit_index(chunks, ["doc_id", "chunk_idx"]).postings._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan


def test_chunks_that_share_a_key_count_as_one(spark):
    schema = "doc_id long, chunk_idx long, chunk_text string"
    pieces = [(0, 0, "apple pear"), (0, 0, "apple plum the"), (None, 0, "pear fig"), (None, 0, "fig"), (2, 0, None), (2, 0, "the"), (3, 0, "plum")]
    whole = [(0, 0, "apple pear apple plum the"), (None, 0, "pear fig fig"), (2, 0, "the"), (3, 0, "plum")]
    found = [fit_index(spark.createDataFrame(rows, schema), ["doc_id", "chunk_idx"], materialize=m) for rows, m in ((pieces, False), (whole, True))]
    for part in ("vocab", "postings"):
        a, b = (sorted((str(r.asDict()) for r in getattr(f, part).collect())) for f in found)
        assert a == b and a
    assert {r.n_docs for r in found[0].vocab.collect()} == {4}


def test_built_indexes_are_scored_chunk_by_chunk(spark, monkeypatch):
    """A built index is stored with one row a chunk: no sort, and the scoring
    reads it without gathering, exchanging or sorting postings."""
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(DOCS)], "doc_id long, chunk_idx long, chunk_text string")
    qs = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, question string")
    key = ["doc_id", "chunk_idx"]
    built, plain = (fit_index(chunks, key, materialize=m) for m in (True, False))
    assert built.vectors.count() == len(DOCS)
    monkeypatch.setattr(R, "LEAST_TASKS", 1)
    found = []
    for index in (built, plain):
        scores = R.cosine_scores(transform_queries(index, qs), index.postings, key, index=index)
        found.append((sorted(map(tuple, scores.collect())), scores._jdf.queryExecution().executedPlan().toString()))
    assert found[0][0] == found[1][0] and found[0][0]
    assert "Aggregate" not in found[0][1] and "Join" not in found[0][1] and "hashpartitioning" not in found[0][1]
    some = [built.words[0], built.words[-1], "unknown"]
    want = sorted(map(str, plain.postings.where(plain.postings.term.isin(some)).collect()))
    assert want and sorted(map(str, built.holding(some, []).collect())) == want and built.holding(["unknown"], []).count() == 0
