from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparqa.llm import quality_rules as Q

from .helpers import DOCS, SPACE, documents, odd_texts, prose, with_odd_columns
from .test_quality_model import junk


def counts(text):
    text = text or ""
    w = SPACE.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def estimate(x):
    cov = np.cov(x.T, bias=True) + np.diag(np.square(Q.FLOOR))
    return x.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def d2(x, e):
    z = x - e[0]
    return np.einsum("ij,jk,ik->i", z, e[1], z)


def smallest_determinant(x, starts=200, seed=0):
    """Minimum covariance determinant from many random starts, each iterated."""
    rng = np.random.default_rng(seed)
    h = int(np.ceil(Q.SUPPORT * len(x)))
    best = None
    for _ in range(starts):
        e = estimate(x[rng.choice(len(x), 6, replace=False)])
        for _ in range(30):
            after = estimate(x[np.argsort(d2(x, e), kind="stable")[:h]])
            done = after[2] > e[2] - 1e-9
            e = after
            if done:
                break
        if best is None or e[2] < best[2]:
            best = e
    return best


def as_rows(spark, x):
    rows = [("en", "a", False, i * 7919 % 1_000_003, *r) for i, r in enumerate(np.round(x * Q.SCALE).astype(int).tolist())]
    return spark.createDataFrame(rows, "lang string, source string, base_failed boolean, draw long, " + ", ".join(f"{f} long" for f in Q.FEATURES))


@pytest.mark.parametrize(("share", "shift"), [(0.05, 8), (0.15, 8), (0.2, 8), (0.2, 4), (0.24, 8)])
def test_tight_clusters_do_not_mask_themselves(spark, share, shift):
    """Against an independent estimate from 200 starts: the planted cluster is
    caught, and the determinant is as small."""
    rng = np.random.default_rng(int(100 * share) + shift)
    x = rng.normal(size=(2000, 5))
    bad = int(2000 * share)
    x[:bad] = shift + 0.1 * rng.normal(size=(bad, 5))
    got = sorted(Q.robust_distances(as_rows(spark, x)).collect(), key=lambda r: r.draw * 1)
    by_draw = {r.draw: r.d2 for r in got}
    d = np.array([by_draw[i * 7919 % 1_000_003] for i in range(2000)])
    assert (d[:bad] > Q.CUTOFF).all() and (d[bad:] > Q.CUTOFF).mean() < 0.02
    best = smallest_determinant(np.round(x * Q.SCALE) / Q.SCALE)
    fit = as_rows(spark, x).withColumns({"glang": F.lit("en"), "grp": F.lit("=a")})
    assert Q.minimum_determinant(fit, ["glang", "grp"]).first().logdet <= best[2] + 0.02


def test_a_step_takes_exactly_h_rows(spark):
    """The part of the last bin that is needed counts."""
    x = np.round(np.random.default_rng(3).normal(size=(403, 5)) * Q.SCALE) / Q.SCALE
    by = ["lang", "source"]
    rows = as_rows(spark, x)
    first = Q._estimate(Q._moments(rows, by), by)
    after = Q._step(rows, first, by).first()
    distance = d2(x, estimate(x))
    bins = np.floor(16 * np.log2(distance + 1e-6))
    h = int(np.ceil(Q.SUPPORT * 403))
    last = np.sort(bins)[h - 1]
    weight = np.where(bins < last, 1.0, np.where(bins == last, (h - (bins < last).sum()) / (bins == last).sum(), 0.0))
    assert weight.sum() == pytest.approx(h)
    mean = np.average(x, axis=0, weights=weight)
    assert [after[f"m{i}"] for i in range(5)] == pytest.approx(mean.tolist(), abs=1e-9)
    cov = np.cov(x.T, aweights=weight, bias=True) + np.diag(np.square(Q.FLOOR))
    assert after.logdet == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-6)


@pytest.fixture(scope="module")
def corpus():
    texts = odd_texts() + [prose(s, 60 + s % 200) for s in range(400)] + [junk(s) for s in range(30)]
    texts += ["la la la " * 40, "same line here\n" * 30, prose(7, 30) + "\n" + prose(7, 30) + "\n \n\n" + prose(8, 40), "a b c " + prose(9, 60) + " a b c a b c"]
    return texts


def test_counts_and_distances(spark, corpus):
    docs = with_odd_columns(documents(spark, corpus)).repartition(3)
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    rows, order = [], sorted(got)
    for i in order:
        r = got[i]
        n = counts(corpus[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, i
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        words = max(n[0], 1)
        x = [np.log1p(n[0]), np.log((n[1] + 1) / words)] + [np.log1p(100.0 * c / words) for c in n[2:]]
        rows.append((f"src{i % 3}", np.round(np.array(x) * Q.SCALE) / Q.SCALE, r.base_failed))
    for source in ("src0", "src1", "src2"):
        x = np.array([f for s, f, failed in rows if s == source and not failed])
        best = smallest_determinant(x)
        for i, (s, f, failed) in zip(order, rows, strict=True):
            if s == source:
                assert got[i].kept == (not failed and got[i].distance <= Q.CUTOFF)
                far = d2(f[None], best)[0]
                assert failed or abs(far - Q.CUTOFF) < 0.25 * Q.CUTOFF or (far <= Q.CUTOFF) == got[i].kept, (i, far, got[i].distance)
    first, last = len(odd_texts()), len(odd_texts()) + 400
    assert all(got[i].kept for i in range(first, last))
    assert not any(got[i].kept for i in range(last, last + 30))
    good = Q.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i in got if got[i].kept}


def test_small_and_null_groups(spark, corpus):
    rows = [(i, t, None if i % 2 else "de", None) for i, t in enumerate(corpus[:60])] + [(None, None, "xx", "y"), (3, prose(1, 70), "en", "few")]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert all(r.kept in (True, False) for r in got)
    assert next(r for r in got if r.doc_id is None).kept is False


def test_many_groups_are_joined(spark, corpus, monkeypatch):
    docs = documents(spark, corpus)
    want = {r.doc_id: r.distance for r in Q.judge(docs).collect()}
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert {r.doc_id: r.distance for r in Q.judge(docs).collect()} == want


def test_outliers_that_pass_the_plain_rules(spark):
    lines = [f"{prose(1, 12)}\n" * 2 + prose(s, 90) + "".join(f"\n{w}" * 4 for w in prose(s + 1, 6).split()) for s in range(5)]
    repeats = [f"{prose(s, 25)} x {prose(s, 25)} {prose(s + 1, 70)}" for s in range(5)]
    symbols = [prose(s, 100) + " |" * 10 for s in range(5)]
    planted = lines + repeats + symbols
    texts = planted + [prose(s, 60 + s % 200) for s in range(1000, 1300)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1000 + i, t, "few", "a") for i, t in enumerate(planted)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, DOCS.replace(", n_chars long", ""))).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept or got[1000 + i].kept for i in range(len(planted)))
    assert all(got[i].kept for i in range(len(planted), len(texts)))


def test_cutoff_of_normal_rows(spark):
    x = np.round(np.random.default_rng(1).normal(size=(20_000, 5)) * Q.SCALE * 2).astype(int).tolist()
    rows = spark.createDataFrame([("en", "a", False, i, *r) for i, r in enumerate(x)], "lang string, source string, base_failed boolean, draw long, " + ", ".join(f"{f} long" for f in Q.FEATURES))
    assert 0.0003 < Q.robust_distances(rows).where(f"d2 > {Q.CUTOFF}").count() / 20_000 < 0.003


def test_empty(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert Q.judge(docs).count() == 0
    assert Q.keep_good(docs).columns == docs.columns
