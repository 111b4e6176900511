import hashlib
import re

import pytest
from sparqa.llm import exact_dedup

from .helpers import DOCS, documents, odd_texts, prose, with_odd_columns

GONE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """{(doc_id, text): [(keep_id, group_size, digest)]} and the number kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(GONE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        out += [(x[3], keep[3], len(members), hashlib.sha256(norm.encode()).hexdigest()) for x in members]
    return sorted(out, key=str), len(groups)


def texts():
    base = [prose(s, 40) for s in range(30)]
    out = odd_texts() + base + [t.replace(" ", "\n\t") for t in base[:20]] + [t.replace(" ", "") for t in base[:10]] + [base[0]] * 400
    return out + ["A b", "a b", "a\xa0b", "a b ", " ab", "\x0b\x0c\r"]


@pytest.mark.parametrize(("parts", "run_rows", "bits"), [(1, 400_000, 4), (13, 20, 1), (9, 7, 2)])
def test_same_groups_as_brute_force(spark, monkeypatch, parts, run_rows, bits):
    """Many runs and several rounds of merging; the longest text, then the smallest id stays."""
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", run_rows)
    monkeypatch.setattr(exact_dedup, "FAN_BITS", bits)
    rows = list(enumerate(texts()))
    docs = with_odd_columns(documents(spark, texts())).repartition(parts)
    got = exact_dedup.exact_duplicates(docs).collect()
    want, groups = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_missing_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "ab"), (7, "a b"), (7, "a b"), (7, "a  b"), (2, "ab"), (None, None), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DOCS)
    got = exact_dedup.exact_duplicates(docs).collect()
    want, groups = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    assert sum(r.kept for r in got) == groups == 3
    assert sorted([(r.doc_id, r.text) for r in exact_dedup.keep_one(docs).collect()], key=str) == sorted([(7, "a  b"), (None, None), (None, "x")], key=str)


def test_empty(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []
    assert exact_dedup.keep_one(documents(spark, [])).collect() == []


def test_equal_digests_are_verified(spark):
    """Rows whose digests agree but whose second hash does not stay apart."""
    rows = spark.createDataFrame([(0, 5, 3, b"d" * 32, 1, 3), (1, 4, 3, b"d" * 32, 2, 3), (2, 6, 9, b"d" * 32, 1, 3)],
                                 "row long, doc_id long, chars long, digest binary, check long, size long")
    got = exact_dedup.best_rows(rows).collect()
    assert sorted((r.check, r.doc_id, r.n) for r in got) == [(1, 6, 2), (2, 4, 1)]
