"""Driver contract: entry() and a sample of registered queries on sf0.001."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["query_id", "rank", "score", "doc_id", "chunk_idx", "chunk_text"]


def test_every_query_has_sql():
    from sparqa.plans.registry import QUERIES

    assert set(QUERIES) <= set(E.queries())
    # SQL has no byte-pair encoder: tests/test_generation_store.py compares with the libraries
    assert set(QUERIES) - {"pack_token_blocks_bpe"} <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["chunk_text", "dedup_sentences", "events_summary", "pack_token_blocks"])
def test_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0
