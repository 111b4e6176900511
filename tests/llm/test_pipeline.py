"""The pipeline stage by stage against the plain versions of its operators."""

import pytest

import corpus_pipeline as P
from sparqa.llm import mixing, quality_rules
from sparqa.llm.queries import MIX_SEED, MIX_WEIGHTS, QUERIES, SHARDS

from . import test_decontamination, test_mixing, test_near_dedup
from .helpers import DOCS, documents, edited, odd_texts, prose
from .test_quality_model import junk


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    items = [(i, prose(9_000 + i, 30)) for i in range(10)]
    texts = odd_texts() + [prose(s, 70 + s % 60) for s in range(150)] + [edited(prose(s, 70 + s % 60), s, 0.004) for s in range(40)]
    texts += [junk(s) for s in range(15)] + [prose(700 + i, 60) + " " + prose(9_000 + i, 30) for i in range(10)] + [prose(1, 71)] * 20
    documents(spark, texts).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [len(s) for s in P.STAGES] == [2] * 5

    def step(k, docs):
        out = P.STAGES[k][1](spark, docs, sf_dir)
        assert k == 4 or out.columns == docs.columns
        return out.cache()

    def pairs(df):
        return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    good = step(0, docs)
    want = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert {i for i, _ in pairs(good)} == want and len(want) > 150
    one = step(1, good)
    brute = test_near_dedup.brute(pairs(good), 5)
    assert [i for i, _ in pairs(one)] == sorted({c for _, c in brute.values()})
    clean = step(2, one)
    leaks = {r[0] for r in test_decontamination.brute(pairs(one), items, 10) if r[-1]}
    assert len(leaks) >= 5 and [i for i, _ in pairs(clean)] == [i for i, _ in pairs(one) if i not in leaks]
    mixed = step(3, clean)
    rows = [(r.doc_id, r.source, r.text) for r in clean.collect()]
    assert [i for i, _ in pairs(mixed)] == sorted(i for i, _, _ in test_mixing.brute(rows, MIX_WEIGHTS, 1.0, MIX_SEED))
    sharded = step(4, mixed).collect()
    assert sorted(r.doc_id for r in sharded) == [i for i, _ in pairs(mixed)]
    assert max(r.shard for r in sharded) < SHARDS


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 50


def test_empty_tables(spark, sf_dir, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert mixing.HASH_BITS == 52
