import zlib
from collections import Counter

import pytest

from sparqa.llm import queries, sharding

from .helpers import DOCS, documents, odd_texts, prose, with_odd_columns


@pytest.mark.parametrize("shards,bucket_bytes", [(40, 16 << 20), (7, 4000), (3, 1 << 30)])
def test_rows_law(spark, shards, bucket_bytes):
    docs = with_odd_columns(documents(spark, odd_texts() + [prose(i, 20) for i in range(200)])).repartition(3)
    out = sharding.shard(docs, shards, 1, bucket_bytes)
    assert set(out.columns) == set(docs.columns)  # shard and slot replace the clashing columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    digest = queries.shards_digest(out.select("doc_id", "text", "shard", "slot")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in digest)


def test_random_and_repeatable(spark):
    docs = documents(spark, [f"t{i}" for i in range(4000)])
    def order():
        return [r.doc_id for r in sorted(sharding.shard(docs, 4, 8, 1 << 15).collect(), key=lambda r: (r.shard, r.slot))]
    ids = order()
    assert ids == order()
    other = documents(spark, [f"t{i}" for i in range(4000)]).repartition(9)
    assert ids == [r.doc_id for r in sorted(sharding.shard(other, 4, 8, 1 << 15).collect(), key=lambda r: (r.shard, r.slot))]  # whatever the layout
    assert 0.47 < sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids) < 0.53
    first = [i for i in ids[:1000]]
    assert abs(sum(first) / 1000 - 2000) < 150


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, None)] * 300 + [(1, "same")] * 300, "doc_id long, text string")
    got = sharding.shard(docs, 40, 2, 2000).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 600 and set(sizes.values()) == {15}
    assert max(Counter(r.shard for r in got if r.doc_id is None).values()) < 15  # repeats are spread as well


def test_few_partitions_and_joined_offsets(spark, monkeypatch):
    """Many buckets in a task, offsets over several groups, joined by a shuffle."""
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(sharding, "GROUP", 4)
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 0)
    got = sharding.shard(documents(spark, [prose(i, 20) for i in range(300)]), 7, 1, 2000).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 300 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_write(spark, tmp_path):
    docs = documents(spark, [prose(i, 9) for i in range(50)])
    sharding.write_shards(docs, str(tmp_path / "out"), 5, 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard for r in back.collect()) == {s: 10 for s in range(5)}


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
