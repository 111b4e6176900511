"""Committed versions: concurrent writers, repeated batches, removal."""

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

from sparqa.operators.chunking import explode_upload_chunks
from sparqa.plans.uploads import current_upload_corpus, replace_upload_index
from sparqa.sources import versions


def folder():
    return tempfile.mkdtemp(prefix="sparqa-test-")


def test_concurrent_writers_get_a_version_each(spark):
    root = folder()
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: versions.commit(spark, root, f"{root}/v-{i}", f"batch{i}"), range(12)))
    assert sorted(r["version"] for r in got) == list(range(12))
    assert len(os.listdir(f"{root}/_versions")) == 12
    last = versions.current(spark, root)
    assert last["version"] == 11 and last["path"] in {r["path"] for r in got}


def test_one_batch_by_many_writers_is_one_version(spark):
    root = folder()
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: versions.commit(spark, root, f"{root}/v-{i}", "same"), range(6)))
    assert len({r["path"] for r in got}) == 1
    assert {r["version"] for r in got} == {0}


def test_a_taken_name_is_not_replaced(spark):
    root = folder()
    assert versions._create(spark, f"{root}/_versions", "000000000000", "{}")
    assert not versions._create(spark, f"{root}/_versions", "000000000000", "other")
    with open(f"{root}/_versions/000000000000") as f:
        assert f.read() == "{}"
    assert os.listdir(f"{root}/_versions") == ["000000000000"]


def test_replayed_batch_and_removal(spark):
    root = folder()
    files = spark.createDataFrame([("a.txt", "first upload about spark"), ("b.txt", "second upload about parquet")], "filename string, text string")
    a, b = (explode_upload_chunks(files.where(f"filename = '{n}.txt'")) for n in "ab")
    first = replace_upload_index(spark, a, root, batch="1")
    second = replace_upload_index(spark, b, root, batch="2")
    assert replace_upload_index(spark, a, root, batch="1") == first
    assert {r.filename for r in current_upload_corpus(spark, root).chunks.collect()} == {"b.txt"}
    assert versions.expire(spark, root, 3600) == []
    os.makedirs(f"{root}/v-abandoned")
    assert sorted(versions.expire(spark, root, -1)) == sorted([first, f"{root}/v-abandoned"])
    assert not os.path.exists(first) and os.path.exists(second)
    # a removed version's batch is still known
    assert replace_upload_index(spark, a, root, batch="1") == first
    assert {r.filename for r in current_upload_corpus(spark, root).chunks.collect()} == {"b.txt"}
    # without a batch every call is a version
    third = replace_upload_index(spark, a, root, grace_seconds=-1)
    assert not os.path.exists(second) and {r.filename for r in current_upload_corpus(spark, root).chunks.collect()} == {"a.txt"}
    assert versions.current(spark, root)["path"] == third


def test_nothing_committed(spark):
    root = folder()
    assert versions.current(spark, root) is None and versions.committed(spark, root, "x") is None
    assert versions.expire(spark, root, 0) == []
