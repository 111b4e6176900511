"""I2 replay equals batch; D10 replacement and clearing."""

import os
import tempfile

from pyspark.sql import functions as F

from sparqa.config import DEFAULT
from sparqa.operators import answering as A
from sparqa.operators.chunking import explode_upload_chunks
from sparqa.operators.index import fit_index
from sparqa.plans.corpus import DOC_KEY, Corpus
from sparqa.plans.uploads import current_upload_corpus, replace_upload_index
from sparqa.session import ensure_checkpoint_dir
from sparqa.streaming.answers import start_answer_stream
from sparqa.streaming.uploads import read_rejects, start_upload_stream


def folder():
    return tempfile.mkdtemp(prefix="sparqa-stream-", dir="/tmp")


def test_answer_stream_equals_batch(spark):
    ch = spark.createDataFrame([(0, 0, "python lists store ordered items"), (1, 0, "spark joins shuffle data")],
                               "doc_id long, chunk_idx long, chunk_text string")
    idx = fit_index(ch, DOC_KEY, materialize=True)
    main = Corpus("main", ch, DOC_KEY, idx, ch.select("doc_id", "chunk_idx", F.col("chunk_text").alias("text")),
                  DOC_KEY)
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(
        ["python lists store ordered items", "how do spark joins work", "zebra", "  "])],
        "query_id long, question string")
    src, out = folder() + "/q", folder() + "/a"
    qs.repartition(2).write.parquet(src)
    q = start_answer_stream(spark, src, out, folder() + "/ckpt", main, None, None, DEFAULT)
    q.awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(out).drop("batch_id").collect()}
    batch = {tuple(r) for r in A.answer_questions(qs, main, None, None, DEFAULT).collect()}
    assert streamed == batch and len(batch) == 4


def test_upload_index_replaced_and_cleared(spark):
    root = folder()
    files = spark.createDataFrame([("a.txt", "first upload about spark"), ("b.txt", "second upload about parquet")],
                                  "filename string, text string")
    replace_upload_index(spark, explode_upload_chunks(files.where("filename = 'a.txt'")), root)
    replace_upload_index(spark, explode_upload_chunks(files.where("filename = 'b.txt'")), root)
    corp = current_upload_corpus(spark, root)
    assert {r.filename for r in corp.chunks.collect()} == {"b.txt"}
    none = explode_upload_chunks(files.where("filename = 'none'"))
    assert replace_upload_index(spark, none, root) is None
    assert {r.filename for r in current_upload_corpus(spark, root).chunks.collect()} == {"b.txt"}
    replace_upload_index(spark, none, root, clear=True)
    assert current_upload_corpus(spark, root) is None


def run_uploads(spark, src, root, checkpoint):
    start_upload_stream(spark, src, root, checkpoint).awaitTermination()
    corp = current_upload_corpus(spark, root)
    return {r.filename: r.chunk_text for r in corp.chunks.collect()} if corp else None


def test_upload_stream(spark):
    src, root, checkpoint = folder(), folder() + "/index", folder() + "/ckpt"

    def put(name, data):
        with open(f"{src}/{name}", "wb") as f:
            f.write(data)

    put("a.txt", b"first   text caf\xe9")
    put("t.csv", b"name,score\nalpha,1\n")
    put("bad.pdf", b"%PDF")
    assert run_uploads(spark, src, root, checkpoint) == {"a.txt": "first text caf", "t.csv": "name score 0 alpha 1"}
    # a batch of rejects leaves the index
    put("worse.exe", b"MZ")
    assert set(run_uploads(spark, src, root, checkpoint)) == {"a.txt", "t.csv"}
    assert {r.filename for r in read_rejects(spark, root).collect()} == {"bad.pdf", "worse.exe"}
    # a stream that starts anew makes newer versions
    put("b.md", b"newer")
    assert set(run_uploads(spark, src, root, folder() + "/ckpt2")) == {"a.txt", "t.csv", "b.md"}


def test_batches_leave_nothing_behind(spark):
    ch = spark.createDataFrame([(0, 0, "python lists store ordered items")], "doc_id long, chunk_idx long, chunk_text string")
    main = Corpus("main", ch, DOC_KEY, fit_index(ch, DOC_KEY, materialize=True), ch.select("doc_id", "chunk_idx", F.col("chunk_text").alias("text")), DOC_KEY)
    src = folder() + "/q"
    spark.createDataFrame([(i, "python lists hold items") for i in range(6)], "query_id long, question string").repartition(3).write.parquet(src)
    raw = spark.createDataFrame([(i, "lists hold ordered items in python") for i in range(6)], "query_id long, raw string")
    work = ensure_checkpoint_dir(spark).removeprefix("file:") + "/work"

    def left():
        return len(spark.catalog.listTables()), len(os.listdir(work))

    before = left()
    start_answer_stream(spark, src, folder() + "/a", folder() + "/ckpt", main, None, raw, DEFAULT).awaitTermination()
    assert left() == before
