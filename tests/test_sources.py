"""A2, A5-A7, A11, C5 on files written in a fresh temporary folder."""

import os
import tempfile

from sparqa.config import UPLOAD_BAD_TYPE, UPLOAD_EMPTY, UPLOAD_TOO_LARGE
from sparqa.plans.uploads import prepare_uploads
from sparqa.sources import io


def folder():
    return tempfile.mkdtemp(prefix="sparqa-test-", dir="/tmp")


def test_validate_uploads(spark):
    files = spark.createDataFrame([
        ("a.TXT", 10), ("b.pdf", 10), ("c.md", 16 * 1024 * 1024), ("d.csv", 16 * 1024 * 1024 + 1),
        ("e.markdown", 0), ("", 5),
    ], "filename string, size long")
    got = {r.filename: (r.accepted, r.reason) for r in io.validate_uploads(files).collect()}
    assert got["a.TXT"] == (True, None)
    assert got["b.pdf"] == (False, UPLOAD_BAD_TYPE)
    assert got["c.md"] == (True, None)
    assert got["d.csv"] == (False, UPLOAD_TOO_LARGE)
    assert got["e.markdown"] == (False, UPLOAD_EMPTY)
    assert got[""][0] is False


def test_prepare_uploads_with_csv_and_rejects(spark):
    d = folder()
    with open(os.path.join(d, "notes.txt"), "w", encoding="utf-8") as f:
        f.write("  Spark   splits work.\n\nIt shuffles data.  ")
    with open(os.path.join(d, "table.csv"), "w", encoding="utf-8") as f:
        f.write("name,score\nalpha,1\nbeta,2\n")
    with open(os.path.join(d, "bad.pdf"), "wb") as f:
        f.write(b"%PDF")
    open(os.path.join(d, "empty.txt"), "w").close()
    with open(os.path.join(d, "latin.txt"), "wb") as f:
        f.write(b"caf\xe9 ok")
    chunks, rejects = prepare_uploads(spark, d)
    got = {r.filename: r.chunk_text for r in chunks.collect()}
    assert got["notes.txt"] == "Spark splits work. It shuffles data."
    assert got["table.csv"] == "name score 0 alpha 1 1 beta 2"
    assert got["latin.txt"] == "caf ok"
    assert {r.filename: r.reason for r in rejects.collect()} == {"bad.pdf": UPLOAD_BAD_TYPE, "empty.txt": UPLOAD_EMPTY}


def test_load_corpus_fallbacks(spark):
    d = folder()
    empty = io.load_corpus(spark, d + "/missing", None)
    assert empty.count() == 0 and empty.columns == ["question_idx", "question", "answer"]
    legacy = d + "/legacy.csv"
    with open(legacy, "w", encoding="utf-8") as f:
        f.write('Question,Answer,Extra\n"What is X?","X is ""quoted""\nover lines",1\nQ2,,2\n')
    got = io.load_corpus(spark, d + "/missing", legacy).orderBy("question_idx").collect()
    assert [(r.question_idx, r.question, r.answer) for r in got] == [
        (0, "What is X?", 'X is "quoted"\nover lines'), (1, "Q2", None)]


def test_load_index_missing(spark):
    assert io.load_index(spark, folder() + "/nothing", ["doc_id", "chunk_idx"]) is None


def test_read_eval_set_pretty_printed(spark):
    d = folder()
    with open(os.path.join(d, "evaluation_set.json"), "w", encoding="utf-8") as f:
        f.write('{\n  "evaluation_questions": [\n    {"id": 1, "question": "What is a list?", "topic": "Python",\n'
                '     "expected_source": "dataset", "category": "basics"},\n'
                '    {"id": 2, "question": "What is ML?", "topic": "ML", "expected_source": "llm",\n'
                '     "category": "concepts"}\n  ],\n  "metadata": {"total_questions": 2, "topics": ["Python", "ML"],\n'
                '   "categories": ["basics", "concepts"], "created_date": "2024-01-01", "description": "d"}\n}\n')
    got = [(r.id, r.topic, r.expected_source) for r in io.read_eval_set(spark, d).orderBy("id").collect()]
    assert got == [(1, "Python", "dataset"), (2, "ML", "llm")]


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_csv_files_keep_their_own_headers(spark):
    d = folder()
    write(d + "/x/t.csv", b"name,score\nalpha,1\n\nbeta,\n")
    write(d + "/y/t.csv", b'city,zip,country\r\n"Paris, FR",75,"a ""b"" c"\r\nRome,"0\n1"\r\n')
    write(d + "/z/empty.csv", b"\n")
    got = {r.path.split("/")[-2]: r.text for r in io.read_csv_as_text(spark, d).collect()}
    assert got == {"x": "name score\n0 alpha 1\n1 beta NaN",
                   "y": 'city zip country\n0 Paris, FR 75 a "b" c\n1 Rome 0\n1 NaN', "z": ""}


def test_genuine_replacement_characters_stay(spark):
    d = folder()
    write(d + "/a.txt", "ok \ufffd é".encode() + b" \xff\xfe caf\xe9 end")
    assert [r.text for r in io.read_text_files(spark, d).collect()] == ["ok \ufffd é  caf end"]


def test_broken_index_is_none(spark):
    d = folder()
    write(d + "/vocab/part-0.parquet", b"not parquet at all")
    write(d + "/postings/part-0.parquet", b"PAR1xxxxxxxxPAR1")
    assert io.load_index(spark, d, ["doc_id", "chunk_idx"]) is None


def test_corpus_job_and_fallback(spark):
    from sparqa.operators.retrieval import retrieve
    from sparqa.plans import corpus as K

    d = folder()
    write(d + "/qa.csv", b"Question,Answer\nWhat is a shuffle?,Spark moves rows between tasks.\nWhat is a shuffle?,again\nNo answer,\n")
    assert K.build_corpus(spark, d + "/qa.csv", d + "/out") and not K.build_corpus(spark, d + "/qa.csv", d + "/out")
    asked = spark.createDataFrame([(1, "rows between tasks"), (2, "shuffle")], "query_id long, question string")
    corp = K.open_corpus(spark, d + "/out")
    hits = corp.answer_texts(retrieve(corp.index, asked, 3, 0.2)).collect()
    assert [(r.query_id, r.text) for r in hits] == [(1, "Spark moves rows between tasks.")]
    # without the chunk index the questions are searched
    with open(os.path.join(d, "out", "index", "vocab", "part-broken.parquet"), "wb") as f:
        f.write(b"broken")
    fallback = K.question_corpus(io.load_corpus(spark, d + "/out/processed"))
    hits = fallback.answer_texts(retrieve(fallback.index, asked, 3, 0.2)).collect()
    assert [(r.query_id, r.text) for r in hits] == [(2, "Spark moves rows between tasks.")]
    assert K.question_corpus(io.load_corpus(spark, d + "/nowhere")).index is None


def test_cache_follows_the_data(spark):
    from sparqa.plans import corpus as K

    d = folder()
    df = spark.createDataFrame([(1, "first words of a text", "src1")], "doc_id long, text string, source string")
    df.write.parquet(d + "/documents.parquet")
    one = K.cached_corpus(spark, d, "all")
    assert K.cached_corpus(spark, d, "all") is one
    df.unionByName(df).write.mode("append").parquet(d + "/documents.parquet")
    assert K.cached_corpus(spark, d, "all") is not one
    K.release_corpora()
