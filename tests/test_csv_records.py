"""CSV records over many byte ranges against Python's csv module."""

import csv
import io
import random
import tempfile

import pytest

from sparqa.sources import csv_records
from sparqa.sources.io import read_qa_csv


def folder():
    return tempfile.mkdtemp(prefix="sparqa-test-")


def made(seed, rows):
    r = random.Random(seed)
    cells = ["", "plain", "a,b", 'say "x"', "two\nlines", '"\n"', "é日", "end\\", "\n\n\n", "x" * 300, '""', "tab\t", " padded "]
    table = [["id", "Question", "no, te"]] + [[str(i), r.choice(cells) + r.choice(cells), r.choice(cells)] for i in range(rows)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerows(table)
    return out.getvalue(), table


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_same_as_the_csv_module(spark, small_ranges, seed):
    text, table = made(seed, 400)
    d = folder()
    with open(f"{d}/t.csv", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    df = csv_records.read_csv(spark, d)
    assert spark.read.text(d).rdd.getNumPartitions() > 10
    got = sorted(df.collect(), key=lambda r: r.row_idx)
    assert df.columns == ["id", "Question", "no, te", "row_idx"]
    assert [r.row_idx for r in got] == list(range(400))
    assert [[x or "" for x in tuple(r)[:3]] for r in got] == table[1:]


def test_several_files_blank_lines_and_encodings(spark, small_ranges):
    d = folder()
    with open(f"{d}/a.csv", "wb") as f:
        f.write(b"\xef\xbb\xbfQuestion,Answer,more\n\nq0,\"caf\xc3\xa9\n\nx\"\n\n\nq1\nq2,a,b,c\n")
    with open(f"{d}/b.csv", "wb") as f:
        f.write(b"Question,Answer,more\r\nq3,\"open quote\nto the end,\n1\n")
    got = sorted(read_qa_csv(spark, d, "UTF-8").collect(), key=lambda r: r.row_idx)
    assert [(r.row_idx, r.question, r.answer, r.more) for r in got[:3]] == [(0, "q0", "café\n\nx", None), (1, "q1", None, None), (2, "q2", "a", "b")]
    assert got[3].row_idx == 3 and got[3].question == "q3" and len(got) == 4
    latin = folder()
    with open(f"{latin}/l.csv", "wb") as f:
        f.write("Question,Answer\ncaf\xe9,\"na\xefve\n\xe9\"\n".encode("latin-1"))
    assert [(r.question, r.answer) for r in read_qa_csv(spark, latin).collect()] == [("caf\xe9", "na\xefve\n\xe9")]


def test_no_records(spark):
    d = folder()
    open(f"{d}/e.csv", "w").close()
    with open(f"{d}/f.csv", "w") as f:
        f.write("\n\n")
    assert csv_records.read_csv(spark, d).count() == 0
    with pytest.raises(ValueError):
        read_qa_csv(spark, d)


def test_positions_query_writes_by_many_tasks(spark, tmp_path):
    """The texts are not drawn into one task: ordered files follow each other."""
    from sparqa.plans.registry import QUERIES
    from sparqa.sources import io

    rows = [(i * 7 % 40, f'line "{i}"\nof {i}') for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    parts, write = [], io.write_processed

    def noted(df, *args):
        parts.append("Coalesce 1" in df._jdf.queryExecution().executedPlan().toString())
        write(df, *args)

    io.write_processed = noted
    try:
        got = QUERIES["qa_csv_positions"](spark, str(tmp_path)).collect()
    finally:
        io.write_processed = write
    assert parts == [False]
    assert sorted((r.row_idx, int(r.doc_id)) for r in got) == [(i, i) for i in range(40)]
