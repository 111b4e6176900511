"""Distributed listing against a walk of the folder."""

import os
import tempfile

from sparqa.sources import io, listing


def folder():
    return tempfile.mkdtemp(prefix="sparqa-test-")


def test_lists_every_file_once(spark):
    root = folder()
    for i in range(3000):
        d = f"{root}/sub{i % 97}/filename=f{i}.txt" if i % 3 else root
        os.makedirs(d, exist_ok=True)
        with open(f"{d}/part-{i}.txt", "w") as f:
            f.write("x" * (i % 5))
    for hidden in (".hidden", "_SUCCESS"):
        open(f"{root}/{hidden}", "w").close()
        open(f"{root}/sub1/{hidden}", "w").close()
    os.makedirs(f"{root}/empty/folder")
    want = sorted((f"file:{d}/{n}", os.path.getsize(f"{d}/{n}")) for d, _, names in os.walk(root) for n in names if n[0] not in "._")
    assert len(want) == 3000 and sum(n == 0 for _, n in want) == 600
    for parts in (1, 7):
        df = listing.list_paths(spark, root, parts)
        assert df.rdd.getNumPartitions() == parts
        assert sorted(map(tuple, df.collect())) == want
    files = io.list_files(spark, f"file://{root}")
    assert {r.filename for r in files.where("path like '%filename=%'").collect()} == {f"f{i}.txt" for i in range(3000) if i % 3}
    checked = io.validate_uploads(files)
    assert checked.where("not accepted").count() == 600


def test_empty_folder_and_other_stores(spark):
    assert listing.list_paths(spark, folder()).count() == 0
    assert not listing.can_list("viewfs://store/x") and listing.can_list("/x") and listing.can_list("file:///x")


def test_files_are_written_and_read_by_tasks(spark, tmp_path):
    """As the file source reads them: hidden and empty files are not there; a
    name with reserved characters and a repeated one come back."""
    from sparqa.sources import io

    root = str(tmp_path / "up")
    rows = [("a.txt", "one"), ("b+ c/d=%é.txt", "two\nlines"), ("a.txt", "again"), (None, None)]
    io.write_text_files(spark.createDataFrame(rows, "filename string, text string").coalesce(1), root)
    io.write_text_files(spark.createDataFrame([("late.csv", "x,y")], "filename string, text string"), root)
    (tmp_path / "up" / "_temporary").mkdir()
    (tmp_path / "up" / "sub" / ".git").mkdir(parents=True)
    for hidden in ("_temporary/t.txt", "sub/.git/h.txt", "sub/_SUCCESS", "sub/none.txt"):
        (tmp_path / "up" / hidden).write_text("" if "none" in hidden else "hidden")
    (tmp_path / "up" / "sub" / "big.txt").write_text("z" * 100)
    got = io.read_raw_files(spark, root, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "binaryFile" not in plan
    found = {r.filename: (r.size, bytes(r.content)) for r in got.collect()}
    assert {n: c for n, (_s, c) in found.items()} == {
        "a.txt": b"one\nagain\n", "b+ c/d=%é.txt": "two\nlines\n".encode(), "__HIVE_DEFAULT_PARTITION__": b"\n", "late.csv": b"x,y\n"}
    assert all(s == len(c) for s, c in found.values())
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length <= 50")
    assert {(r.path, bytes(r.content)) for r in got.collect()} == {(r.path, bytes(r.content)) for r in source.collect()}
    one = io.read_raw_files(spark, f"{root}/sub/*.txt")  # a pattern
    assert [r.filename for r in one.collect()] == ["big.txt"]
