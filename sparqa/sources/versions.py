"""Versions of a data set that is replaced as a whole.

Every build writes a folder of its own; committing it publishes one small
record ``_versions/<n>`` (path, batch, time).  A record is written aside and
moved to its name only if the name is free, so of two writers that saw the same
last version one gets the number and the other tries the next: no version is
lost or shared.  A batch that has a record already is not committed again.  The
newest record is current; folders of replaced versions, and of builds that were
never committed, are removed after a grace period in which readers may still
hold them.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path

RECORD = "version long, path string, batch string, time double"


def _records(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(RECORD).json(f"{root}/_versions")
    except AnalysisException:  # nothing committed yet
        return None


def current(spark: SparkSession, root: str) -> Row | None:
    """The newest record, or None."""
    records = _records(spark, root)
    return records.orderBy(F.desc("version")).first() if records is not None else None


def committed(spark: SparkSession, root: str, batch: str) -> Row | None:
    """The record of a batch, or None."""
    records = _records(spark, root)
    return records.where(F.col("batch") == batch).first() if records is not None else None


def new_folder(root: str) -> str:
    """A folder for a build."""
    return f"{root}/v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, path: str, batch: str | None = None) -> Row:
    """Make the build in ``path`` the next version; returns its record.  When
    ``batch`` has been committed (by anyone, in the meantime too), that record
    is returned and no version is made."""
    while True:
        if batch is not None and (done := committed(spark, root, batch)):
            return done
        last = current(spark, root)
        record = {"version": last["version"] + 1 if last else 0, "path": path, "batch": batch, "time": time.time()}
        if _create(spark, f"{root}/_versions", f"{record['version']:012d}", json.dumps(record)):
            return Row(**record)


def _create(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a file whole, under ``name``, unless there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = made.getFileSystem(conf)
    made, final = fs.makeQualified(made), fs.makeQualified(final)
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if made.toUri().getScheme() == "file":
            # renaming replaces files on local disks; a link does not
            get = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(get(jvm.java.net.URI.create(f"file://{final.toUri().getPath()}")),
                                               get(jvm.java.net.URI.create(f"file://{made.toUri().getPath()}")))
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            never = spark.sparkContext._gateway.new_array(rename, 1)
            never[0] = rename.NONE  # fails if the name is taken
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), conf).rename(made, final, never)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(made, False)


def expire(spark: SparkSession, root: str, grace_seconds: float) -> list[str]:
    """Remove the folders of versions that were replaced more than
    ``grace_seconds`` ago, and builds as old that no record names.  Records
    stay: they tell which batches were done.  Returns the removed folders."""
    records = _records(spark, root)
    if records is None:
        return []
    now = time.time()
    kept = {}
    rows = records.orderBy("version").collect()  # one small record a version
    for row, after in zip(rows, [*rows[1:], None], strict=True):
        kept[row["path"].rstrip("/").rsplit("/", 1)[-1]] = after is None or now - after["time"] <= grace_seconds
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        old = now - status.getModificationTime() / 1000 > grace_seconds
        if name.startswith("v-") and (not kept[name] if name in kept else old):
            delete_path(spark, f"{root}/{name}")
            removed.append(f"{root}/{name}")
    return removed
