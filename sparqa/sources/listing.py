"""Files listed, read and written by tasks; the listing is a Python data source.

Every partition looks at the top level of the folder and walks the entries
that fall to it by a hash of their name, so neither the driver nor any one task
holds the listing, and sub-folders are walked side by side.  It sees every
file, empty ones too (file sources skip those).
"""

from __future__ import annotations

import sys
import uuid
from urllib.parse import quote, unquote, urlsplit
from zlib import crc32

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: schemes that tasks can list; other stores are listed by Spark's own file system on the driver
SCHEMES = ("", "file", "s3", "gs", "abfs")
BATCH = 10_000

# tasks need pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def can_list(path: str) -> bool:
    return urlsplit(path).scheme in SCHEMES


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def _store(path: str):
    """The file system of ``path``, its path there, and what precedes such
    paths in those of Spark."""
    url = urlsplit(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(url.path) if url.scheme else path, "file:"
    store, base = pafs.FileSystem.from_uri(path)
    return store, base, f"{url.scheme}://"


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        store, base, prefix = _store(self.path)
        found = []
        for top in store.get_file_info(pafs.FileSelector(base)):
            if _hidden(top.base_name) or crc32(top.base_name.encode()) % self.parts != partition.value:
                continue
            todo = [top]
            while todo:
                info = todo.pop()
                if info.type == pafs.FileType.Directory:
                    todo += [x for x in store.get_file_info(pafs.FileSelector(info.path)) if x.type == pafs.FileType.Directory or not _hidden(x.base_name)]
                elif info.type == pafs.FileType.File:
                    found.append((prefix + info.path, info.size))
                    if len(found) == BATCH:
                        yield _batch(found)
                        found = []
        if found:
            yield _batch(found)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "size"])


class FileListing(DataSource):
    """``spark.read.format("file_listing").option("parts", n).load(path)``."""

    @classmethod
    def name(cls):
        return "file_listing"

    def schema(self):
        return "path string, size long"

    def reader(self, schema):
        return _ListingReader(self.options["path"], int(self.options.get("parts", "8")))


def list_paths(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """``(path, size)`` of the files under ``path``, hidden ones left out."""
    spark.dataSource.register(FileListing)
    parts = parts or spark.sparkContext.defaultParallelism
    return spark.read.format("file_listing").option("parts", str(parts)).load(path)


def is_folder(path: str) -> bool:
    """Whether tasks can list ``path``, a folder that is there."""
    if not can_list(path):
        return False
    store, base, _prefix = _store(path)
    return store.get_file_info(base).type == pafs.FileType.Directory


#: a hidden part of a path, as Spark's file sources skip them
HIDDEN = r"/(?:\.|_[^/=]*(?:/|$))"


def read_files(found: DataFrame, root: str) -> DataFrame:
    """``found (path, size)``, as :func:`list_paths` gives it for ``root``, with
    ``content``; files of hidden folders are left out."""
    _fs, base, before = _store(root)
    below = F.expr(f"substring(path, {len(before + base.rstrip('/')) + 1})")

    def run(batches):
        store, _base, prefix = _store(root)
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, held = [], 0
            for path, size in zip(paths, sizes):
                if rows and held + size > READ_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
                with store.open_input_stream(path[len(prefix):]) as f:
                    rows.append((path, size, f.read()))
                held += size
            if rows:
                yield _contents(rows)

    seen = found.where(~below.rlike(HIDDEN)).select("path", "size")
    return seen.mapInArrow(run, "path string, size long, content binary")


#: bytes of the files of a batch, unless one alone is larger
READ_BYTES = 16 << 20


def _contents(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "size", "content"])


def write_files(files: DataFrame, path: str) -> None:
    """Write ``files (filename, text)``: the texts of a name, each ended by a
    newline, in one file a task under ``filename=<name>``.  A task that is run
    again writes the files of its first attempt anew."""
    job = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        store, base, _prefix = _store(path)
        part = f"part-{TaskContext.get().partitionId():05d}-{job}.txt"
        last, lines, n = None, [], 0

        def write():
            folder = f"{base.rstrip('/')}/filename={last}"
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/{part}") as f:
                f.write("".join(f"{x}\n" for x in lines).encode())

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = quote(name, safe="") if name else "__HIVE_DEFAULT_PARTITION__"
                if lines and folder != last:
                    write()
                    lines, n = [], n + 1
                last = folder
                lines.append(text or "")
        if lines:
            write()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    store, base, _prefix = _store(path)
    store.create_dir(base)
    # the rows of a name follow each other in a task; the count runs all tasks
    files.sortWithinPartitions("filename").mapInArrow(run, "n long").agg({"n": "sum"}).first()
