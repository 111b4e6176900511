"""C5 ``prepare_uploads``, D10 ``replace_upload_index``, H1 ``corpus_status``.

An upload batch is a set of files.  Names and sizes are checked first;
accepted files are read once, cleaned, chunked and indexed, the same way from a
directory and from a stream.  The upload index is replaced atomically: every
build goes to a folder of its own and becomes current by one committed record,
so readers of earlier versions are never disturbed (D10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig
from ..operators.chunking import explode_upload_chunks
from ..operators.index import fit_index
from ..session import delete_path
from ..sources import io, versions
from .corpus import Corpus

UPLOAD_KEY = ["filename", "chunk_idx"]
CHUNK_SCHEMA = "source string, filename string, chunk_idx long, total_chunks long, chunk_text string"


def prepare_files(files: DataFrame, cfg: QAConfig = DEFAULT):
    """C5 for raw files ``(filename, size, content)``: ``(chunks, rejects)``,
    ``chunks`` with C3's columns, ``rejects`` the files that were not accepted
    with their reason."""
    checked = io.validate_uploads(files, cfg)
    rejects = checked.where(~F.col("accepted")).select("filename", "size", "reason")
    texts = io.upload_texts(checked.where("accepted"))
    return explode_upload_chunks(texts, cfg), rejects


def prepare_uploads(spark: SparkSession, upload_dir: str, cfg: QAConfig = DEFAULT):
    """``(chunks, rejects)`` of a directory.  Rejects come from a file
    listing, which alone sees empty files; accepted files are read in one
    pass, larger ones are not opened."""
    listing = io.validate_uploads(io.list_files(spark, upload_dir), cfg)
    rejects = listing.where(~F.col("accepted")).select("filename", "size", "reason")
    files = io.read_raw_files(spark, upload_dir, cfg.max_upload_bytes)
    return prepare_files(files.drop("path"), cfg)[0], rejects


def _corpus(chunks: DataFrame, index) -> Corpus:
    answers = chunks.select(*UPLOAD_KEY, F.col("chunk_text").alias("text"))
    return Corpus("uploaded_files", chunks, UPLOAD_KEY, index, answers, UPLOAD_KEY)


def upload_corpus_from_chunks(chunks: DataFrame, cfg: QAConfig = DEFAULT) -> Corpus:
    return _corpus(chunks, fit_index(chunks, UPLOAD_KEY, "chunk_text", cfg.max_features, materialize=True))


def replace_upload_index(spark: SparkSession, chunks: DataFrame, root: str, cfg: QAConfig = DEFAULT,
                         clear: bool = False, batch: str | None = None, grace_seconds: float | None = None) -> str | None:
    """Build the index of the newest upload batch and make it current.
    Returns the path of the new version.  A batch without chunks leaves the
    current index as it is (returns None) unless ``clear`` is set, which makes
    an empty version current.  Each build has a folder of its own, and versions
    are committed one after the other (``sources.versions``), so readers are
    never disturbed and two writers get two versions.  A repeated ``batch`` makes
    no version: the path of its first one is returned.  With ``grace_seconds``
    versions replaced longer ago are removed."""
    if batch is not None and (done := versions.committed(spark, root, batch)):
        return done["path"]
    path = versions.new_folder(root)
    chunks.write.parquet(f"{path}/chunks")
    stored = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    if not stored.isEmpty():
        io.save_index(fit_index(stored, UPLOAD_KEY, "chunk_text", cfg.max_features), f"{path}/index", n_chunks=stored.count())
    elif not clear:
        delete_path(spark, path)
        return None
    record = versions.commit(spark, root, path, batch)
    if record["path"] != path:  # another writer was first with this batch
        delete_path(spark, path)
    if grace_seconds is not None:
        versions.expire(spark, root, grace_seconds)
    return record["path"]


def current_upload_corpus(spark: SparkSession, root: str) -> Corpus | None:
    """The upload corpus of the newest version, or None."""
    record = versions.current(spark, root)
    if record is None:
        return None
    path = record["path"]
    idx = io.load_index(spark, f"{path}/index", UPLOAD_KEY)
    if idx is None:
        return None
    return _corpus(spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks"), idx)


def corpus_status(qa: DataFrame, main_chunks: DataFrame | None, upload_chunks: DataFrame | None,
                  index, has_llm: bool = False, model_name: str = "Retrieval-only") -> DataFrame:
    """H1: one row of readiness flags and counts (``/status`` and
    ``/debug``).  ``index``: the loaded curated index, or None when there is
    none (A11)."""
    # one pass: the three tables tagged and counted by one aggregate
    tagged = qa.select(F.lit(0).alias("k"))
    if main_chunks is not None:
        tagged = tagged.unionByName(main_chunks.select(F.lit(1).alias("k")))
    if upload_chunks is not None:
        tagged = tagged.unionByName(upload_chunks.select(F.lit(2).alias("k")))
    row = tagged.agg(
        F.count_if(F.col("k") == 0).alias("dataset_size"),
        F.count_if(F.col("k") == 1).alias("main_chunks_count"),
        F.count_if(F.col("k") == 2).alias("uploaded_chunks_count"),
    )
    return _flags(row, index is not None, has_llm, model_name)


def stored_status(spark: SparkSession, root: str, upload_path: str | None = None,
                  has_llm: bool = False, model_name: str = "Retrieval-only") -> DataFrame:
    """H1 of stored corpora, from metadata alone: the number of rows is in the
    footers of the processed table, those of chunks in the manifests of the
    saved indexes.  ``root`` is a corpus as ``build_corpus`` leaves it,
    ``upload_path`` a version of the upload index.  What is missing counts 0."""
    main = io.read_manifest(spark, f"{root}/index")
    uploaded = io.read_manifest(spark, f"{upload_path}/index") if upload_path else None
    counts = [F.lit(m["chunks"] if m else 0).alias(c) for m, c in ((main, "main_chunks_count"), (uploaded, "uploaded_chunks_count"))]
    rows = io.load_corpus(spark, f"{root}/processed").agg(F.count(F.lit(1)).alias("dataset_size"))
    return _flags(rows.select("dataset_size", *counts), main is not None, has_llm, model_name)


def _flags(row: DataFrame, has_index: bool, has_llm: bool, model_name: str) -> DataFrame:
    has_dataset = (F.col("dataset_size") > 0) & F.lit(has_index)
    has_up = F.col("uploaded_chunks_count") > 0
    ready = has_dataset | F.lit(has_llm) | has_up
    return row.select(
        F.when(ready, F.lit("ready")).otherwise(F.lit("not_ready")).alias("status"),
        ready.alias("ready"),
        has_dataset.alias("has_dataset"),
        F.lit(has_llm).alias("has_llm"),
        has_up.alias("has_uploaded_files"),
        F.col("dataset_size").cast("long").alias("dataset_size"),
        F.lit(model_name).alias("mode"),
        F.col("main_chunks_count").cast("long").alias("main_chunks_count"),
        F.col("uploaded_chunks_count").cast("long").alias("uploaded_chunks_count"),
    )


__all__ = ["prepare_files", "prepare_uploads", "replace_upload_index", "current_upload_corpus", "corpus_status", "stored_status",
           "upload_corpus_from_chunks"]
