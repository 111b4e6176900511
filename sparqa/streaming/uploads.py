"""I1 ``stream_uploads``: files arriving in a directory become the current
upload index.

The stream reads whole files; every micro-batch is validated, decoded (CSV
files too), cleaned and chunked by the same code as a directory of uploads
(C5).  Rejected files are appended to a table; a batch with accepted files
replaces the upload index (D10), one without leaves it alone.  Versions are keyed by
checkpoint and batch, so a batch that is run again makes no second one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig
from ..plans.uploads import prepare_files, replace_upload_index
from ..session import materialize, scratch
from ..sources import io

REJECT_SCHEMA = "batch_id long, filename string, size long, reason string"


def upload_stream(spark: SparkSession, in_dir: str, max_files: int | None = None) -> DataFrame:
    """Streaming raw files ``(filename, size, content)`` arriving in ``in_dir``."""
    reader = spark.readStream.format("binaryFile").schema(io.RAW_FILE_SCHEMA).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(in_dir).select(io.file_name("path").alias("filename"), F.col("length").alias("size"), "content")


def start_upload_stream(spark: SparkSession, in_dir: str, index_root: str, checkpoint: str,
                        cfg: QAConfig = DEFAULT, available_now: bool = True, max_files: int | None = None):
    """Start I1; returns the ``StreamingQuery``.  Rejects land in
    ``index_root/_rejects/batch_id=<n>`` (a repeated batch overwrites its own)."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with scratch(session):
            # read once; what is too large is judged by its size alone
            small = F.when(F.col("size") <= cfg.max_upload_bytes, F.col("content"))
            files = materialize(batch.select("filename", "size", small.alias("content")))
            chunks, rejects = prepare_files(files, cfg)
            rejects.write.mode("overwrite").parquet(f"{index_root}/_rejects/batch_id={batch_id}")
            replace_upload_index(session, chunks, index_root, cfg, batch=f"{checkpoint}#{batch_id}")

    w = upload_stream(spark, in_dir, max_files).writeStream.foreachBatch(per_batch) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_rejects(spark: SparkSession, index_root: str) -> DataFrame:
    """The rejects of all batches: ``(batch_id, filename, size, reason)``."""
    return spark.read.schema(REJECT_SCHEMA).parquet(f"{index_root}/_rejects")
