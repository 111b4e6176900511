"""Readers and writers.

Paths are caller-supplied and should name shared storage on a cluster.
Row positions (the pandas index of a CSV row) come from counts by byte range
(one row per range), never from a window over all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException

from ..config import (
    DEFAULT, QAConfig, UPLOAD_BAD_TYPE, UPLOAD_EMPTY, UPLOAD_NO_NAME, UPLOAD_TOO_LARGE,
)
from ..session import materialize, track_table
from .csv_records import read_csv
from .listing import can_list, is_folder, list_paths, read_files, write_files

CHUNK_SCHEMA = ("dataset string, question_idx long, chunk_idx long, question string, answer string, "
                "chunk_text string")
EVAL_SET_SCHEMA = (
    "evaluation_questions array<struct<id:long, question:string, topic:string, expected_source:string, "
    "category:string>>, metadata struct<total_questions:long, topics:array<string>, "
    "categories:array<string>, created_date:string, description:string>"
)


def read_qa_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                cfg: QAConfig = DEFAULT) -> DataFrame:
    """A1: a Question/Answer CSV (header, quoted multi-line cells) as
    ``(row_idx, question, answer, <extra columns>)``.  ``row_idx`` is the row
    position, file after file, unless the file carries a ``row_idx`` column.
    Cells equal to one of ``cfg.null_tokens`` are null.  A file is read by many
    tasks (``sources.csv_records``)."""
    raw = read_csv(spark, path, encoding)
    cols = {c.lower(): c for c in raw.columns}
    if "question" not in cols or "answer" not in cols:
        raise ValueError("the CSV needs Question and Answer columns")
    out = raw.withColumnRenamed(cols["question"], "question").withColumnRenamed(cols["answer"], "answer")
    for c in ("question", "answer"):
        out = out.withColumn(c, F.when(F.col(c).isin(*cfg.null_tokens), F.lit(None)).otherwise(F.col(c)))
    return out.withColumn("row_idx", F.col(cols["row_idx"]).cast("long"))


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The processed Q&A table (parquet, or CSV with a header)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        _csv_writer(w).csv(path)
    else:
        w.parquet(path)


def _csv_writer(w):
    """CSV with a header, RFC 4180 quote escaping, and cell whitespace kept
    (Spark's CSV writer trims it by default)."""
    return (w.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_chunks_jsonl(chunks: DataFrame, path: str) -> None:
    """One JSON object per chunk (UTF-8, non-ASCII kept)."""
    chunks.write.mode("overwrite").json(path)


def read_chunks_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """A3."""
    return spark.read.schema(schema).json(path)


#: folders of a saved index by hash of the term, postings of a bucket
TERM_FOLDERS, BUCKET_POSTINGS = 16, 20_000_000


def save_index(index, path: str, folders: int = TERM_FOLDERS, buckets: int | None = None, n_chunks: int | None = None) -> None:
    """A10: ``vocab``, ``postings`` and a manifest under ``path``.

    Postings lie in ``folders`` folders by hash of the term, so a batch reads
    only those of its terms; within each, in ``buckets`` hash buckets by chunk
    key, sorted by term: a loaded index sums scores inside the buckets, as a
    built one does, and skips row groups by their term statistics.  The
    manifest, written last, has this layout and the counts."""
    from ..operators.index import term_folder

    spark = index.vocab.sparkSession
    index.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    size = index.postings.agg(F.count(F.lit(1))).first()[0]
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_POSTINGS))
    keys = list(index.key_cols)
    table = f"sparqa_save_{uuid.uuid4().hex[:12]}"
    rows = index.postings.select(*keys, "term", "weight").withColumn("folder", term_folder("term", folders))
    (rows.repartition(buckets, *keys).write.mode("overwrite").partitionBy("folder").bucketBy(buckets, *keys).sortBy("term")
     .option("path", f"{path}/postings").saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
    n_terms, n_docs = index.vocab.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    if n_chunks is None:  # an index without terms does not know
        n_chunks = n_docs or 0
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "term", "weight"])
    spark.createDataFrame(
        [(folders, buckets, ",".join(keys), types, n_chunks, size, n_terms)], MANIFEST_SCHEMA
    ).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


MANIFEST_SCHEMA = "folders int, buckets int, key_cols string, columns string, chunks long, postings long, terms long"


def read_manifest(spark: SparkSession, path: str):
    """The manifest row of a saved index, or None."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest").first()
    except (AnalysisException, PySparkException, Py4JJavaError):
        return None


def load_index(spark: SparkSession, path: str, key_cols: list[str]):
    """The saved index with its folders and buckets, or None when it is
    missing, unfinished or unreadable."""
    from ..operators.index import TfidfIndex

    made = read_manifest(spark, path)
    if made is None or made["key_cols"] != ",".join(key_cols):
        return None
    try:
        vocab = spark.read.parquet(f"{path}/vocab")
        if not {"term", "idf", "df"} <= set(vocab.columns):
            return None
        if not made["postings"]:
            empty = spark.createDataFrame([], made["columns"])
            return TfidfIndex(vocab, empty, list(key_cols), 0, made.asDict())
        spark.read.parquet(f"{path}/postings")  # the footers can be read
        table = f"sparqa_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {table} ({made['columns']}, folder int) USING parquet PARTITIONED BY (folder) "
                  f"CLUSTERED BY ({', '.join(key_cols)}) SORTED BY (term) INTO {made['buckets']} BUCKETS LOCATION '{path}/postings'")
        track_table(table)
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        postings = spark.table(table)
    except (AnalysisException, PySparkException, Py4JJavaError):  # missing, or a footer that cannot be read
        return None
    return TfidfIndex(vocab, postings, list(key_cols), made["folders"], made.asDict())


def load_corpus(spark: SparkSession, processed: str, legacy: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A2: ``(question_idx, question, answer)`` of the processed Q&A table
    (parquet, or CSV with ``fmt='csv'``), else of the legacy cleaned CSV, else
    an empty table."""
    def csv(path):
        df = read_qa_csv(spark, path, "utf-8")
        if "question_idx" in df.columns:
            return df.withColumn("question_idx", F.col("question_idx").cast("long"))
        return df.withColumnRenamed("row_idx", "question_idx")

    for path, reader in ((processed, csv if fmt == "csv" else spark.read.parquet), (legacy, csv)):
        if not path:
            continue
        try:
            return reader(path).select("question_idx", "question", "answer")
        except AnalysisException:
            continue
    return spark.createDataFrame([], "question_idx long, question string, answer string")


def read_eval_set(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A4: nested evaluation-set JSON to one row per question.
    ``multi_line``: every file is one (pretty-printed) evaluation set; else
    every line is one, as Spark's JSON writer produces."""
    raw = spark.read.schema(EVAL_SET_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(F.explode("evaluation_questions").alias("q")).select("q.*")


# stands for a genuine replacement character while invalid bytes are dropped
# (noncharacters, which do not occur in interchanged text)
_GENUINE = "\ufdd0\ufdd1\ufdd0"


def valid_text(c) -> Column:
    """Text decoded as UTF-8 with invalid bytes dropped; genuine U+FFFD
    characters stay.  ``c``: a string (or binary) column of raw bytes."""
    raw = (F.col(c) if isinstance(c, str) else c).cast("string")
    kept = F.replace(raw, F.lit("\ufffd"), F.lit(_GENUINE))
    valid = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.replace(valid, F.lit(_GENUINE), F.lit("\ufffd"))


def file_name(path) -> Column:
    """The name of an uploaded file: a ``filename=`` directory value when the
    layout has one, else the last part of the path."""
    path = F.col(path) if isinstance(path, str) else path
    named = F.regexp_extract(path, r"/filename=([^/]*)/[^/]*$", 1)
    return F.when(named != "", F.try_url_decode(named)).otherwise(F.element_at(F.split(path, "/"), -1))


def suffix(name) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


RAW_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_raw_files(spark: SparkSession, path, max_bytes: int | None = None) -> DataFrame:
    """``(path, filename, size, content)`` of the files under ``path``.  Tasks
    list and read those of a folder (``sources.listing``); file names, patterns
    and stores that only Spark's file system knows go to its file source.  The bound on the size goes to
    the listing or the source, so larger files are not read."""
    if isinstance(path, str) and is_folder(path):
        found = list_paths(spark, path).where(F.col("size") > 0)
        if max_bytes is not None:
            found = found.where(F.col("size") <= max_bytes)
        return read_files(found, path).select("path", file_name("path").alias("filename"), "size", "content")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    return raw.select("path", file_name("path").alias("filename"), F.col("length").alias("size"), "content")


def write_text_files(files: DataFrame, path: str) -> None:
    """``files (filename, text)`` as text files, a folder for each name
    (``filename=<name>``) beside those already under ``path``.  Tasks write them
    in place: a job that moves each folder when it ends would move as many as
    there are files."""
    if can_list(path):
        write_files(files.select("filename", "text"), path)
    else:
        files.select("filename", "text").write.mode("append").partitionBy("filename").text(path)


def read_text_files(spark: SparkSession, path) -> DataFrame:
    """A5: ``(filename, path, text)`` of the files under ``path``, read
    whole and decoded as UTF-8 with invalid bytes dropped.  Zero-length files
    are not returned by file sources; :func:`validate_uploads` reports them."""
    return read_raw_files(spark, path).select("filename", "path", valid_text("content").alias("text"))


def csv_text(text) -> Column:
    """One CSV file (its text) as plain text: the names of its own header,
    then per row its position and cells separated by spaces, an empty cell as
    ``NaN`` (column padding is irrelevant: whitespace is collapsed right
    after).  Quoted cells may hold commas, newlines and doubled quotes; blank
    lines are skipped; a short row is padded with ``NaN``."""
    text = F.col(text) if isinstance(text, str) else text
    records = F.regexp_extract_all(text, F.lit(r'(?:"(?:[^"]++|"")*+"|[^"\r\n]++|")++'), F.lit(0))
    records = F.filter(records, lambda r: F.rlike(r, F.lit(r"[^ \t]")))

    def cells(record):
        found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',((?:"(?:[^"]++|"")*+"|[^",]++|")*+)'), F.lit(1))
        return F.transform(found, lambda c: F.when(
            F.rlike(c, F.lit(r'(?s)^".*"$')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))

    def row(width):
        def line(values, i):
            shown = F.transform(values, lambda c: F.when(c == "", F.lit("NaN")).otherwise(c))
            missing = F.array_repeat(F.lit("NaN"), F.greatest(width - F.size(values), F.lit(0)))
            return F.array_join(F.concat(F.array(i.cast("string")), shown, missing), " ")
        return line

    table = F.transform(records, cells)
    header = F.get(table, F.lit(0))
    rows = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), row(F.size(header)))
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.array(F.array_join(header, " ")), rows), "\n")).otherwise(F.lit(""))


def read_csv_as_text(spark: SparkSession, path) -> DataFrame:
    """``(filename, path, text)``, every CSV file under ``path`` rendered
    as one text by its own header; files are told apart by their path."""
    return read_text_files(spark, path).where(suffix(F.col("filename")) == ".csv").select(
        "filename", "path", csv_text("text").alias("text"))


def upload_texts(files: DataFrame) -> DataFrame:
    """``(filename, text)`` of accepted files ``(filename, content)``: CSV
    files as A6 renders them, others as they are."""
    text = files.select("filename", valid_text("content").alias("text"))
    return text.select("filename", F.when(suffix(F.col("filename")) == ".csv", csv_text("text")).otherwise(F.col("text")).alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, path, size)`` of every file under ``path``, zero-length
    files included, hidden files skipped.  Tasks list the folders
    (``sources.listing``); a store that only Spark's file system knows is walked
    on the driver, one row of metadata per file."""
    if can_list(path):
        return list_paths(spark, path).select(file_name("path").alias("filename"), "path", "size")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    it = fs.listFiles(p, True)
    rows = []
    while it.hasNext():
        st = it.next()
        name = st.getPath().getName()
        if name.startswith((".", "_")):  # hidden and marker files, as Spark's file sources skip them
            continue
        rows.append((st.getPath().toString(), int(st.getLen())))
    listing = spark.createDataFrame(rows, "path string, size long")
    return listing.select(file_name("path").alias("filename"), "path", "size")


def validate_uploads(files: DataFrame, cfg: QAConfig = DEFAULT) -> DataFrame:
    """``files(filename, size)`` plus ``accepted`` and ``reason``.
    Checks in order: a name, a supported (lower-cased) suffix, at most
    ``max_upload_bytes`` (equal is accepted), not empty."""
    name = F.coalesce(F.col("filename"), F.lit(""))
    reason = (
        F.when(name == "", F.lit(UPLOAD_NO_NAME))
        .when(~suffix(name).isin(*cfg.supported_file_types), F.lit(UPLOAD_BAD_TYPE))
        .when(F.col("size") > cfg.max_upload_bytes, F.lit(UPLOAD_TOO_LARGE))
        .when(F.col("size") == 0, F.lit(UPLOAD_EMPTY))
    )
    return files.select("*", reason.isNull().alias("accepted"), reason.alias("reason"))


def write_eval_results(res: DataFrame, path: str, single_file: bool = False) -> None:
    """Per-question results as CSV with a header.  ``single_file`` is
    for small reports only; large ones stay split across tasks."""
    out = res.coalesce(1) if single_file else res
    _csv_writer(out.write.mode("overwrite")).csv(path)


def write_eval_summary(summary: DataFrame, path: str) -> None:
    """The one-row summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
