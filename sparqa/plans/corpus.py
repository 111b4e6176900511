"""Corpus jobs: chunk tables and indexes of the curated corpus and the
uploaded files (C2-C5, D7, D9, D10, H1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig
from ..functions.text import normalize_query, preprocess_text
from ..operators.chunking import explode_chunks, explode_qa_chunks
from ..operators.index import TfidfIndex, fit_index, question_index
from ..session import materialize, scratch, spread
from ..sources import io
from . import fixtures

DOC_KEY = ["doc_id", "chunk_idx"]
QA_KEY = ["question_idx", "chunk_idx"]


def document_chunks(docs: DataFrame, cfg: QAConfig = DEFAULT) -> DataFrame:
    """Documents cleaned with B1 and cut with C1: ``(doc_id, chunk_idx,
    chunk_text)``.

    Chunking runs where the documents are; a small input that arrives in
    fewer partitions than there are cores is spread by ``doc_id`` first."""
    cleaned = spread(docs.select("doc_id", "text"), "doc_id")
    cleaned = cleaned.select("doc_id", preprocess_text("text").alias("text"))
    return explode_chunks(cleaned, "text", cfg).select("doc_id", "chunk_idx", "chunk_text")


def dedup_first_by_question(raw: DataFrame) -> DataFrame:
    """Keep the first row (smallest ``row_idx``) of every raw question
    string; null questions form one group.  ``min_by`` aggregates partially
    before the shuffle, so a question repeated in a third of all rows costs
    one candidate row per map task, not one task holding all of them."""
    rest = [c for c in raw.columns if c != "question"]
    first = F.min_by(F.struct(*rest), F.col("row_idx")).alias("__first")
    return raw.groupBy("question").agg(first).select("question", "__first.*").select(*raw.columns)


def drop_null_qa(df: DataFrame) -> DataFrame:
    """Drop rows with a null question or answer (after B3)."""
    return df.dropna(subset=["question", "answer"])


def process_qa(raw: DataFrame) -> DataFrame:
    """C4 cleaning part: B3, B4, then B2 on questions and B1 on answers.
    ``question_idx`` is the raw row index."""
    kept = drop_null_qa(dedup_first_by_question(raw))
    return kept.select(
        F.col("row_idx").alias("question_idx"),
        normalize_query("question").alias("question"),
        preprocess_text("answer").alias("answer"),
    )


@dataclass
class Corpus:
    """A searchable corpus: chunk rows, their key, the fitted index, and the
    table that maps a hit to the text it returns (``answers`` keyed by
    ``answer_key``).

    The chunk table is written once it is cut: the index build reads it and
    retrieval joins back to it, so none of those reads re-chunks the text."""

    name: str
    chunks: DataFrame
    key_cols: list
    index: TfidfIndex | None
    answers: DataFrame | None = None
    answer_key: list | None = None
    clean_answers: bool = False

    def answer_texts(self, hits: DataFrame, small: bool | None = None) -> DataFrame:
        """``hits`` plus ``text``: the full answer of a hit (Q1).  Raw
        answers are cleaned (B1) after the join, i.e. only for the hits."""
        from ..operators.retrieval import attach

        out = attach(hits, self.answers, self.answer_key, small=small)
        if self.clean_answers:
            out = out.withColumn("text", preprocess_text("text"))
        return out


def all_document_corpus(spark: SparkSession, sf_dir: str, cfg: QAConfig = DEFAULT,
                        materialize_index: bool = True) -> Corpus:
    """Every document."""
    return _document_corpus(fixtures.documents(spark, sf_dir), cfg, materialize_index)


def main_document_corpus(spark: SparkSession, sf_dir: str, cfg: QAConfig = DEFAULT,
                         materialize_index: bool = True) -> Corpus:
    """The curated documents of the cascade."""
    return _document_corpus(fixtures.main_documents(spark, sf_dir), cfg, materialize_index)


def _document_corpus(docs: DataFrame, cfg: QAConfig, materialize_index: bool) -> Corpus:
    chunks = materialize(document_chunks(docs, cfg))
    idx = fit_index(chunks, DOC_KEY, "chunk_text", cfg.max_features, materialize=materialize_index)
    answers = docs.select("doc_id", "text")
    return Corpus("main_dataset", chunks, DOC_KEY, idx, answers, ["doc_id"], clean_answers=True)


def upload_corpus(spark: SparkSession, sf_dir: str, cfg: QAConfig = DEFAULT,
                  materialize_index: bool = True) -> Corpus:
    files = spread(fixtures.upload_documents(spark, sf_dir), "doc_id")
    cleaned = files.select("doc_id", "filename", preprocess_text("text").alias("text"))
    chunks = materialize(explode_chunks(cleaned, "text", cfg, with_total=True).select(
        "doc_id", "chunk_idx", "filename", "total_chunks", "chunk_text"
    ))
    idx = fit_index(chunks, DOC_KEY, "chunk_text", cfg.max_features, materialize=materialize_index)
    answers = chunks.select("doc_id", "chunk_idx", F.col("chunk_text").alias("text"))
    return Corpus("uploaded_files", chunks, DOC_KEY, idx, answers, DOC_KEY)


def qa_corpus(spark: SparkSession, sf_dir: str, cfg: QAConfig = DEFAULT,
              materialize_index: bool = True) -> Corpus:
    qa = spread(process_qa(fixtures.raw_qa(spark, sf_dir)), "question_idx")
    chunks = materialize(explode_qa_chunks(qa, "main_dataset", cfg))
    idx = fit_index(chunks, QA_KEY, "chunk_text", cfg.max_features, materialize=materialize_index)
    answers = chunks.where(F.col("chunk_idx") == 0).select("question_idx", F.col("answer").alias("text"))
    return Corpus("main_dataset", chunks, QA_KEY, idx, answers, ["question_idx"])


def question_corpus(qa: DataFrame, cfg: QAConfig = DEFAULT) -> Corpus:
    """The fallback corpus of processed Q&A rows without a chunk index (D9):
    questions are searched, answers returned; no rows, no index."""
    if qa.isEmpty():
        return Corpus("main_dataset", qa, QA_KEY, None)
    index = question_index(qa, cfg.max_features).materialize()
    return Corpus("main_dataset", qa, QA_KEY, index, qa.select("question_idx", F.col("answer").alias("text")), ["question_idx"])


def open_corpus(spark: SparkSession, root: str, cfg: QAConfig = DEFAULT) -> Corpus:
    """The curated Q&A corpus as :func:`build_corpus` left it under ``root``;
    without a readable index, the question fallback over what is there."""
    qa = io.load_corpus(spark, f"{root}/processed")
    index = io.load_index(spark, f"{root}/index", QA_KEY)
    if index is None:
        return question_corpus(qa, cfg)
    chunks = io.read_chunks_jsonl(spark, f"{root}/chunks")
    return Corpus("main_dataset", chunks, QA_KEY, index, qa.select("question_idx", F.col("answer").alias("text")), ["question_idx"])


def build_corpus(spark: SparkSession, csv: str, root: str, cfg: QAConfig = DEFAULT, encoding: str = "ISO-8859-1") -> bool:
    """C4, the whole job: a Question/Answer CSV to the processed table, the
    chunk records (JSON lines) and the index under ``root``.  Does nothing and
    returns False when the processed table is already there; it is written
    last, so an interrupted job is done again."""
    try:
        spark.read.parquet(f"{root}/processed")
        return False
    except AnalysisException:
        pass
    with scratch(spark):
        raw = io.read_qa_csv(spark, csv, encoding)
        qa = materialize(process_qa(raw.select("row_idx", "question", "answer")))
        io.write_chunks_jsonl(explode_qa_chunks(spread(qa, "question_idx"), "main_dataset", cfg), f"{root}/chunks")
        chunks = io.read_chunks_jsonl(spark, f"{root}/chunks")
        io.save_index(fit_index(chunks, QA_KEY, "chunk_text", cfg.max_features), f"{root}/index", n_chunks=chunks.count())
        io.write_processed(qa, f"{root}/processed")
    return True


# Built corpora per (application, data, kind, config): the written chunk
# tables and indexes are reused by every later query of the same application,
# the way the answering service keeps its index in memory between requests.
# The data is told by the files' sizes and times, so replaced tables are read
# anew.  Index builds are measured by ``fit_index``.
_CACHE: dict = {}
_BUILDERS = {"main": main_document_corpus, "uploaded": upload_corpus, "qa": qa_corpus, "all": all_document_corpus}


def data_version(spark: SparkSession, path: str) -> tuple:
    """Files, bytes and modification time of a table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    content = fs.getContentSummary(p)
    return content.getFileCount(), content.getLength(), fs.getFileStatus(p).getModificationTime()


def cached_corpus(spark: SparkSession, sf_dir: str, kind: str, cfg: QAConfig = DEFAULT) -> Corpus:
    table = "conversations" if kind == "qa" else "documents"
    key = (spark.sparkContext.applicationId, sf_dir, kind, cfg, data_version(spark, f"{sf_dir}/{table}.parquet"))
    if key not in _CACHE:
        _CACHE[key] = _BUILDERS[kind](spark, sf_dir, cfg)
    return _CACHE[key]


def release_corpora() -> None:
    """Forget the built corpora (their files go with the work folder)."""
    _CACHE.clear()
