"""Sentence-aware overlapping chunks, and token blocks.

``chunk_text`` is an Arrow function: a text is cut inside the task that holds its
row, with no shuffle, in linear time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig
from ..functions.text import col_


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.
    Higher-order functions run interpreted, without common-subexpression
    elimination, so a value used several times is bound this way."""
    return F.transform(F.array(value), body).getItem(0)


def chunk_text(text, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """C1 ``chunk_text``: ``array<string>`` of the stripped, non-empty windows
    of the chunking loop, in code points.

    From start 0 while start < len: end = start + size; when end < len and the
    last '.' or newline of the window lies past size/2, the window ends after
    it.  The stripped window is kept; next start = end - overlap.  A text of
    at most ``size`` characters is returned unchanged (``""`` gives ``[""]``).
    Windows are slices of the text, so time is linear in it."""
    if overlap > size * 0.5 or size < 1 or overlap < 0:
        raise ValueError("need 0 <= overlap <= size/2 and size >= 1")
    return F.arrow_udf(_chunker(size, overlap), "array<string>")(col_(text))


def _chunker(size: int, overlap: int):
    """The Arrow function of :func:`chunk_text`."""
    def windows(text):
        n, start = len(text), 0
        if n <= size:
            yield text
            return
        while start < n:
            end = start + size
            if end < n:
                brk = max(text.rfind(".", start, end), text.rfind("\n", start, end)) - start
                if brk > size * 0.5:
                    end = start + brk + 1
            if window := text[start:end].strip():
                yield window
            start = end - overlap

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(windows(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run


def explode_chunks(df: DataFrame, text_col: str, cfg: QAConfig = DEFAULT,
                   idx_col: str = "chunk_idx", out_col: str = "chunk_text",
                   with_total: bool = False) -> DataFrame:
    """posexplode of C1 over a column; every other column rides along."""
    chunks = chunk_text(F.col(text_col), cfg.chunk_size, cfg.chunk_overlap)
    out = df.withColumn("__chunks", chunks)
    if with_total:
        out = out.withColumn("total_chunks", F.size("__chunks").cast("long"))
    # posexplode_outer: the plain generator makes the optimizer add a
    # ``size(chunks) > 0`` filter below this projection, with the whole
    # chunking expression inlined into it (the text would be chunked twice).
    out = out.select("*", F.posexplode_outer("__chunks").alias(idx_col, out_col)).drop("__chunks")
    out = out.where(F.col(idx_col).isNotNull())
    return out.withColumn(idx_col, F.col(idx_col).cast("long"))


def explode_qa_chunks(qa: DataFrame, dataset: str = "main_dataset", cfg: QAConfig = DEFAULT) -> DataFrame:
    """One row per answer chunk of processed Q&A rows
    ``(question_idx, question, answer)``."""
    out = explode_chunks(qa.select("question_idx", "question", "answer"), "answer", cfg)
    return out.select(
        F.lit(dataset).alias("dataset"),
        "question_idx",
        "chunk_idx",
        "question",
        "answer",
        "chunk_text",
    )


def explode_upload_chunks(files: DataFrame, cfg: QAConfig = DEFAULT) -> DataFrame:
    """One row per chunk of uploaded files ``(filename, text)``; the text
    is cleaned with B1 first."""
    from ..functions.text import preprocess_text

    cleaned = files.select("filename", preprocess_text("text").alias("text"))
    out = explode_chunks(cleaned, "text", cfg, with_total=True)
    return out.select(
        F.lit("uploaded_file").alias("source"),
        "filename",
        "chunk_idx",
        "total_chunks",
        "chunk_text",
    )


def pack_token_blocks(docs: DataFrame, block_size: int = 128, id_col: str = "doc_id",
                      text_col: str = "text", tokenizer=None) -> DataFrame:
    """Cut the token stream of a corpus (documents in ``id_col`` order)
    into fixed blocks of ``block_size`` tokens; an incomplete last block is
    dropped.

    ``tokenizer`` makes a text column an array of tokens (words or ids; see
    ``functions.tokenizers``); by default tokens are D1 word tokens.  Global positions come from a prefix sum over
    the small per-document count table (one row per document).  Each document
    is cut into the pieces of its token array that fall into one block, in the
    task that holds it, so a block gathers a few pieces (at most
    ``block_size`` tokens in all), not one row per token."""
    from ..session import materialize
    from .index import TOKEN_PATTERN

    if tokenizer is None:
        toks = docs.select(
            F.col(id_col).alias("doc_id"),
            F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0).alias("toks"),
        )
    else:  # encoded once: the counts and the cutting read the stored tokens
        toks = materialize(docs.select(F.col(id_col).alias("doc_id"), tokenizer(F.col(text_col)).alias("toks")))
    counts = toks.select("doc_id", F.size("toks").cast("long").alias("n"))
    placed = toks.join(_prefix_offsets(counts), "doc_id").where(F.size("toks") > 0)
    first = F.expr(f"offset div {block_size}")
    last = F.expr(f"(offset + size(toks) - 1) div {block_size}")
    pieces = placed.select("toks", "offset", F.explode(F.sequence(first, last)).alias("block_id"))
    lo = F.greatest(F.col("block_id") * block_size - F.col("offset"), F.lit(0))
    hi = F.least((F.col("block_id") + 1) * block_size - F.col("offset"), F.size("toks").cast("long"))
    pieces = pieces.select("block_id", F.col("offset").alias("pos"),
                           F.slice("toks", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    blocks = pieces.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    blocks = blocks.select("block_id", F.flatten(F.transform("p", lambda x: x["piece"])).alias("tokens"))
    blocks = blocks.where(F.size("tokens") == block_size)
    return blocks.select("block_id", "tokens", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("text"))


def _prefix_offsets(counts: DataFrame) -> DataFrame:
    """Exclusive running sum of ``n`` in ``doc_id`` order, computed per
    range partition and stitched with the (small) per-partition totals."""
    from pyspark.sql import Window

    from ..session import materialize

    # Checkpointed: both branches below must see the same partition numbers.
    parts = materialize(counts.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    w_in = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("local", F.coalesce(F.sum("n").over(w_in), F.lit(0)))
    totals = parts.groupBy("part").agg(F.sum("n").alias("tot"))
    # one row per partition: bounded by the partition count
    w_p = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("tot").over(w_p), F.lit(0)).alias("base"))
    return local.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("local")).cast("long").alias("offset")
    )
