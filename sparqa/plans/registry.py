"""Registered queries: one per operator, each over the whole supplied
tables.  ``QUERIES[name](spark, sf_dir) -> DataFrame``; the matching oracle
SQL is ``oracle.ORACLE[name]``."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import chunking as C
from ..operators import index as I
from ..operators import retrieval as R
from ..operators import answering as A
from ..operators import evaluation as G
from ..session import spread
from . import corpus as K
from . import fixtures as X

# the stand-in generator runs in Python workers, which do not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _round(c, d: int = DEFAULT.score_digits):
    return F.round(c, d)


# -- B: scalar text ------------------------------------------------------------

@register("preprocess_text")
def q_preprocess_text(spark: SparkSession, sf: str) -> DataFrame:
    d = X.documents(spark, sf)
    return d.select("doc_id", T.preprocess_text("text").alias("text"))


@register("normalize_question")
def q_normalize_question(spark, sf):
    b = X.table(spark, sf, "benchmark")
    return b.select("item_id", T.normalize_query("text").alias("question"))


# -- C: chunking ---------------------------------------------------------------

@register("chunk_text")
def q_chunk_text(spark, sf):
    """C1 on raw document text (newlines present, so both break rules run)."""
    d = spread(X.documents(spark, sf).select("doc_id", "text"), "doc_id")
    return C.explode_chunks(d, "text").select("doc_id", "chunk_idx", "chunk_text")


# -- D: index ------------------------------------------------------------------

@register("fit_index")
def q_fit_index(spark, sf):
    corp = K.all_document_corpus(spark, sf, materialize_index=False)
    p = corp.index.postings
    return p.select("doc_id", "chunk_idx", "term", _round(F.col("weight"), 9).alias("weight"))


@register("top_vocabulary")
def q_top_vocabulary(spark, sf):
    corp = K.all_document_corpus(spark, sf, materialize_index=False)
    v = corp.index.vocab
    return v.select("term", "df", _round(F.col("idf"), 9).alias("idf"), "n_docs")


# -- E: retrieval --------------------------------------------------------------

@register("retrieve_chunks")
def q_retrieve_chunks(spark, sf):
    """Benchmark questions against all documents, k=3 at
    the similarity threshold, with the chunk text."""
    corp = K.cached_corpus(spark, sf, "all")
    hits = R.retrieve(corp.index, X.questions(spark, sf), DEFAULT.top_k, DEFAULT.similarity_threshold)
    out = R.attach(hits, corp.chunks, K.DOC_KEY)
    return out.select("query_id", "rank", "score", "doc_id", "chunk_idx", "chunk_text")


# -- F: answering --------------------------------------------------------------

def _cascade_inputs(spark, sf):
    main = K.cached_corpus(spark, sf, "main")
    up = K.cached_corpus(spark, sf, "uploaded")
    qs = X.questions(spark, sf)
    raw = X.generated_answers(spark, sf).withColumnRenamed("generated", "raw")
    return main, up, qs, raw


def _context(spark, sf, cfg=DEFAULT):
    main, up, qs, raw = _cascade_inputs(spark, sf)
    hits = [A.corpus_hits(up, qs, cfg, 0), A.corpus_hits(main, qs, cfg, 1)]
    return qs, raw, A.gather_context(hits, cfg)


@register("gather_context")
def q_gather_context(spark, sf):
    """uploaded top-2 then curated top-2 at the context threshold."""
    _, _, ctx = _context(spark, sf)
    return ctx.select("query_id", F.col("pos").cast("long").alias("pos"), "source_order", "rank", "score")


@register("assemble_prompt")
def q_assemble_prompt(spark, sf):
    qs, _, ctx = _context(spark, sf)
    return A.assemble_prompts(qs, ctx)


@register("gate_generated")
def q_gate_generated(spark, sf):
    """B7 post-processing and F4 gates over the stand-in generator output."""
    raw = X.generated_answers(spark, sf).withColumnRenamed("generated", "raw")
    return A.gate_generated(A.postprocess_generated(raw))


@register("check_answer_relevance")
def q_check_answer_relevance(spark, sf):
    """F5 for every question with context: generated answer vs context."""
    qs, raw, ctx = _context(spark, sf)
    ans = A.gate_generated(A.postprocess_generated(raw)).select("query_id", "answer")
    ans = ans.join(ctx.select("query_id").distinct(), "query_id", "left_semi")
    return A.check_answer_relevance(ans, ctx)


@register("route_answers")
def q_route_answers(spark, sf):
    """the cascade uploaded -> curated -> generated -> uncertain."""
    main, up, qs, raw = _cascade_inputs(spark, sf)
    return A.route_answers(qs, main, up, raw, DEFAULT, use_uploaded=True)


@register("answer_questions")
def q_answer_questions(spark, sf):
    """/ask for the benchmark questions (cascade + B10 formatting)."""
    main, up, qs, raw = _cascade_inputs(spark, sf)
    return A.answer_questions(qs, main, up, raw, DEFAULT, use_uploaded=True)


def _odd_inputs(spark, sf):
    odd = X.odd_questions(spark, sf)
    qs = odd.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    raw = X.generated_answers(spark, sf, questions=odd).withColumnRenamed("generated", "raw")
    return qs, raw.where(F.col("query_id") < X.UNANSWERED)


@register("answer_odd_questions")
def q_answer_odd_questions(spark, sf):
    """F7 with null and blank questions and questions for which nothing was
    generated."""
    main, up, _, _ = _cascade_inputs(spark, sf)
    qs, raw = _odd_inputs(spark, sf)
    return A.answer_questions(qs, main, up, raw, DEFAULT, use_uploaded=True)


@register("route_without_index")
def q_route_without_index(spark, sf):
    """F6 without any index: generated answers or uncertain."""
    qs, raw = _odd_inputs(spark, sf)
    return A.route_answers(qs.where(F.col("question").isNotNull()), None, None, raw, DEFAULT)


@register("route_generated")
def q_route_generated(spark, sf):
    """F6 with a generator called in the cascade (F2, F3, F4, F5 on its
    output)."""
    main, up, qs, _ = _cascade_inputs(spark, sf)
    return A.route_answers(qs, main, up, extractive_generator, DEFAULT, use_uploaded=True)


@register("corpus_job")
def q_corpus_job(spark, sf):
    """C4, the whole job over a CSV of the raw Q&A rows, run twice (the second
    run finds it done), and the user turns against what it left."""
    from ..session import work_dir
    from ..sources import io

    d, root = work_dir(spark, "qa_csv"), work_dir(spark, "corpus_job")
    raw = X.raw_qa(spark, sf).select("row_idx", F.col("question").alias("Question"), F.col("answer").alias("Answer"))
    io.write_processed(raw, d, "csv")
    if not K.build_corpus(spark, d, root, encoding="UTF-8") or K.build_corpus(spark, d, root, encoding="UTF-8"):
        raise RuntimeError("the corpus job runs once")
    corp = K.open_corpus(spark, root)
    qs = X.table(spark, sf, "conversations").where(F.col("role") == "user").select(X.row_id().alias("query_id"), F.col("text").alias("question"))
    hits = R.retrieve(corp.index, qs, DEFAULT.top_k, DEFAULT.context_threshold)
    return corp.answer_texts(hits).select("query_id", "rank", "score", "question_idx", "chunk_idx", F.col("text").alias("answer"))


# -- G: evaluation -------------------------------------------------------------

def _event_results(spark, sf):
    return G.results_from_events(X.event_results(spark, sf))


def _answer_results(spark, sf, answered=None):
    main, up, qs, raw = _cascade_inputs(spark, sf)
    qs = qs if answered is None else qs.where(answered)
    ans = A.answer_questions(qs, main, up, raw, DEFAULT, use_uploaded=True)
    return G.evaluate_questions(ans, X.expectations(spark, sf))


@register("evaluate_questions")
def q_evaluate_questions(spark, sf):
    """G1 over the answered benchmark questions and their expectations."""
    return _answer_results(spark, sf)


@register("evaluation_summary")
def q_evaluation_summary(spark, sf):
    """G11 over the answered benchmark questions."""
    return G.evaluation_summary(_answer_results(spark, sf))


for _name, _fn in [
    ("totals_error_rate", G.totals_error_rate),
    ("source_distribution", G.source_distribution),
    ("context_rate", G.context_rate),
    ("similarity_stats", G.similarity_stats),
    ("source_accuracy", G.source_accuracy),
    ("grounding_rate", G.grounding_rate),
    ("latency_stats", G.latency_stats),
    ("latency_by_source", G.latency_by_source),
    ("topic_breakdown", G.topic_breakdown),
    ("events_summary", G.evaluation_summary),
    ("dataset_hit_accuracy", G.dataset_hit_accuracy),
]:
    def _mk(fn):
        def run(spark, sf):
            return fn(_event_results(spark, sf))
        run.__doc__ = f"{fn.__doc__.splitlines()[0]} (over the events result table)"
        return run
    register(_name)(_mk(_fn))


@register("detail_table")
def q_detail_table(spark, sf):
    return G.detail_table(_answer_results(spark, sf))


# -- B/C/D: Q&A corpus ------------------------------------------------------------

@register("dedup_first_by_question")
def q_dedup_first_by_question(spark, sf):
    """B3 on the raw Q&A rows (first row_idx per raw question wins)."""
    return K.dedup_first_by_question(X.raw_qa(spark, sf)).select("row_idx", "question", "answer")


@register("drop_null_qa")
def q_drop_null_qa(spark, sf):
    """B3 then B4."""
    return K.drop_null_qa(K.dedup_first_by_question(X.raw_qa(spark, sf))).select("row_idx", "question", "answer")


@register("prepare_qa_corpus")
def q_prepare_qa_corpus(spark, sf):
    """C4 cleaning: processed Q&A rows (B3, B4, B2 questions, B1 answers)."""
    return K.process_qa(X.raw_qa(spark, sf))


@register("explode_qa_chunks")
def q_explode_qa_chunks(spark, sf):
    """One row per answer chunk of the processed Q&A rows."""
    qa = spread(K.process_qa(X.raw_qa(spark, sf)), "question_idx")
    return C.explode_qa_chunks(qa).select("dataset", "question_idx", "chunk_idx", "question", "answer", "chunk_text")


@register("explode_upload_chunks")
def q_explode_upload_chunks(spark, sf):
    """Chunks of the uploaded-file stand-ins with their metadata."""
    files = spread(X.upload_documents(spark, sf), "doc_id")
    return C.explode_upload_chunks(files)


@register("question_index")
def q_question_index(spark, sf):
    """Fallback index over the processed questions (postings)."""
    qa = K.process_qa(X.raw_qa(spark, sf))
    idx = I.question_index(qa)
    return idx.postings.select("question_idx", "term", _round(F.col("weight"), 9).alias("weight"))


@register("retrieve_qa")
def q_retrieve_qa(spark, sf):
    """E7 on the Q&A corpus: every user turn of ``conversations`` against
    the answer chunks, returning the full answer (Q1)."""
    corp = K.cached_corpus(spark, sf, "qa")
    qs = X.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        X.row_id().alias("query_id"), F.col("text").alias("question"))
    hits = R.retrieve(corp.index, qs, DEFAULT.top_k, DEFAULT.context_threshold)
    out = corp.answer_texts(hits)
    return out.select("query_id", "rank", "score", "question_idx", "chunk_idx", F.col("text").alias("answer"))


# -- D: tokens, counts, query vectors ---------------------------------------------

@register("tokenize")
def q_tokenize(spark, sf):
    """D1 + D2: word tokens of every document with stop words removed, as
    per-document counts of kept and distinct tokens."""
    d = spread(X.documents(spark, sf).select("doc_id", "text"), "doc_id")
    toks = d.select("doc_id", F.explode_outer(I.tokens_expr("text")).alias("term")).where(F.col("term").isNotNull())
    kept = I.remove_stop_words(toks)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"),
                                      F.countDistinct("term").alias("n_terms"))


@register("term_frequency")
def q_term_frequency(spark, sf):
    """D3 over all document chunks."""
    chunks = K.document_chunks(X.documents(spark, sf))
    return I.term_frequency(chunks, K.DOC_KEY, "chunk_text")


@register("transform_queries")
def q_transform_queries(spark, sf):
    """Benchmark question vectors in the vocabulary of all documents."""
    corp = K.cached_corpus(spark, sf, "all")
    qp = I.transform_queries(corp.index, X.questions(spark, sf))
    return qp.select("query_id", "term", _round(F.col("qweight"), 9).alias("qweight"))


# -- E: scores, thresholds, ranks ---------------------------------------------------

def _scores(spark, sf, at_least=None):
    corp = K.cached_corpus(spark, sf, "all")
    qp = I.transform_queries(corp.index, X.questions(spark, sf))
    return corp, R.cosine_scores(qp, corp.index.postings, K.DOC_KEY, at_least=at_least, index=corp.index)


@register("cosine_scores")
def q_cosine_scores(spark, sf):
    """Every (question, chunk) pair sharing a vocabulary term."""
    return _scores(spark, sf)[1]


@register("threshold_filter")
def q_threshold_filter(spark, sf):
    """Pairs at or above the context threshold."""
    return _scores(spark, sf, DEFAULT.context_threshold)[1].where(F.col("score") >= DEFAULT.context_threshold)


@register("top_k_per_query")
def q_top_k_per_query(spark, sf):
    """E2 + E5: the 3 best chunks per question at the context threshold,
    ranked (ties: later chunk first)."""
    corp, sc = _scores(spark, sf, DEFAULT.context_threshold)
    top = R.top_k_per_query(sc, K.DOC_KEY, DEFAULT.top_k, DEFAULT.context_threshold)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "score", *K.DOC_KEY)


@register("best_chunk")
def q_best_chunk(spark, sf):
    """First ranked chunk per question (context threshold)."""
    corp, sc = _scores(spark, sf, DEFAULT.context_threshold)
    top = R.top_k_per_query(sc, K.DOC_KEY, 1, DEFAULT.context_threshold)
    return R.best_chunk(top).select("query_id", "score", *K.DOC_KEY)


@register("select_source")
def q_select_source(spark, sf):
    """The same questions against each source by name; an unknown source
    and one without an index give nothing."""
    qs = X.questions(spark, sf)
    sources = {"main": K.cached_corpus(spark, sf, "main"), "uploaded": K.cached_corpus(spark, sf, "uploaded"),
               "empty": K.Corpus("empty", qs, K.DOC_KEY, None)}
    out = None
    for name in ("main", "uploaded", "empty", "elsewhere"):
        h = R.select_source(sources, name, qs).select(F.lit(name).alias("source"), "query_id", "rank", "score", "text")
        out = h if out is None else out.unionByName(h)
    return out


@register("rank_chunks")
def q_rank_chunks(spark, sf):
    """E5: the hits of every question in score order, as positions."""
    corp, sc = _scores(spark, sf, DEFAULT.context_threshold)
    top = R.top_k_per_query(sc, K.DOC_KEY, DEFAULT.top_k, DEFAULT.context_threshold).drop("rank")
    return R.rank_chunks(top, K.DOC_KEY).select("query_id", "place", "score", *K.DOC_KEY)


# -- C6 ----------------------------------------------------------------------

@register("pack_token_blocks")
def q_pack_token_blocks(spark, sf):
    """The document token stream (doc_id order) in 128-token blocks."""
    d = X.documents(spark, sf).select("doc_id", "text")
    return C.pack_token_blocks(d, 128).select("block_id", "text")


@register("pack_token_blocks_bpe")
def q_pack_token_blocks_bpe(spark, sf, vocabulary="/opt/tokenizers/byte_bpe_50k.json"):
    """C6 with a public byte-pair vocabulary: blocks of token ids."""
    from ..functions.tokenizers import vocabulary_tokenizer

    d = spread(X.documents(spark, sf).select("doc_id", "text"), "doc_id")
    return C.pack_token_blocks(d, 128, tokenizer=vocabulary_tokenizer(vocabulary)).select("block_id", "text")


# -- B: text functions over the supplied texts ------------------------------------

@register("parse_list_string")
def q_parse_list_string(spark, sf):
    """B5 over every conversation turn: list items joined (null when the
    text is not a list literal)."""
    c = X.table(spark, sf, "conversations")
    items = T.parse_list_items(T.strip_ws("text"))
    return c.select("conv_id", "turn", T.join_list_items(items, "format").alias("items"))


@register("parse_list_typed")
def q_parse_list_typed(spark, sf):
    """B5 over list literals: kinds and texts of the items."""
    items = T.parse_list_items(F.col("text"))
    return X.list_texts(spark, sf).select(
        "conv_id", "turn", F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["kind"], x["text"])), "|").alias("items"))


@register("clean_context_lists")
def q_clean_context_lists(spark, sf):
    """B6 over list literals."""
    return X.list_texts(spark, sf).select("conv_id", "turn", T.clean_context("text").alias("text"))


@register("clean_generated_lists")
def q_clean_generated_lists(spark, sf):
    """B7 over list literals and marker lines."""
    return X.list_texts(spark, sf).select("conv_id", "turn", T.clean_generated("text").alias("text"))


@register("format_answer_lists")
def q_format_answer_lists(spark, sf):
    """B10 over list literals and marker lines."""
    from ..operators.cleaning import format_answers

    texts = X.list_texts(spark, sf).select(X.row_id().alias("row_idx"), "text", F.lit("What?").alias("question"))
    texts = spread(texts, "row_idx")
    return format_answers(texts, "row_idx", "text", "question", "response").select("row_idx", "response")


@register("dedup_sentences_marked")
def q_dedup_sentences_marked(spark, sf):
    """B9 over fences, bullets and repeated sentences."""
    from ..operators.cleaning import dedup_sentences

    return dedup_sentences(X.marked_texts(spark, sf), "doc_id", "text", "text")


@register("clean_context")
def q_clean_context(spark, sf):
    """B6 over every document."""
    return X.documents(spark, sf).select("doc_id", T.clean_context("text").alias("text"))


@register("clean_generated")
def q_clean_generated(spark, sf):
    """B7 over every conversation turn."""
    c = X.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.clean_generated("text").alias("text"))


@register("strip_prompt_prefix")
def q_strip_prompt_prefix(spark, sf):
    """B8 over the assembled prompts of the benchmark questions."""
    qs, _, ctx = _context(spark, sf)
    pr = A.assemble_prompts(qs, ctx).join(qs, "query_id")
    return pr.select("query_id", T.strip_prompt_prefix("prompt", "question").alias("text"))


@register("dedup_sentences")
def q_dedup_sentences(spark, sf):
    """B9 over every document."""
    from ..operators.cleaning import dedup_sentences

    return dedup_sentences(X.documents(spark, sf), "doc_id", "text", "text")


@register("format_answer")
def q_format_answer(spark, sf):
    """B10 over the raw Q&A answers with their questions."""
    from ..operators.cleaning import format_answers

    qa = X.raw_qa(spark, sf)
    out = format_answers(qa, "row_idx", "answer", "question", "response")
    return out.select("row_idx", "response")


@register("response_preview")
def q_response_preview(spark, sf):
    """B11 over every document."""
    d = X.documents(spark, sf)
    return d.select("doc_id", F.length("text").cast("long").alias("response_length"),
                    T.response_preview("text").alias("response_preview"))


@register("label_answers")
def q_label_answers(spark, sf):
    """Display labels of the routed answers."""
    from ..config import DATASET_SOURCE_NAMES, SOURCE_LABELS

    main, up, qs, raw = _cascade_inputs(spark, sf)
    r = A.route_answers(qs, main, up, raw, DEFAULT, use_uploaded=True)
    ds = F.col("dataset_source")
    return r.select(
        "query_id",
        T.lookup("source", SOURCE_LABELS).alias("source_label"),
        F.when(ds.isNotNull() & (ds != "none"),
               F.concat(F.lit("From: "), T.lookup(ds, DATASET_SOURCE_NAMES))).alias("dataset_label"),
        F.when(F.col("similarity_score") > 0,
               F.concat(F.lit("Similarity: "), F.format_string("%.2f", "similarity_score"))).alias("score_label"),
    )


# -- A: sources and sinks, C5, D10, H1 ----------------------------------------------

def _write_upload_files(spark, sf):
    """The uploaded-file stand-ins written as text files, one directory per
    file name (``filename=doc_<id>.txt``)."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "uploads")
    io.write_text_files(X.upload_documents(spark, sf), d)
    return d


@register("qa_csv_roundtrip")
def q_qa_csv_roundtrip(spark, sf):
    """A8 (CSV) then A1 then C4 cleaning: the raw Q&A rows through a CSV
    file give the processed Q&A table."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "qa_csv")
    raw = X.raw_qa(spark, sf).select("row_idx", F.col("question").alias("Question"), F.col("answer").alias("Answer"))
    io.write_processed(raw, d, "csv")
    back = io.read_qa_csv(spark, d, "UTF-8")
    return K.process_qa(back.select("row_idx", "question", "answer"))


@register("qa_csv_positions")
def q_qa_csv_positions(spark, sf):
    """A1 of a CSV without ``row_idx``: the document texts, line breaks and
    quotes in their cells, by position."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "qa_csv")
    docs = X.documents(spark, sf).where("text is not null").select(F.col("doc_id").cast("string").alias("Question"), F.concat(F.lit('"'), "text", F.lit('"')).alias("Answer"), "doc_id")
    io.write_processed(docs.orderBy("doc_id").drop("doc_id"), d, "csv")  # in files that follow each other
    return io.read_qa_csv(spark, d, "UTF-8").select("row_idx", F.col("question").alias("doc_id"), F.sha2("answer", 256).alias("answer_sha256"))


@register("chunks_jsonl_roundtrip")
def q_chunks_jsonl_roundtrip(spark, sf):
    """A9 then A3: the Q&A chunk records through JSON lines."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "chunks_jsonl")
    qa = spread(K.process_qa(X.raw_qa(spark, sf)), "question_idx")
    io.write_chunks_jsonl(C.explode_qa_chunks(qa), d)
    return io.read_chunks_jsonl(spark, d)


@register("index_roundtrip")
def q_index_roundtrip(spark, sf):
    """A10 then A11: the index of all documents saved and loaded (postings)."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "index")
    corp = K.all_document_corpus(spark, sf, materialize_index=False)
    io.save_index(corp.index, d)
    idx = io.load_index(spark, d, K.DOC_KEY)
    return idx.postings.select("doc_id", "chunk_idx", "term", _round(F.col("weight"), 9).alias("weight"))


@register("read_eval_set")
def q_read_eval_set(spark, sf):
    """A4: evaluation sets (nested JSON, 50 questions per document, built
    from the benchmark and its expectations) read back as rows."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "eval_set")
    e = X.expectations(spark, sf)
    qs = F.struct(F.col("query_id").alias("id"), "question", "topic", "expected_source", "category")
    docs = e.groupBy(F.floor(F.col("query_id") / 50).alias("part")).agg(
        F.collect_list(qs).alias("evaluation_questions"),
        F.struct(F.count(F.lit(1)).alias("total_questions"),
                 F.array_sort(F.collect_set("topic")).alias("topics"),
                 F.array_sort(F.collect_set("category")).alias("categories"),
                 F.lit("generated").alias("created_date"),
                 F.lit("benchmark questions").alias("description")).alias("metadata"))
    docs.drop("part").write.mode("overwrite").json(d)
    return io.read_eval_set(spark, d, multi_line=False).select(
        F.col("id").alias("query_id"), "question", "topic", "expected_source", "category")


@register("validate_uploads")
def q_validate_uploads(spark, sf):
    """A7 over a file table: the uploaded-file stand-ins (name, UTF-8 size)
    and every page (last URL segment, HTML size)."""
    from ..sources import io

    up = X.upload_documents(spark, sf).select("filename", F.octet_length("text").cast("long").alias("size"))
    pages = X.table(spark, sf, "pages").select(
        F.element_at(F.split("url", "/"), -1).alias("filename"), F.octet_length("html").cast("long").alias("size"))
    # too large, empty and unnamed files, from every document
    m = F.pmod(F.col("doc_id"), F.lit(3))
    odd = X.documents(spark, sf).select(
        F.when(m == 2, F.lit("")).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".CSV"))).alias("filename"),
        F.when(m == 0, F.col("n_chars") * (1 << 20)).when(m == 1, F.lit(0)).otherwise(F.col("n_chars")).cast("long").alias("size"))
    return io.validate_uploads(up.unionByName(pages).unionByName(odd))


@register("write_eval_results")
def q_write_eval_results(spark, sf):
    """A12 read back: the 15 result columns and ``error`` through CSV, with a
    fifth of the questions unanswered (error rows)."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "eval_results")
    res = G.with_errors(_answer_results(spark, sf, answered=F.pmod(F.col("query_id"), F.lit(5)) != 0))
    io.write_eval_results(res, d)
    return spark.read.schema(res.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(d)


@register("write_eval_summary")
def q_write_eval_summary(spark, sf):
    """The events summary through JSON."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "eval_summary")
    s = G.evaluation_summary(_event_results(spark, sf))
    io.write_eval_summary(s, d)
    return spark.read.schema(s.schema).json(d)


@register("prepare_uploads")
def q_prepare_uploads(spark, sf):
    """C5 (with A5, A7): upload files written from the stand-ins, validated,
    read, cleaned and chunked."""
    from .uploads import prepare_uploads

    d = _write_upload_files(spark, sf)
    chunks, _rejects = prepare_uploads(spark, d)
    return chunks


def _write_csv_files(spark, sf, d=None):
    """A CSV file for every hundred customers; files of odd number have a third
    column, which is empty."""
    from ..session import work_dir
    from ..sources import io

    d = d or work_dir(spark, "csv_uploads")
    n = X.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).alias("k"), F.col("c_custkey").alias("i"), F.col("c_name").alias("name"))
    odd = F.col("k") % 2 == 1
    line = F.concat(F.col("i").cast("string"), F.lit(',"'), F.col("name"), F.lit(', ""so"""'), F.when(odd, F.lit(",")).otherwise(F.lit("")))
    rows = n.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    header = F.when(odd, F.lit("id,name,note")).otherwise(F.lit("id,title"))
    name = F.concat(F.lit("customers"), F.col("k").cast("string"), F.lit(".csv"))
    io.write_text_files(rows.select(name.alias("filename"), F.concat(header, F.lit("\n"), "body").alias("text")), d)
    return d


@register("read_csv_as_text")
def q_read_csv_as_text(spark, sf):
    """CSV files with headers of their own, written from ``customer``."""
    from ..sources import io

    return io.read_csv_as_text(spark, _write_csv_files(spark, sf)).select("filename", T.preprocess_text("text").alias("text"))


@register("upload_rejects")
def q_upload_rejects(spark, sf):
    """C5's rejects: the stand-ins under unsupported names beside the CSV files."""
    from ..session import work_dir
    from ..sources import io
    from .uploads import prepare_uploads

    d = work_dir(spark, "reject_uploads")
    io.write_text_files(X.upload_documents(spark, sf).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(".txt")).otherwise(F.lit(".pdf"))).alias("filename"), "text"), d)
    _write_csv_files(spark, sf, d)
    return prepare_uploads(spark, d)[1].select("filename", "reason")


@register("replace_upload_index")
def q_replace_upload_index(spark, sf):
    """Two upload batches (all stand-ins, then only those of one
    source); the newer replaces the older, its postings are current."""
    from ..session import work_dir
    from .uploads import current_upload_corpus, replace_upload_index

    root = work_dir(spark, "upload_index")
    files = spread(X.upload_documents(spark, sf), "doc_id")
    first = C.explode_upload_chunks(files)
    second = C.explode_upload_chunks(
        files.join(X.documents(spark, sf).where(F.col("source") == "src5").select("doc_id"), "doc_id", "left_semi"))
    replace_upload_index(spark, first, root)
    replace_upload_index(spark, second, root)
    corp = current_upload_corpus(spark, root)
    return corp.index.postings.select("filename", "chunk_idx", "term",
                                      _round(F.col("weight"), 9).alias("weight"))


@register("corpus_status")
def q_corpus_status(spark, sf):
    """H1 of a stored Q&A corpus and the stored index of the uploaded-file
    stand-ins, from their metadata."""
    from ..session import work_dir
    from ..sources import io
    from .uploads import stored_status

    d = work_dir(spark, "status")
    corp = K.cached_corpus(spark, sf, "qa")
    io.write_processed(K.process_qa(X.raw_qa(spark, sf)), f"{d}/processed")
    io.save_index(corp.index, f"{d}/index", n_chunks=corp.chunks.count())
    up = K.cached_corpus(spark, sf, "uploaded")
    io.save_index(up.index, f"{d}/uploaded/index", n_chunks=up.chunks.count())
    return stored_status(spark, d, f"{d}/uploaded")


# -- I: streams --------------------------------------------------------------

@register("stream_uploads")
def q_stream_uploads(spark, sf):
    """Upload files arriving in a directory, indexed by the stream
    (availableNow); returns the chunks of the current upload version."""
    from ..session import work_dir
    from ..streaming.uploads import start_upload_stream

    src = _write_upload_files(spark, sf)
    root = work_dir(spark, "stream_index")
    q = start_upload_stream(spark, src, root, work_dir(spark, "stream_ckpt"))
    q.awaitTermination()
    from .uploads import current_upload_corpus

    corp = current_upload_corpus(spark, root)
    return corp.chunks


@register("stream_answers")
def q_stream_answers(spark, sf):
    """The benchmark questions arriving as several files, answered per
    micro-batch against the static corpora; equals ``answer_questions``."""
    from ..session import work_dir
    from ..streaming.answers import start_answer_stream

    src = work_dir(spark, "questions")
    X.questions(spark, sf).repartition(4).write.parquet(src)
    out = work_dir(spark, "answers")
    main, up, _qs, raw = _cascade_inputs(spark, sf)
    q = start_answer_stream(spark, src, out, work_dir(spark, "answers_ckpt"), main, up, raw,
                            DEFAULT, use_uploaded=True)
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


# -- F3, A2 --------------------------------------------------------------------

def extractive_generator(prompts):
    """Stand-in batch generator for the F3 hook: the second paragraph of the
    prompt (the first context block, or the question)."""
    return prompts.str.split("\n\n").str[1]


@register("generate_answers")
def q_generate_answers(spark, sf):
    """the generation hook run on Arrow batches (``mapInPandas``) over
    the assembled prompts, with the extractive stand-in generator."""
    qs, _, ctx = _context(spark, sf)
    return A.generate_answers(A.assemble_prompts(qs, ctx), extractive_generator)


@register("generate_stored")
def q_generate_stored(spark, sf):
    """F3 with a store: a first batch generates for every other question, a
    second for all; answers of the first come from the store."""
    from ..session import work_dir

    qs, _, ctx = _context(spark, sf)
    prompts = A.assemble_prompts(qs, ctx)
    store = work_dir(spark, "generated")
    A.generate_stored(prompts.where("query_id % 2 = 0"), store, extractive_generator)
    return A.generate_stored(prompts, store, extractive_generator).select("query_id", "raw")


@register("load_corpus")
def q_load_corpus(spark, sf):
    """A2: the processed Q&A table written as parquet and loaded back (the
    legacy path and the empty fallback are tested separately)."""
    from ..session import work_dir
    from ..sources import io

    d = work_dir(spark, "processed")
    io.write_processed(K.process_qa(X.raw_qa(spark, sf)), d)
    return io.load_corpus(spark, d, None)
