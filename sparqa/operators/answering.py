"""Context, prompts, generation hook, gates, grounding, routing.

Everything is keyed by ``query_id``: a batch of questions is one set of
joins, never a loop.  Retrieval runs once per corpus at the lower (context)
threshold with k = max(retrieval k, context k); the strict result (k best at
the similarity threshold) is the same list filtered by score, because top-k
then threshold equals threshold then top-k.
"""

from __future__ import annotations

import uuid
from typing import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    ANSWER_MARK, CONTEXT_BLOCK, CONTEXT_QUESTION, DEFAULT, EMPTY_QUESTION_REPLY, LEAK_SLACK_CHARS,
    MIN_ANSWER_CHARS, MIN_GENERATED_CHARS, QAConfig,
)
from ..functions.text import clean_context, clean_generated, normalize_query, strip_ws
from ..session import materialize
from .index import remove_stop_words, smooth_idf, tokens_expr
from .retrieval import retrieve

ROUTE_SCHEMA = ("query_id long, response string, source string, similarity_score double, "
                "dataset_source string, is_grounded boolean")


HIT_SCHEMA = "query_id long, rank long, score double, text string, source_order int"


def corpus_hits(corpus, questions: DataFrame, cfg: QAConfig, source_order: int) -> DataFrame:
    """Top hits of one corpus at the context threshold with their answer
    text: ``(query_id, rank, score, text, source_order)``.  ``corpus.answer``
    maps the chunk key to the text a hit returns.  A corpus without an index
    (or none at all) has no hits."""
    if corpus is None or corpus.index is None:
        return questions.sparkSession.createDataFrame([], HIT_SCHEMA)
    k = max(cfg.top_k, cfg.context_top_k)
    lo = min(cfg.similarity_threshold, cfg.context_threshold)
    hits, small = retrieve(corpus.index, questions, k, lo, cfg, with_size=True)
    texts = corpus.answer_texts(hits, small)
    # Small (questions x k rows) and read by several branches of the cascade.
    return materialize(texts.select("query_id", "rank", "score", "text",
                                    F.lit(source_order).alias("source_order")))


def gather_context(hits: list[DataFrame], cfg: QAConfig = DEFAULT) -> DataFrame:
    """per query, the context-k best of every corpus in corpus order
    (uploaded first), concatenated; ``pos`` numbers the concatenation."""
    allh = hits[0]
    for h in hits[1:]:
        allh = allh.unionByName(h)
    allh = allh.where((F.col("rank") <= cfg.context_top_k) & (F.col("score") >= cfg.context_threshold))
    w = Window.partitionBy("query_id").orderBy("source_order", "rank")
    return allh.withColumn("pos", F.row_number().over(w))


def assemble_prompts(questions: DataFrame, context: DataFrame, cfg: QAConfig = DEFAULT,
                     use_llm: bool = True) -> DataFrame:
    """``(query_id, prompt)``.  Up to two cleaned, non-empty context
    texts as "Relevant information" blocks; without any, the short form."""
    if not use_llm:
        return questions.select("query_id", F.col("question").alias("prompt"))
    ctx = context.where(F.col("pos") <= cfg.context_top_k).select(
        "query_id", "pos", clean_context("text").alias("c")
    ).where(F.col("c") != "")
    blocks = ctx.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("cs"))
    blocks = blocks.select(
        "query_id",
        F.array_join(
            F.transform(F.slice("cs", 1, cfg.context_top_k),
                        lambda x: F.concat(F.lit(CONTEXT_BLOCK), x["c"])),
            "\n\n",
        ).alias("context"),
    )
    j = questions.join(blocks, "query_id", "left")
    prefix = cfg.prompt_prefix
    with_ctx = F.concat(F.lit(prefix + "\n\n"), F.col("context"),
                        F.lit("\n\n" + CONTEXT_QUESTION), F.col("question"), F.lit("\n\n" + ANSWER_MARK))
    short = F.concat(F.lit(prefix + "\n\n"), F.col("question"), F.lit("\n\n" + ANSWER_MARK))
    return j.select("query_id", F.when(F.col("context").isNotNull(), with_ctx).otherwise(short).alias("prompt"))


# generators made by a factory, one per Python worker process
_WORKER_GENERATORS: dict = {}


def generate_answers(prompts: DataFrame, generator: Callable[[pd.Series], pd.Series] | None = None,
                     cfg: QAConfig = DEFAULT, factory: Callable[[], Callable] | None = None,
                     with_errors: bool = False) -> DataFrame:
    """the generation hook, ``(query_id, raw)``.  ``generator`` maps a
    batch of prompts to a batch of raw texts on Arrow batches.  ``factory``
    makes such a generator; it is called once in each Python worker process
    and the generator is kept there, so a model is loaded once per worker.

    A batch that fails is tried again prompt by prompt; a prompt that fails by
    itself gets an empty text (and its message in ``error`` with
    ``with_errors``), so it never fails the job.  Without a generator the
    uncertain text is returned, as the service does."""
    out = _generate(prompts, generator, cfg, factory, "long")
    return out if with_errors else out.drop("error")


def _generate(prompts, generator, cfg, factory, id_type) -> DataFrame:
    """``(query_id, raw, error)``."""
    if generator is None and factory is None:
        return prompts.select("query_id", F.lit(cfg.uncertain_response).alias("raw"), F.lit(None).cast("string").alias("error"))
    token = uuid.uuid4().hex

    def run(batches):
        gen = generator
        if factory is not None:
            if token not in _WORKER_GENERATORS:
                _WORKER_GENERATORS[token] = factory()
            gen = _WORKER_GENERATORS[token]
        for pdf in batches:
            errors = [None] * len(pdf)
            try:
                raw = list(gen(pdf["prompt"]))
            except Exception:  # noqa: BLE001 - one bad prompt must not cost the others
                raw = [""] * len(pdf)
                for i in range(len(pdf)):
                    try:
                        raw[i] = next(iter(gen(pdf["prompt"].iloc[i:i + 1])))
                    except Exception as e:  # noqa: BLE001
                        errors[i] = f"{type(e).__name__}: {e}"
            out = pd.DataFrame({"query_id": pdf["query_id"], "raw": pd.Series(raw, index=pdf.index, dtype=object)})
            out["error"] = pd.Series(errors, index=pdf.index, dtype=object)
            yield out

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {id_type}, raw string, error string")


STORE_SCHEMA = "key string, raw string"


def _stored_answers(spark, store: str) -> DataFrame | None:
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException:  # nothing stored yet
        return None


def generate_stored(prompts: DataFrame, store: str, generator: Callable[[pd.Series], pd.Series] | None = None,
                    cfg: QAConfig = DEFAULT, factory: Callable[[], Callable] | None = None,
                    batch_prompts: int = 10_000) -> DataFrame:
    """F3 with a store: ``(query_id, raw, error)``.

    ``store`` is a folder of answers by the SHA-256 of their prompt.  Equal
    prompts are generated once, and only those that are not stored.  They go in
    batches of about ``batch_prompts``, each appended to the store when it is
    done, so a job that is run again, or a retried stage after it, does not call
    the generator for what is stored.  A prompt that fails is not stored: it has
    an empty text and its message, and is tried by the next call."""
    spark = prompts.sparkSession
    keyed = prompts.select("query_id", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("key"), "prompt")
    # the failures of this call, by key
    failed = []
    distinct = keyed.groupBy("key").agg(F.first("prompt").alias("prompt"))
    known = _stored_answers(spark, store)
    todo = distinct if known is None else distinct.join(known.select("key"), "key", "left_anti")
    todo = materialize(todo.select(F.col("key").alias("query_id"), "prompt"))
    batches = -(-todo.count() // batch_prompts)
    for i in range(batches):
        part = todo.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == i)
        made = materialize(_generate(part, generator, cfg, factory, "string"))
        made.where("error is null").select(F.col("query_id").alias("key"), "raw").write.mode("append").parquet(store)
        failed.append(made.where("error is not null").select(F.col("query_id").alias("key"), "raw", "error"))
    known = _stored_answers(spark, store)
    answers = spark.createDataFrame([], STORE_SCHEMA + ", error string")
    if known is not None:  # two writers may have stored one prompt
        answers = known.dropDuplicates(["key"]).withColumn("error", F.lit(None).cast("string"))
    for f in failed:
        answers = answers.unionByName(f)
    return keyed.join(answers, "key", "left").select("query_id", "raw", "error")


def postprocess_generated(raw: DataFrame) -> DataFrame:
    """Generation post-processing: B7, then texts shorter than 10 stripped
    characters become ''.  ``(query_id, generated)``."""
    c = clean_generated("raw")
    return raw.select(
        "query_id",
        F.when(F.length(strip_ws(c)) < MIN_GENERATED_CHARS, F.lit("")).otherwise(c).alias("generated"),
    )


def gate_generated(gen: DataFrame, cfg: QAConfig = DEFAULT) -> DataFrame:
    """``(query_id, answer, gate_reason)``; reason ``empty`` (empty or
    shorter than 5), ``leak`` (the uncertain text, plus at most 19 more
    characters), else null and ``answer`` is the stripped text."""
    g = F.coalesce(F.col("generated"), F.lit(""))
    s = strip_ws(g)
    unc = cfg.uncertain_response
    leak = F.lower(s).contains(unc.lower()) & (F.length(s) < len(unc) + LEAK_SLACK_CHARS)
    reason = F.when(F.length(s) < MIN_ANSWER_CHARS, F.lit("empty")).when(leak, F.lit("leak"))
    return gen.select("query_id", s.alias("answer"), reason.alias("gate_reason"))


def check_answer_relevance(answers: DataFrame, context: DataFrame, cfg: QAConfig = DEFAULT,
                           threshold: float | None = None) -> DataFrame:
    """``(query_id, relevance, is_relevant)``.  Per query a fresh TF-IDF
    (stop words, ``relevance_max_features`` terms, smooth idf, L2) is fitted
    on {answer, every context text}; relevance = the largest cosine between
    the answer and a context text.  Every aggregate is keyed by query_id, so
    vocabularies, N and df are per query.  Queries without context get
    (0.0, false)."""
    thr = cfg.relevance_threshold if threshold is None else threshold
    docs = answers.select("query_id", F.lit(0).alias("doc"), F.col("answer").alias("t")).unionByName(
        context.select("query_id", F.col("pos").cast("int").alias("doc"), F.col("text").alias("t"))
    )
    docs = docs.join(context.select("query_id").distinct(), "query_id", "left_semi")
    docs = docs.select("query_id", "doc", normalize_query("t").alias("t")).repartition("query_id")
    toks = docs.select("query_id", "doc", F.explode_outer(tokens_expr("t")).alias("term"))
    # per-(question, text) term counts, plus one null-term row per text so
    # the texts are counted in the same pass
    toks = toks.unionByName(docs.select("query_id", "doc", F.lit(None).cast("string").alias("term")))
    counted = materialize(remove_stop_words(toks).groupBy("query_id", "doc", "term")
                          .agg(F.count(F.lit(1)).alias("tf")))
    n = counted.where(F.col("term").isNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    tf = counted.where(F.col("term").isNotNull())
    stats = tf.groupBy("query_id", "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    wv = Window.partitionBy("query_id").orderBy(F.desc("total"), F.asc("term"))
    vocab = stats.withColumn("r", F.row_number().over(wv)).where(F.col("r") <= cfg.relevance_max_features)
    vocab = vocab.join(n, "query_id").select("query_id", "term", smooth_idf(F.col("n"), F.col("df")).alias("idf"))
    w = tf.join(vocab, ["query_id", "term"]).select(
        "query_id", "doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id", "doc")))
    w = w.select("query_id", "doc", "term", (F.col("w") / norm).alias("w"))
    a = w.where(F.col("doc") == 0).select("query_id", "term", F.col("w").alias("aw"))
    c = w.where(F.col("doc") > 0)
    cos = c.join(a, ["query_id", "term"]).groupBy("query_id", "doc").agg(F.sum(F.col("w") * F.col("aw")).alias("cos"))
    best = cos.groupBy("query_id").agg(F.max("cos").alias("m"))
    out = answers.select("query_id").join(best, "query_id", "left")
    rel = F.round(F.coalesce(F.col("m"), F.lit(0.0)), cfg.score_digits)
    return out.select("query_id", rel.alias("relevance"), (rel >= F.lit(thr)).alias("is_relevant"))


def route_answers(questions: DataFrame, main, uploaded=None, generated=None,
                  cfg: QAConfig = DEFAULT, use_uploaded: bool = False) -> DataFrame:
    """F6 ``get_chatbot_response`` for a batch ``(query_id, question)``.

    ``main`` / ``uploaded`` are corpora (see ``plans.corpus.Corpus``) or
    None; without any index the questions go to the generator, or are
    uncertain;
    ``generated`` is None (no generator), a DataFrame ``(query_id, raw)`` of
    raw generator output, or a callable for :func:`generate_answers`.
    Output columns: ``ROUTE_SCHEMA``."""
    hits = [corpus_hits(main, questions, cfg, 1)]
    if use_uploaded and uploaded is not None and uploaded.index is not None:
        hits.insert(0, corpus_hits(uploaded, questions, cfg, 0))
    strict = [h.where((F.col("rank") == 1) & (F.col("score") >= cfg.similarity_threshold)) for h in hits]
    best = strict[0]
    for s in strict[1:]:
        best = best.unionByName(s)
    wb = Window.partitionBy("query_id").orderBy("source_order")
    best = best.withColumn("__o", F.row_number().over(wb)).where(F.col("__o") == 1).select(
        "query_id", F.col("text").alias("best_text"), F.col("score").alias("best_score"),
        F.when(F.col("source_order") == 0, F.lit("uploaded")).otherwise(F.lit("dataset")).alias("best_source"))
    q = questions.join(best, "query_id", "left")
    answered = q.where(F.col("best_text").isNotNull()).select(
        "query_id", F.col("best_text").alias("response"), F.col("best_source").alias("source"),
        F.col("best_score").alias("similarity_score"),
        F.when(F.col("best_source") == "uploaded", F.lit("uploaded_files")).otherwise(F.lit("main_dataset")).alias("dataset_source"),
        F.lit(True).alias("is_grounded"))
    rest = q.where(F.col("best_text").isNull()).select("query_id", "question")
    unc = cfg.uncertain_response
    if generated is None:
        fallback = rest.select(
            "query_id", F.lit(unc).alias("response"), F.lit("uncertain").alias("source"),
            F.lit(0.0).alias("similarity_score"), F.lit("none").alias("dataset_source"),
            F.lit(False).alias("is_grounded"))
        return answered.unionByName(fallback)
    context = gather_context(hits, cfg).join(rest.select("query_id"), "query_id", "left_semi")
    if callable(generated):
        # generated once: grounding is judged on the very text that is returned
        raw = materialize(generate_answers(assemble_prompts(rest, context, cfg), generated, cfg))
    else:
        raw = generated.join(rest.select("query_id"), "query_id", "left_semi")
    gated = gate_generated(postprocess_generated(raw), cfg)
    ctx_best = context.groupBy("query_id").agg(F.max("score").alias("ctx_score"))
    strong = ctx_best.where(F.col("ctx_score") > cfg.strict_context_score).select("query_id")
    ok = gated.where(F.col("gate_reason").isNull())
    rel = check_answer_relevance(
        ok.join(strong, "query_id", "left_semi").select("query_id", "answer"),
        context.join(strong, "query_id", "left_semi"), cfg)
    j = (rest.join(gated, "query_id", "left").join(ctx_best, "query_id", "left")
         .join(rel, "query_id", "left"))
    # a question for which nothing was generated counts as an empty text
    gate = F.when(F.col("answer").isNull(), F.lit("empty")).otherwise(F.col("gate_reason"))
    has_ctx = F.col("ctx_score").isNotNull()
    strong_ctx = has_ctx & (F.col("ctx_score") > cfg.strict_context_score)
    rejected = strong_ctx & ~F.col("is_relevant") & (F.col("relevance") < cfg.hard_reject_relevance)
    uncertain = gate.isNotNull() | rejected
    score = (F.when(gate.isNotNull(), F.lit(0.0))
             .when(strong_ctx, F.col("relevance"))
             .when(has_ctx, F.col("ctx_score"))
             .otherwise(F.lit(0.0)))
    dsrc = (F.when(gate.isNotNull(), F.lit("none"))
            .when(rejected, F.lit(None).cast("string"))
            .otherwise(F.lit("llm_fallback")))
    grounded = F.when(gate.isNull() & strong_ctx, F.col("is_relevant")).otherwise(F.lit(False))
    fallback = j.select(
        "query_id",
        F.when(uncertain, F.lit(unc)).otherwise(F.col("answer")).alias("response"),
        F.when(uncertain, F.lit("uncertain")).otherwise(F.lit("llm")).alias("source"),
        score.cast("double").alias("similarity_score"),
        dsrc.alias("dataset_source"),
        grounded.alias("is_grounded"),
    )
    return answered.unionByName(fallback)


def answer_questions(questions: DataFrame, main, uploaded=None, generated=None,
                     cfg: QAConfig = DEFAULT, use_uploaded: bool = False) -> DataFrame:
    """F7 ``/ask`` for a batch: the message is stripped; an empty or missing
    one gets the fixed reply; the others go through F6 and B10.  Output: ``query_id,
    question, response, source, dataset_source, similarity_score,
    is_grounded``."""
    from .cleaning import format_answers

    qs = questions.select("query_id", F.coalesce(strip_ws("question"), F.lit("")).alias("question"))
    empty = qs.where(F.col("question") == "").select(
        "query_id", "question", F.lit(EMPTY_QUESTION_REPLY).alias("response"), F.lit("uncertain").alias("source"),
        F.lit(None).cast("string").alias("dataset_source"), F.lit(0.0).alias("similarity_score"),
        F.lit(None).cast("boolean").alias("is_grounded"))
    asked = qs.where(F.col("question") != "")
    routed = materialize(route_answers(asked, main, uploaded, generated, cfg, use_uploaded))
    routed = routed.join(asked, "query_id")
    formatted = format_answers(routed, "query_id", "response", "question", "formatted", cfg)
    formatted = formatted.select(
        "query_id", "question", F.col("formatted").alias("response"), "source", "dataset_source",
        "similarity_score", "is_grounded")
    return formatted.unionByName(empty)
