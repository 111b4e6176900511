"""Evaluation of answered question sets.

``evaluate_questions`` builds the per-question result table; the report
operators are global or per-group aggregates over it (partial aggregation,
no collect).  Medians are exact (see ``exact_median``), standard deviations are
sample deviations, as in the report the service prints.  Float outputs are
rounded to 6 digits so that different summation orders agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import response_preview

R = 6

def _r(c):
    return F.round(c, R)


def evaluate_questions(answers: DataFrame, questions: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """G1: ``questions(query_id, question, topic, category,
    expected_source)`` left-joined with F7 ``answers``; a question without
    an answer becomes an error row (``source_used='error'``, nulls).
    ``latency(query_id, latency_ms)`` is optional (a batch has no per-row
    wall clock).  :func:`with_errors` adds the ``error`` column of the result
    file."""
    a = answers.select("query_id", "response", "source", "similarity_score", "is_grounded", "dataset_source")
    j = questions.join(a, "query_id", "left")
    if latency is not None:
        j = j.join(latency, "query_id", "left")
    else:
        j = j.withColumn("latency_ms", F.lit(None).cast("double"))
    ok = F.col("source").isNotNull()
    src = F.coalesce(F.col("source"), F.lit("error"))
    resp = F.col("response")
    return j.select(
        F.col("query_id").alias("question_id"),
        "question",
        F.coalesce(F.col("topic"), F.lit("Unknown")).alias("topic"),
        F.coalesce(F.col("category"), F.lit("Unknown")).alias("category"),
        F.when(ok, (F.col("similarity_score") > 0) | src.isin("dataset", "uploaded")).otherwise(F.lit(False))
        .alias("context_retrieved"),
        src.alias("source_used"),
        F.when(ok, F.col("expected_source")).alias("expected_source"),
        F.when(ok, F.col("expected_source").isNull() | (src == F.col("expected_source"))).alias("source_match"),
        F.when(ok, F.col("similarity_score")).cast("double").alias("similarity_score"),
        F.when(ok, F.when(F.col("is_grounded"), F.lit("grounded")).otherwise(F.lit("fallback"))).alias("answer_type"),
        F.when(ok, F.coalesce(F.col("is_grounded"), F.lit(False))).alias("is_grounded"),
        F.when(ok, F.col("dataset_source")).alias("dataset_source"),
        F.when(ok, F.round(F.col("latency_ms"), 2)).cast("double").alias("latency_ms"),
        F.when(ok, F.length(F.coalesce(resp, F.lit("")))).cast("long").alias("response_length"),
        F.when(ok, response_preview(resp)).alias("response_preview"),
    )


NO_ANSWER = "no answer"


def with_errors(res: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The result file's columns: G1's and ``error`` (the message of a failed
    question: from ``errors(query_id, error)``, else a fixed one; else null)."""
    failed = F.col("source_used") == "error"
    if errors is None:
        return res.withColumn("error", F.when(failed, F.lit(NO_ANSWER)))
    told = errors.select(F.col("query_id").alias("question_id"), "error")
    out = res.join(told, "question_id", "left")
    return out.withColumn("error", F.when(failed, F.coalesce("error", F.lit(NO_ANSWER))))


def results_from_events(ev: DataFrame) -> DataFrame:
    """Complete a large result table ``(question_id, topic, source_used,
    expected_source, similarity_score, is_grounded, latency_ms)`` with the
    G1 derived columns."""
    err = F.col("source_used") == "error"
    return ev.select(
        "question_id", "topic", "source_used",
        F.when(err, F.lit(False)).otherwise(
            (F.col("similarity_score") > 0) | F.col("source_used").isin("dataset", "uploaded")).alias("context_retrieved"),
        F.when(~err, F.col("expected_source")).alias("expected_source"),
        F.when(~err, F.col("expected_source").isNull() | (F.col("source_used") == F.col("expected_source"))).alias("source_match"),
        "similarity_score", "is_grounded", "latency_ms",
    )


def totals_error_rate(res: DataFrame) -> DataFrame:
    """G2."""
    total = F.count(F.lit(1))
    ok = F.count_if(F.col("source_used") != "error")
    return res.agg(total.alias("total_questions"), ok.alias("successful_responses"),
                   _r((total - ok) * 100.0 / total).alias("error_rate_pct"))


def source_distribution(res: DataFrame) -> DataFrame:
    """Count and share of all rows per source.  The share is taken over
    the grouped counts (one row per source), so the window is bounded by the
    number of sources, not by the rows."""
    counts = res.groupBy("source_used").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("source_used", "n", _r(F.col("n") * 100.0 / total).alias("pct"))


def context_rate(res: DataFrame) -> DataFrame:
    """G4."""
    n = F.count_if(F.col("context_retrieved"))
    return res.agg(n.alias("with_context"), _r(n * 100.0 / F.count(F.lit(1))).alias("pct"))


def exact_median(df: DataFrame, value_col: str, keys: list[str]) -> DataFrame:
    """Exact median of ``value_col`` per ``keys`` (pandas definition: the
    mean of the two middle values for an even count), without gathering a
    group into one task.

    Duplicates are first collapsed to (value, count) by a partially
    aggregated group-by, so a value repeated a third of all rows is one row.
    The distinct values are range-partitioned (a large group spreads over
    many partitions) and checkpointed; running counts inside each range and
    the per-range totals (one row per range and key) give every value's rank
    interval, and the one or two values covering the middle ranks are
    picked."""
    from ..session import materialize

    v = F.col(value_col)
    vc = df.where(v.isNotNull()).groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("__c"))
    ranged = materialize(vc.repartitionByRange(*keys, value_col).withColumn("__p", F.spark_partition_id()))
    w_local = Window.partitionBy("__p", *keys).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("__cum", F.sum("__c").over(w_local))
    tot = ranged.groupBy("__p", *keys).agg(F.sum("__c").alias("__t"))
    w_off = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("__off", F.coalesce(F.sum("__t").over(w_off), F.lit(0)))
    n = tot.groupBy(*keys).agg(F.sum("__t").alias("__n"))
    j = local.join(off.drop("__t"), ["__p", *keys]).join(n, list(keys))
    hi = F.col("__off") + F.col("__cum")
    lo = hi - F.col("__c")
    k1 = F.floor((F.col("__n") - 1) / 2)
    k2 = F.floor(F.col("__n") / 2)
    in1 = (lo <= k1) & (k1 < hi)
    in2 = (lo <= k2) & (k2 < hi)
    pick = j.where(in1 | in2).groupBy(*keys).agg(
        F.max(F.when(in1, v)).alias("__v1"), F.max(F.when(in2, v)).alias("__v2"))
    return pick.select(*keys, ((F.col("__v1") + F.col("__v2")) / 2).alias("median"))


def _stats_by(df: DataFrame, col: str, keys: list[str], count_name: str = "n") -> DataFrame:
    """count, mean, exact median, min, max and sample std of ``col`` per
    ``keys`` (all keys when empty)."""
    c = F.col(col)
    if not keys:
        df = df.withColumn("__g", F.lit(0))
        ks = ["__g"]
    else:
        ks = list(keys)
    agg = df.groupBy(*ks).agg(
        F.count(F.lit(1)).alias(count_name),
        _r(F.avg(c)).alias("mean"),
        _r(F.min(c)).alias("min"),
        _r(F.max(c)).alias("max"),
        _r(F.stddev_samp(c)).alias("std"),
    )
    med = exact_median(df, col, ks).select(*ks, _r(F.col("median")).alias("median"))
    out = agg.join(med, ks, "left")
    cols = [*keys, count_name, "mean", "median", "min", "max", "std"]
    return out.select(*cols)


def similarity_stats(res: DataFrame) -> DataFrame:
    """Over scores > 0."""
    return _stats_by(res.where(F.col("similarity_score") > 0), "similarity_score", [])


def source_accuracy(res: DataFrame) -> DataFrame:
    """Matches (rows without expectation count as matches) over rows
    with an expectation (which they do not join), kept as two columns."""
    m = F.count_if(F.col("source_match"))
    e = F.count_if(F.col("expected_source").isNotNull())
    return res.agg(m.alias("matches"), e.alias("expected"),
                   F.when(e > 0, _r(m * 100.0 / e)).alias("accuracy_pct"))


def grounding_rate(res: DataFrame) -> DataFrame:
    """Shares of all rows (error rows count as not grounded)."""
    g = F.count_if(F.col("is_grounded"))
    t = F.count(F.lit(1))
    return res.agg(g.alias("grounded"), _r(g * 100.0 / t).alias("grounded_pct"),
                   (t - g).alias("fallback"), _r((t - g) * 100.0 / t).alias("fallback_pct"))


def latency_stats(res: DataFrame) -> DataFrame:
    """Over non-null latencies."""
    return _stats_by(res.where(F.col("latency_ms").isNotNull()), "latency_ms", [])


def latency_by_source(res: DataFrame) -> DataFrame:
    """Per non-error source with at least one latency."""
    valid = res.where((F.col("source_used") != "error") & F.col("latency_ms").isNotNull())
    return _stats_by(valid, "latency_ms", ["source_used"]).select("source_used", "n", "mean", "median")


def topic_breakdown(res: DataFrame) -> DataFrame:
    """Per topic the total (``source_used`` null) and per (topic,
    source) counts, from one ``rollup`` pass."""
    r = res.rollup("topic", "source_used").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return r.where(F.col("g") < 3).select("topic", "source_used", "n", (F.col("g") == 1).alias("topic_total"))


def evaluation_summary(res: DataFrame) -> DataFrame:
    """The one-row summary; means skip nulls (error rows) as the
    report does."""
    return res.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(F.col("source_used") != "error").alias("successful_responses"),
        _r(F.avg(F.col("context_retrieved").cast("double"))).alias("context_retrieval_rate"),
        _r(F.avg("similarity_score")).alias("mean_similarity"),
        _r(F.avg("latency_ms")).alias("mean_latency_ms"),
        _r(F.avg(F.col("is_grounded").cast("double"))).alias("grounding_rate"),
    )


def dataset_hit_accuracy(res: DataFrame, expect_col: str = "expected_source") -> DataFrame:
    """Among rows expecting ``dataset``, the share answered from it (0
    without such rows); min / mean / max latency rounded to 1 decimal."""
    exp = F.count_if(F.col(expect_col) == "dataset")
    hits = F.count_if((F.col(expect_col) == "dataset") & (F.col("source_used") == "dataset"))
    return res.agg(
        hits.alias("hits"), exp.alias("expected"),
        F.coalesce(F.when(exp > 0, _r(hits * 100.0 / exp)), F.lit(0.0)).alias("accuracy_pct"),
        F.bround(F.min("latency_ms"), 1).alias("min_ms"),
        F.bround(F.avg("latency_ms"), 1).alias("avg_ms"),
        F.bround(F.max("latency_ms"), 1).alias("max_ms"),
    )


def detail_table(res: DataFrame) -> DataFrame:
    """G13."""
    return res.select("question_id", "question", "source_used", "similarity_score",
                      "context_retrieved", "is_grounded", "latency_ms")
