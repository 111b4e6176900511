"""Stand-in inputs derived from the supplied tables (see README, "Inputs").

* Raw Q&A table: ``conversations``; every user turn is a question, the next
  turn (number + 1) is its answer when that turn is the assistant's (else null);
  ``row_idx = conv_id * 2^32 + 2 * turn``.  Each question appears a second time
  with the next ``row_idx`` and the question text as its answer, so the
  keep-first rule of the dedup is visible.
* Corpora of the cascade: ``documents`` split by its ``source`` column into
  the curated corpus and the uploaded files (``filename = doc_<doc_id>.txt``);
  every document belongs to exactly one of the two (no source: curated).
* Questions: ``benchmark`` (``item_id``, ``text``).
* Generated answers (the generator hook's stand-in), by ``item_id % 4``:
  0 the question's own text, 1 the next item's text, 2 empty, 3 the
  uncertain text.  Expectations: ``item_id % 3`` 0 dataset, 1 llm, 2 none;
  topic ``topic_<item_id % 6>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig

# Sources of ``documents`` that stand for uploaded files.
UPLOAD_SOURCES = ("src0", "src5", "src10", "src15")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id():
    """One number per (conversation, turn); the next one is free."""
    return F.col("conv_id").cast("long") * F.lit(1 << 32) + F.col("turn") * 2


def raw_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw Q&A rows ``(row_idx, question, answer)``."""
    conv = table(spark, sf_dir, "conversations")
    # the next turn by an equi-join on (conv_id, turn + 1): keys are unique,
    # so a very long conversation does not land in one task as a window would
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"),
                      F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    turns = conv.where(F.col("role") == "user").join(nxt, ["conv_id", "turn"], "left")
    qs = turns.select(
        row_id().alias("row_idx"),
        F.col("text").alias("question"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
    )
    dups = qs.select(
        (F.col("row_idx") + 1).alias("row_idx"), "question", F.col("question").alias("answer")
    )
    return qs.unionByName(dups)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _uploaded():
    return F.coalesce(F.col("source"), F.lit("")).isin(*UPLOAD_SOURCES)


def main_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(~_uploaded())


def upload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded-file stand-ins ``(filename, text, doc_id)``."""
    d = documents(spark, sf_dir).where(_uploaded())
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "text",
        "doc_id",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, question)`` from ``benchmark``."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


# offsets of the added questions of ``odd_questions``
NULL_QUESTION, BLANK_QUESTION, UNANSWERED = 1_000_000, 2_000_000, 3_000_000


def odd_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` rows ``(item_id, text)`` and, for each, a null question, a
    blank one, and a reversed one for which nothing is generated."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    more = [(NULL_QUESTION, F.lit(None).cast("string")), (BLANK_QUESTION, F.lit(" \t ")), (UNANSWERED, F.reverse("text"))]
    out = b
    for offset, text in more:
        out = out.unionByName(b.select((F.col("item_id") + offset).alias("item_id"), text.alias("text")))
    return out


def list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, text)``: a list literal, JSON or Python, well-formed or
    not, or marker lines, around the whole text of each conversation turn
    (escaped within quotes)."""
    c = table(spark, sf_dir, "conversations")
    whole = F.coalesce("text", F.lit(""))

    def put(*parts):
        quote, w = parts[0][-1], whole
        if quote in "'\"":
            for plain, escaped in (("\\", "\\\\"), (quote, "\\" + quote), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                w = F.replace(w, F.lit(plain), F.lit(escaped))
        return F.concat(*[w if x is None else F.lit(x) for x in parts])

    forms = [
        ('["', None, '", "true", "0", "", "None"]'), ('["', None, '", null, true, 0, 2.5, false]'), ("['", None, "', None, True, 'x', \"it's\"]"),
        ('["', None, '", ["n", 1], {"k": "v"}, [], {}]'), ('["', None, '", broken]'), ('["', None, '"] and ["x"]'), ("['", None, "', true]"),
        ("Context 1: Question: ", None, "\nAnswer: ", None, "\n\n\n\nContext 22:  end"),
    ]
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(forms)))
    text = F.when(k == 0, put(*forms[0]))
    for i, f in enumerate(forms[1:], 1):
        text = text.when(k == i, put(*f))
    return c.select("conv_id", "turn", text.alias("text"))


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: fences, bullets and repetitions of each whole
    document."""
    w = F.col("text")
    text = F.concat(F.lit("- "), w, F.lit(". "), w, F.lit(".\n```\n"), w, F.lit(".\n"), w, F.lit(".\n```\n* "), w, F.lit("!\n  + other "), w, F.lit(". "), w, F.lit("\n"), w)
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def generated_answers(spark: SparkSession, sf_dir: str, cfg: QAConfig = DEFAULT, questions: DataFrame | None = None) -> DataFrame:
    """``(query_id, generated)``: deterministic stand-in for the generator."""
    b = questions if questions is not None else table(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next_text"))
    j = b.join(nxt, "item_id", "left")
    m = F.pmod(F.col("item_id"), F.lit(4))
    gen = (
        F.when(m == 0, F.col("text"))
        .when(m == 1, F.coalesce(F.col("next_text"), F.lit("")))
        .when(m == 2, F.lit(""))
        .otherwise(F.lit(cfg.uncertain_response))
    )
    return j.select(F.col("item_id").alias("query_id"), gen.alias("generated"))


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, question, topic, category, expected_source)``."""
    b = table(spark, sf_dir, "benchmark")
    m3 = F.pmod(F.col("item_id"), F.lit(3))
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.concat(F.lit("topic_"), F.pmod(F.col("item_id"), F.lit(6)).cast("string")).alias("topic"),
        F.concat(F.lit("category_"), F.pmod(F.col("item_id"), F.lit(2)).cast("string")).alias("category"),
        F.when(m3 == 0, F.lit("dataset")).when(m3 == 1, F.lit("llm")).alias("expected_source"),
    )


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large evaluation-result table from ``events``: the source used by
    ``event_id % 7`` (answer sources, ``event_type``, errors), ``value`` as latency, ``user_id % 6`` as topic; the other
    columns follow from the ids (see G1 for their meaning)."""
    e = table(spark, sf_dir, "events")
    m7 = F.pmod(F.col("event_id"), F.lit(7))
    src = F.col("event_type")
    for k, name in enumerate(("dataset", "uploaded", "llm", "uncertain", "dataset", None, "error")):
        if name:
            src = F.when(m7 == k, F.lit(name)).otherwise(src)
    err = src == "error"
    m3 = F.pmod(F.col("event_id"), F.lit(3))
    expected = F.when(m3 == 0, F.lit("dataset")).when(m3 == 1, F.lit("llm"))
    score = F.when(err, F.lit(None)).otherwise(F.round(F.pmod(F.col("value"), F.lit(1.0)), 6))
    grounded = F.when(err, F.lit(None)).otherwise(F.pmod(F.col("user_id"), F.lit(2)) == 0)
    return e.select(
        F.col("event_id").alias("question_id"),
        F.concat(F.lit("topic_"), F.pmod(F.col("user_id"), F.lit(6)).cast("string")).alias("topic"),
        src.alias("source_used"),
        expected.alias("expected_source"),
        score.cast("double").alias("similarity_score"),
        grounded.alias("is_grounded"),
        F.when(err, F.lit(None)).otherwise(F.col("value")).cast("double").alias("latency_ms"),
    )
