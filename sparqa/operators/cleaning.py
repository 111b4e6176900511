"""Sentence de-duplication and answer formatting as DataFrame jobs.

A text is de-duplicated where its row is (``dedup_text``): an Arrow function
goes through its lines once and keeps what it meets for the first time, in
linear time and without a shuffle.  Texts that share an id count as one text
(``_dedup_together``): those alone are exploded into lines and sentences, the
first occurrence of a sentence is found with ``row_number`` over (id, sentence),
and the text is rebuilt with ordered ``collect_list``.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig
from ..functions.text import (
    LINE_BREAK, WS_CLASS, WS_RUN, join_list_items, lstrip_ws, parse_list_items,
    squeeze_newlines, strip_prompt_prefix, strip_ws, substring_from,
)
from ..session import materialize, spread

# Python workers need pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTENCE_BREAK = "(?<=[.!?])" + WS_RUN
FENCE = "```"
# the same in Python, where \s is what str.isspace() accepts and splitlines() ends lines as LINE_BREAK does
_SENTENCES = re.compile(r"(?<=[.!?])\s+").split
_BULLETS = ("* ", "+ ", "- ")


def _body(stripped):
    """A stripped line without its bullet, and the bullet (or '')."""
    bullet = stripped.rlike(r"^[*+\-] ")
    body = F.when(bullet, lstrip_ws(substring_from(stripped, F.lit(3)))).otherwise(stripped)
    return body, F.when(bullet, F.substring(stripped, 1, 1)).otherwise(F.lit(""))


def _normal(sentence):
    return F.lower(F.trim(F.regexp_replace(sentence, WS_RUN, " ")))


def _lead(line):
    return F.regexp_extract(line, "^(" + WS_CLASS + "*)", 1)


def _with_stop(c):
    needs_stop = (c != "") & ~c.endswith(FENCE) & ~F.substring(c, -1, 1).isin(".", "!", "?")
    return F.when(needs_stop, F.concat(c, F.lit("."))).otherwise(c)


def dedup_text(text: Column) -> Column:
    """B9 of one text (null: empty)."""
    return F.arrow_udf(_dedup_all, "string")(text)


#: rows that are turned into Python texts at a time
SLICE_ROWS = 256


def _dedup_all(texts: pa.Array) -> pa.Array:
    """The Arrow function of :func:`dedup_text`."""
    out = []
    for at in range(0, len(texts), SLICE_ROWS):
        out += [_dedup_one(t) if t else "" for t in texts.slice(at, SLICE_ROWS).to_pylist()]
    return pa.array(out, pa.string())


def _dedup_one(text: str) -> str:
    out, code = [], False
    # lines, sentences and normalised sentences that were met; those of a line met before were all met
    bodies, said, norms = set(), set(), set()
    for line in text.splitlines():
        stripped = line.strip()
        fence = stripped.startswith(FENCE)
        if fence or code or not stripped:
            code ^= fence
            out.append(line)
            continue
        bullet = stripped[:2] if stripped[:2] in _BULLETS else ""
        body = stripped[2:].lstrip() if bullet else stripped
        if body in bodies:
            continue
        bodies.add(body)
        kept = []
        # between single spaces a sentence ends without a regular expression; no line break is in a line
        single = " ".join(body.split()) == body
        sentences = body.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if single else _SENTENCES(body)
        for sentence in sentences:
            if sentence in said:
                continue
            said.add(sentence)
            norm = sentence.lower() if single else " ".join(sentence.split()).lower()
            if norm and norm not in norms:
                norms.add(norm)
                kept.append(sentence)
        if kept:
            out.append(line[:len(line) - len(line.lstrip())] + bullet + " ".join(kept))
    cleaned = "\n".join(out).strip()
    if cleaned and not cleaned.endswith(FENCE) and cleaned[-1] not in ".!?":
        cleaned += "."
    return cleaned


def _repeated(df: DataFrame, id_col: str) -> DataFrame | None:
    """The ids of more than one row, or None."""
    ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col(id_col).isNotNull() & (F.col("__n") > 1))
    ids = materialize(ids.select(id_col))
    return None if ids.isEmpty() else ids


def dedup_sentences(df: DataFrame, id_col: str = "id", text_col: str = "text",
                    out_col: str = "text") -> DataFrame:
    """B9 ``deduplicate_sentences_preserving_format``: ``(id, out_col)``.  Rows
    without an id get an empty text; rows that share one count as one text."""
    df = spread(df.select(id_col, text_col), id_col)
    twice = _repeated(df, id_col)
    once = df if twice is None else df.join(twice, id_col, "left_anti")
    out = once.select(id_col, F.when(F.col(id_col).isNull(), F.lit("")).otherwise(dedup_text(F.col(text_col))).alias(out_col))
    if twice is None:
        return out
    return out.unionByName(_dedup_together(df.join(twice, id_col, "left_semi"), id_col, text_col, out_col))


def _dedup_together(df: DataFrame, id_col: str, text_col: str, out_col: str) -> DataFrame:
    """B9 of the lines of all texts of an id, for every row of it."""
    base = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    base = base.repartition("__id")
    lines = base.select("__id", F.posexplode_outer(F.split("__t", LINE_BREAK, -1)).alias("ln", "line"))
    stripped = strip_ws("line")
    fence = stripped.startswith(FENCE)
    before = Window.partitionBy("__id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    fences_before = F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0))
    lines = lines.select(
        "__id", "ln", "line", stripped.alias("stripped"),
        (fence | (F.pmod(fences_before, F.lit(2)) == 1) | (stripped == "")).alias("passthrough"),
    )
    keep_as_is = lines.where("passthrough").select("__id", "ln", F.col("line").alias("out"))

    content = lines.where(~F.col("passthrough"))
    body, bullet = _body(F.col("stripped"))
    content = content.select("__id", "ln", _lead("line").alias("lead"), bullet.alias("bullet"), body.alias("body"))
    sents = content.select(
        "__id", "ln", "lead", "bullet",
        F.posexplode_outer(F.split("body", SENTENCE_BREAK, -1)).alias("sn", "sentence"),
    )
    sents = sents.withColumn("norm", _normal("sentence")).where(F.col("norm") != "")
    first = Window.partitionBy("__id", "norm").orderBy("ln", "sn")
    kept = sents.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") == 1)
    rebuilt = kept.groupBy("__id", "ln", "lead", "bullet").agg(
        F.sort_array(F.collect_list(F.struct("sn", strip_ws("sentence").alias("s")))).alias("ss")
    )
    body = F.array_join(F.transform("ss", lambda x: x["s"]), " ")
    rebuilt = rebuilt.select(
        "__id", "ln",
        F.when(F.col("bullet") != "", F.concat("lead", "bullet", F.lit(" "), body))
        .otherwise(F.concat("lead", body)).alias("out"),
    )
    out_lines = keep_as_is.unionByName(rebuilt)
    texts = out_lines.groupBy("__id").agg(
        F.sort_array(F.collect_list(F.struct("ln", "out"))).alias("ls")
    )
    cleaned = strip_ws(F.array_join(F.transform("ls", lambda x: x["out"]), "\n"))
    texts = texts.select("__id", cleaned.alias("c"))
    ids = base.select("__id")
    joined = ids.join(texts, "__id", "left").select("__id", F.coalesce("c", F.lit("")).alias("c"))
    return joined.select(F.col("__id").alias(id_col), _with_stop(F.col("c")).alias(out_col))


def format_answers(df: DataFrame, id_col: str, text_col: str, question_col: str | None,
                   out_col: str = "response", cfg: QAConfig = DEFAULT) -> DataFrame:
    """B10 ``format_chatbot_response`` for every row: ``df`` plus
    ``out_col``.  Null → ''; B8; strip; a list literal becomes its non-empty
    items (and nothing else is done); otherwise markers are removed, blank
    runs squeezed, and B9 runs."""
    question = F.col(question_col) if question_col else F.lit(None).cast("string")
    pre = strip_ws(strip_prompt_prefix(F.col(text_col), question, cfg))
    staged = df.select(
        "*",
        F.col(text_col).isNull().alias("__null"),
        pre.alias("__pre"),
    ).withColumn("__items", parse_list_items(F.col("__pre")))
    marked = F.regexp_replace("__pre", r"(?i)Context" + WS_RUN + r"\p{Nd}+:" + WS_CLASS + "*", "")
    marked = F.regexp_replace(marked, r"(?imd)^Answer:" + WS_CLASS + "*", "")
    marked = F.regexp_replace(marked, r"(?i)Question:" + WS_CLASS + "*", "")
    staged = staged.withColumn("__marked", strip_ws(squeeze_newlines(marked)))

    def valued(rows, dedup):
        value = (
            F.when(F.col("__null"), F.lit(""))
            .when(F.col("__items").isNotNull(), join_list_items(F.col("__items"), "format"))
            .otherwise(dedup)
        )
        return rows.withColumn(out_col, value).drop("__null", "__pre", "__items", "__marked", "__dedup")

    # the ids alone are counted; a row without one has no text to go back to
    twice = _repeated(df, id_col)
    once = staged if twice is None else staged.join(twice, id_col, "left_anti")
    out = valued(once, F.when(F.col(id_col).isNotNull(), dedup_text(F.col("__marked"))))
    if twice is None:
        return out
    rows = staged.join(twice, id_col, "left_semi")
    todo = rows.where(~F.col("__null") & F.col("__items").isNull())
    together = rows.join(_dedup_together(todo, id_col, "__marked", "__dedup"), id_col, "left")
    return out.unionByName(valued(together, F.col("__dedup")))
