"""Scalar text functions as native Column expressions (list literals alone
are read by an Arrow function, see ``literals``).

All regular expressions here are written so that they behave the same in
Java's regex engine (Spark) and in RE2 (the SQL oracle): no look-behind in the
oracle forms, explicit whitespace and digit classes instead of ``\\s``/``\\d``
(which are Unicode-aware in the service but ASCII in Java and RE2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, QAConfig, PREVIEW_CHARS
from .literals import literal_items

# Unicode whitespace, the set of characters ``str.isspace()`` accepts:
# U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680, U+2000-200A, U+2028,
# U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
# The same characters, to trim.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Line boundaries recognised by ``str.splitlines()``.
LINE_BREAK = r"\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
# A whole-text list literal: '[' ... ']' with nothing outside.
LIST_LITERAL = r"(?s)^\[.*\]$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_(c), "^" + WS_RUN + "|" + WS_RUN + "$", "")


def lstrip_ws(c) -> Column:
    return F.regexp_replace(col_(c), "^" + WS_RUN, "")


def rstrip_ws(c) -> Column:
    return F.regexp_replace(col_(c), WS_RUN + "$", "")


def preprocess_text(c) -> Column:
    """B1: cast to string, strip, and collapse every whitespace run to one
    space.  After the collapse only ASCII spaces remain, so ``trim`` finishes
    the strip."""
    return F.trim(F.regexp_replace(col_(c).cast("string"), WS_RUN, " "))


def normalize_query(c) -> Column:
    """B2: B1 followed by lower-casing (questions and queries)."""
    return F.lower(preprocess_text(c))


def is_list_literal(c) -> Column:
    """Text that starts with '[' and ends with ']' (after the caller's
    stripping)."""
    return col_(c).rlike(LIST_LITERAL)


def parse_list_items(c) -> Column:
    """B5 parse step: the items of a JSON list literal, else of a Python one,
    as ``array<struct<kind, text, truthy>>``; null when the text is neither.
    ``kind``: ``string``, ``number``, ``bool``, ``null`` or ``nested``;
    ``text`` is how the service prints the item."""
    return literal_items(F.when(is_list_literal(c), col_(c)))


def strip_brackets(c) -> Column:
    """``s.strip('[]')``: drop every leading and trailing bracket character."""
    return F.regexp_replace(col_(c), r"^[\[\]]+|[\[\]]+$", "")


def join_list_items(items: Column, mode: str) -> Column:
    """Join parsed list items with newlines.

    mode ``context``: drop falsy items (the empty string, null, false, zero
    and empty containers, not texts that look like them), strip the rest (B6);
    ``llm``: strip every item, keep all (B7);
    ``format``: strip, drop the empty ones (B10).
    """
    def stripped(xs):
        return F.transform(xs, lambda x: strip_ws(x["text"]))

    if mode == "context":
        return F.array_join(stripped(F.filter(items, lambda x: x["truthy"])), "\n")
    if mode == "llm":
        return F.array_join(stripped(items), "\n")
    if mode == "format":
        return F.array_join(F.filter(stripped(items), lambda x: x != ""), "\n")
    raise ValueError(mode)


def clean_context(c) -> Column:
    """B6 ``clean_context_chunk``: a list literal becomes its non-empty items,
    one per line; otherwise strip brackets (only when the list did not parse),
    strip and collapse whitespace."""
    text = col_(c).cast("string")
    items = parse_list_items(text)
    listy = text.startswith("[") & text.endswith("]")
    fallback = F.when(listy, F.trim(strip_brackets(text))).otherwise(text)
    collapsed = F.regexp_replace(strip_ws(fallback), WS_RUN, " ")
    return F.when(items.isNotNull(), join_list_items(items, "context")).otherwise(collapsed)


def remove_markers(c) -> Column:
    """Marker removal of B7: ``Context <n>:`` and ``Question:``
    anywhere and ``Answer:`` at the start of a line, all case-insensitive,
    with the whitespace that follows."""
    out = F.regexp_replace(col_(c), r"(?i)Context" + WS_RUN + r"\p{Nd}+:" + WS_CLASS + "*", "")
    out = F.regexp_replace(out, r"(?i)Question:" + WS_CLASS + "*", "")
    # (?d): only '\n' ends a line, as in the service's regex engine.
    return F.regexp_replace(out, r"(?imd)^Answer:" + WS_CLASS + "*", "")


def squeeze_newlines(c) -> Column:
    return F.regexp_replace(col_(c), r"\n{3,}", "\n\n")


def clean_generated(c) -> Column:
    """B7 ``clean_llm_response``."""
    text = strip_ws(col_(c).cast("string"))
    text = remove_markers(text)
    items = parse_list_items(text)
    listy = text.startswith("[") & text.endswith("]")
    text = (
        F.when(items.isNotNull(), join_list_items(items, "llm"))
        .when(listy, F.trim(strip_brackets(text)))
        .otherwise(text)
    )
    return strip_ws(squeeze_newlines(text))


def strip_prompt_prefix(text, question, cfg: QAConfig = DEFAULT) -> Column:
    """Drop a leading prompt prefix and an echoed question.

    The text is always left-stripped; only when it starts with the prefix is
    the prefix removed (then newlines, spaces and colons), and then a
    case-insensitive echo of the stripped question (then the same
    characters)."""
    t = lstrip_ws(col_(text))
    prefix = cfg.prompt_prefix
    after = F.regexp_replace(substring_from(t, F.lit(len(prefix) + 1)), r"^[\n :]+", "")
    q = strip_ws(F.coalesce(col_(question).cast("string"), F.lit("")))
    lc = lstrip_ws(after)
    echoed = F.lower(lc).startswith(F.lower(q))
    cut = F.regexp_replace(substring_from(lc, F.length(q) + 1), r"^[\n :]+", "")
    handled = F.when(q == "", after).when(echoed, cut).otherwise(lc)
    return F.when(t.startswith(prefix), handled).otherwise(t)


def substring_from(c: Column, pos: Column) -> Column:
    """``c[pos-1:]`` with a column position (1-based)."""
    return F.substring(c, pos, F.greatest(F.length(c) - pos + 1, F.lit(0)))


def response_preview(c, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus '...' when longer than ``n``."""
    t = F.coalesce(col_(c), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def lookup(c, mapping: dict) -> Column:
    """Literal map lookup with pass-through of unknown keys."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, col_(c)), col_(c))
