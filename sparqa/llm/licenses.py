"""Fuzzy search for short license notices.

A notice is a run of words in which each fuzzy part may contain a bounded
number of character errors; words that tell one license from another must be
exact.  A part that allows e errors is split into e + 1 seeds, one of which
survives any e errors (pigeonhole); texts are searched for the exact seeds, and
only the neighbourhoods of seed hits go to the ``regex`` library, whose
bounded-error matching verifies the edits.  It is asked for a match from every
place; of a notice's matches that overlap, the one of fewest errors is reported.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import ALNUM_WORDS, LOWER, column_bytes

#: fixed values: phrases and the labels they stand for
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: notices of the fuzzy search: label and parts (text, errors); parts of 0 errors tell
#: licenses apart and must be exact
NOTICES = (
    ("mit", (("under the ", 1), ("mit", 0), (" license", 2))),
    ("apache-2", (("apache license", 2), (" ", 0), ("version", 1), (" 2", 0))),
    ("cc-by-nc", (("licensed under ", 2), ("cc by nc", 0))),
    ("gpl-3", (("gnu general public license", 3), (" ", 0), ("version", 1), (" 3", 0))),
    ("gpl", (("gnu general public license", 3),)),
    ("lgpl", (("gnu lesser general public license", 3),)),
    ("bsd", (("redistribution and use in source and binary forms", 4),)),
    ("mpl-2", (("mozilla public license", 2), (" ", 0), ("version", 1), (" 2", 0))),
    ("all-rights-reserved", (("all rights reserved", 2),)),
)


def _seeds(text: str, errors: int) -> list[str]:
    n, k = len(text), errors + 1
    return [text[i * n // k: (i + 1) * n // k] for i in range(k)]


def _matches(anywhere, best, text: str) -> list[tuple[int, int, int]]:
    """(errors, start, end) of the matches that no overlapping one of fewer
    errors (or as many, and earlier) displaces."""
    every = []
    for m in anywhere.finditer(text, overlapped=True):
        m = best.match(text, m.start())
        every.append((sum(m.fuzzy_counts), m.start(), m.end()))
    starts, kept = [], []  # kept spans are disjoint: only the neighbours by start can overlap
    for errors, start, end in sorted(every):
        i = bisect.bisect(starts, start)
        if (i == 0 or kept[i - 1][2] <= start) and (i == len(kept) or end <= kept[i][1]):
            starts.insert(i, start)
            kept.insert(i, (errors, start, end))
    return kept


class Searcher:
    """Compiled notices.  ``find`` works on normalised text: words joined by
    one space, with a space at either end."""

    def __init__(self, notices=NOTICES):
        self.notices = []
        for label, parts in notices:
            body = "".join(f"(?:{regex.escape(t, literal_spaces=True)}){{e<={e}}}" if e else regex.escape(t, literal_spaces=True) for t, e in parts)
            whole = "".join(t for t, _ in parts)
            allowed = sum(e for _, e in parts)
            # the longest part with its seeds; every match holds one of them
            main, errors = max(parts, key=lambda p: len(p[0]) / (p[1] + 1))
            reach = len(whole) + allowed + 2
            # any match from each place, then the best one from there
            patterns = regex.compile(rf"(?<= ){body}(?= )"), regex.compile(rf"(?b)(?<= ){body}(?= )")
            self.notices.append((label, patterns, [s.encode() for s in _seeds(main, errors)], reach, len(whole), allowed))

    def find(self, norm: bytes) -> list[tuple[str, int, int, int]]:
        """(label, start, end, errors) of the matches, in characters of the text."""
        found = []
        for label, patterns, seeds, reach, _, _ in self.notices:
            spans = []
            for s in seeds:
                at = norm.find(s)
                while at >= 0:
                    spans.append((max(0, at - 4 * reach), at + len(s) + 4 * reach))  # a character has up to 4 bytes
                    at = norm.find(s, at + 1)
            spans.sort()
            lo = hi = -1
            merged = []
            for x, y in spans:
                if x > hi:
                    if hi >= 0:
                        merged.append((lo, hi))
                    lo, hi = x, y
                else:
                    hi = max(hi, y)
            if hi >= 0:
                merged.append((lo, hi))
            for lo, hi in merged:
                while lo and (norm[lo] & 0xC0) == 0x80:
                    lo -= 1
                while hi < len(norm) and (norm[hi] & 0xC0) == 0x80:
                    hi += 1
                before = len(norm[:lo].decode("utf-8"))
                for errors, start, end in _matches(*patterns, norm[lo:hi].decode("utf-8")):
                    found.append((label, before + start, before + end, errors))
        return sorted(set(found), key=lambda x: (x[1], x[2], x[0]))

    def similarity(self, label: str, errors: int) -> float:
        n = next(x[4] for x in self.notices if x[0] == label)
        return max(0.0, 1.0 - errors / n)


def normalise(raw: bytes) -> tuple[bytes, int]:
    words = raw.translate(_TO_SPACE).split()
    return b" " + b" ".join(words) + b" ", len(words)


_TO_SPACE = bytes(int(LOWER[b]) if ALNUM_WORDS[LOWER[b]] else 32 for b in range(256))


def _places(norm: bytes, phrase: str) -> list[int]:
    """Word positions at which the phrase's words stand consecutively."""
    needle, out, at, counted, word = f" {phrase} ".encode(), [], 0, 0, 0
    at = norm.find(needle)
    while at >= 0:
        word += norm.count(b" ", counted, at)
        counted = at
        out.append(word)
        at = norm.find(needle, at + 1)
    return out


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,last_word:long,errors:int,text:string>>"


def _scan(out_id: str, notices):
    def run(batches):
        searcher = Searcher(notices)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                norm, n = normalise(data[off[i]: off[i + 1]].tobytes())
                places = [(p, label) for phrase, label in PHRASES for p in _places(norm, phrase)]
                base = sorted({label for _, label in places})
                matches, best = [], 1.0 if places else 0.0
                found = searcher.find(norm)
                if found:
                    text = norm.decode("utf-8")
                    for label, lo, hi, errors in found:
                        first = text.count(" ", 0, lo) - 1
                        matches.append({"label": label, "first_word": first, "last_word": first + text.count(" ", lo, hi), "errors": errors, "text": text[lo:hi]})
                        best = max(best, searcher.similarity(label, errors))
                at = [p for p, _ in places]
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(base),
                             ",".join(sorted({*base, *(m["label"] for m in matches)})), best, matches))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], [out_id, *names])
    return run


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id: long, text): n_words; exact places
    of the fixed phrases (n_base, first_word, last_word, base_labels); labels
    of the exact and the fuzzy search together; score (1 for an exact phrase,
    else the best match's 1 - errors / length, 0 without any); matches (label,
    first and last word, errors, normalised text).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased.  Null and blank texts have no words and no labels; whole texts
    are searched whatever their length; repeated rows are answered one by one;
    other columns of ``docs`` are not read; an empty table gives an empty one."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        _scan("doc_id", notices), f"doc_id long, {OUT}")
