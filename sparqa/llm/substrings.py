"""Repeated passages by sharded Aho-Corasick automata.

A window is a run of ``window`` words of one document.  Two equal windows have
the same minimiser (the smallest hash among their inner word runs), so windows
are first told apart by it: a *segment* is a run of neighbouring windows with
one minimiser.  A minimiser that occurs once rules out all its windows.  Equal
segments confirm their windows at once; where segments of one minimiser differ
(at the ends of shared passages), their windows are compared one by one.  Runs
of confirmed windows are the recurring passages.

The passages are compiled into automata, one for each shard (a bounded block of
documents together with the passages that occur in it), and the shard's
documents are streamed through their automaton, which locates every
occurrence.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import SPACE_WORDS, Words, batch_words, blocks, column_bytes, grams, range_hash

#: words of the runs that minimisers are chosen from
INNER = 8
#: bytes of documents of a shard, so words of an automaton's passages are bounded
SHARD_BYTES = 1 << 19


def _segments(w: Words, window: int):
    """(row, first window, windows, minimiser, content hash) of a block's
    segments, first window counted from its document's first word."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    inner = min(INNER, window)
    value = grams(w.hash, inner)
    place = np.arange(len(value))
    # leftmost smallest of window - inner + 1 neighbours, by doubling
    width, need = 1, window - inner + 1
    best, at = value, place
    while width < need:
        step = min(width, need - width)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        width += step
    row = np.repeat(np.arange(w.rows), w.count)
    start = np.flatnonzero(row[: n - window + 1] == row[window - 1:])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at, row = at[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(start)))
    lo = start[begin]
    return row[begin], lo - w.off[row[begin]], count, value[at[begin]], range_hash(w.hash, lo, lo + count + window - 1)


def _sha(words: Words, row: int, keep=None) -> str:
    lo, hi = words.off[row], words.off[row + 1]
    if keep is None:
        parts = words.data[words.start[lo]: words.end[hi - 1]].tobytes().split() if hi > lo else []
    else:
        parts = [words.text(i) for i in lo + np.flatnonzero(keep)]
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _digests(batches):
    """(k1, k2, doc_id, text) -> whole-text digests."""
    for batch in batches:
        for lo, hi, w in batch_words(batch.column(3), SPACE_WORDS):
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                + [pa.array(w.count), pa.array([_sha(w, r) for r in range(w.rows)])],
                ["k1", "k2", "doc_id", "n_words", "sha"])


def _anchors(window: int):
    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, w in batch_words(batch.column(3), SPACE_WORDS):
                row, first, count, anchor, content = _segments(w, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(k1[lo + row]), pa.array(k2[lo + row]),
                     pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["anchor", "content", "k1", "k2", "first", "n"])
    return run


def _windows(window: int):
    def run(batches):
        """(k1, k2, text, segments) -> a row for each window of the segments."""
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, w in batch_words(batch.column(2), SPACE_WORDS):
                g = grams(w.hash, window)
                for r in range(w.rows):
                    segs = batch.column(3)[lo + r].as_py()
                    n = np.array([s["n"] for s in segs])
                    at = np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in segs])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([s["anchor"] for s in segs], n)), pa.array(np.repeat([s["content"] for s in segs], n)),
                         pa.array(np.repeat([s["times"] for s in segs], n)), pa.array(g[w.off[r] + at].view(np.int64)),
                         pa.array(np.repeat(k1[lo + r], len(at))), pa.array(np.repeat(k2[lo + r], len(at))), pa.array(at.astype(np.int32))],
                        ["anchor", "content", "times", "win", "k1", "k2", "at"])
    return run


class Shard:
    """An automaton over a block of documents and the passages found in it."""

    def __init__(self, words: Words, ranges: list[np.ndarray], window: int):
        _, ids = np.unique(words.hash, return_inverse=True)
        self.words, self.ids = words, ids.tolist()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for r, own in enumerate(ranges):
            for first, end in _runs(own):
                lo = words.off[r] + first
                hi = words.off[r] + end + window - 1
                self.automaton.add_word(tuple(self.ids[lo:hi]), int(hi - lo))
        self.automaton.make_automaton()

    def covered(self, row: int) -> np.ndarray:
        lo, hi = self.words.off[row], self.words.off[row + 1]
        change = np.zeros(hi - lo + 1, np.int64)
        if len(self.automaton):
            for last, length in self.automaton.iter(tuple(self.ids[lo:hi])):
                change[last + 1 - length] += 1
                change[last + 1] -= 1
        return np.cumsum(change)[:-1] > 0


def _runs(ranges: np.ndarray):
    """Joined (first, end) of overlapping or touching window ranges (first, n)."""
    if not len(ranges):
        return
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    first, end = ranges[0, 0], ranges[0].sum()
    for a, n in ranges[1:]:
        if a > end:
            yield first, end
            first = a
        end = max(end, a + n)
    yield first, end


def _remove(window: int):
    def run(batches):
        """(doc_id, text, firsts, counts) -> (doc_id, n_words, n_removed, sha, text left)."""
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for lo, hi in blocks(off, SHARD_BYTES):
                part = off[lo: hi + 1]
                w = Words(data[part[0]: part[-1]], part - part[0], SPACE_WORDS)
                ranges = [np.array([batch.column(c)[lo + r].as_py() for c in (2, 3)], np.int64).T.reshape(-1, 2) for r in range(w.rows)]
                shard = Shard(w, ranges, window)
                gone = [shard.covered(r) for r in range(w.rows)]
                left = [b" ".join(w.text(i) for i in w.off[r] + np.flatnonzero(~gone[r])) for r in range(w.rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(w.count), pa.array([int(x.sum()) for x in gone], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array([x.decode("utf-8", "replace") for x in left], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def recurring(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(ranges, digests).  ranges (k1, k2, first, n): windows of the text with
    key (k1, k2) that start more than once in all.  digests (k1, k2, doc_id,
    n_words, sha, copies): a row per row of ``docs``."""
    digests = stored(docs.mapInArrow(_digests, "k1 long, k2 long, doc_id long, n_words long, sha string"), "digests")
    anchors = docs.mapInArrow(_anchors(window), "anchor long, content long, k1 long, k2 long, first int, n int")
    kinds = anchors.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("first").alias("first"), F.first("n").alias("n"))
    kinds = stored(kinds, "segments")
    whole = anchors.join(kinds.where("times > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("k1", "k2", "first", "n")
    # minimisers with different segments
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    apart = kinds.join(mixed, "anchor", "left_semi")
    wanted = apart.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "content", "times", "first", "n")).alias("segments"))
    one = digests.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(one, ["k1", "k2"])
    texts = docs.join(wanted, (docs["k1"] == wanted["k1"]) & (docs["k2"] == wanted["k2"]) & docs["doc_id"].eqNullSafe(wanted["doc_id"]))
    wins = stored(texts.select(docs["k1"], docs["k2"], "text", "segments").mapInArrow(
        _windows(window), "anchor long, content long, times long, win long, k1 long, k2 long, at int"), "windows")
    again = wins.groupBy("anchor", "win").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("anchor", "win")
    single = wins.where("times = 1").join(again, ["anchor", "win"], "left_semi").select("k1", "k2", F.col("at").alias("first"), F.lit(1).alias("n"))
    return whole.unionByName(single), digests


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row per row of ``docs`` (doc_id: long, text): doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space), kept_text
    (those words; null where the text is unchanged but for its spacing).

    Each word covered by a window of ``window`` words (``[^\\x20\\x09-\\x0D]+``)
    whose word sequence also starts anywhere else, in this or another document,
    is removed; all windows are judged on the input.  Null and blank texts have
    no words; texts of fewer words keep all; copies of a text lose every
    window, in all copies; repeated rows count as copies; other columns are not
    read; an empty table gives an empty result."""
    text = F.col("text").cast("string")
    docs = docs.select(F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ranges, digests = recurring(docs, window)
    copies = stored(digests.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")), "copies")
    # all windows of a text with copies recur, so ranges matter for single texts only
    single = copies.where("copies = 1").select("k1", "k2")
    ranges = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n")).alias("r")).join(single, ["k1", "k2"], "left_semi")
    ranges = stored(ranges.select("k1", "k2", F.col("r.first").alias("firsts"), F.col("r.n").alias("counts")), "ranges")
    removed = docs.join(ranges, ["k1", "k2"]).select("doc_id", "text", "firsts", "counts").mapInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same = digests.join(ranges.select("k1", "k2"), ["k1", "k2"], "left_anti").join(copies, ["k1", "k2"])
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    same = same.select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(all_gone, F.lit("")).alias("kept_text"))
    return removed.unionByName(same)
