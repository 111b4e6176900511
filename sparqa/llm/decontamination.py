"""Benchmark decontamination by a distributed positional inverted index.

The documents are indexed in segments, blocks of whole documents of a bounded
size: for each benchmark term a segment holds the sorted positions of the term
(offsets compressed with zstandard), written as one row of a Parquet table.
A benchmark window is looked up from its rarest term in the whole corpus: that
term's positions, shifted by its offset in the window, are the candidates, and
each further term's positions, rarest first and shifted likewise, thin them
out.  What is left are exact phrase matches.  Proximity matches ask for the
three rarest terms of a window near one another, in any order.
"""

from __future__ import annotations

import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import ALNUM_WORDS, Words, batch_words, column_bytes

#: bytes of text of an index segment, and of benchmark text searched in one pass: a
#: pass's windows, which are broadcast, are ARRAYS times as large at most (tested)
SEGMENT_BYTES = 1 << 21
PASS_BYTES, ARRAYS = 2 << 20, 24
#: candidates that are intersected at a time
CANDIDATES = 1 << 19
NEAR = 2  # proximity: the three rarest terms within NEAR windows' lengths


class Windows:
    """Windows of a set of items.  ``vocabulary`` are their sorted term hashes,
    ``terms`` the items' words as places in it."""

    def __init__(self, items: list, window: int):
        self.window = window
        self.ids = [i for i, _ in items]
        col = pa.array([t for _, t in items], pa.large_string())
        data, off = column_bytes(col)
        w = Words(data, off, ALNUM_WORDS, lower=True)
        self.vocabulary, terms = np.unique(w.hash, return_inverse=True)
        self.terms = terms.astype(np.int64)
        n = w.count
        many = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        self.item = np.repeat(np.arange(len(n)), many)
        first = np.concatenate([[0], np.cumsum(many)])[:-1]
        self.inside = np.arange(many.sum()) - np.repeat(first, many)
        self.start = np.repeat(w.off[:-1], many) + self.inside
        self.length = np.minimum(np.repeat(n, many), window)

    def rank(self, vocabulary: np.ndarray, frequency: np.ndarray) -> None:
        """Turn to the terms of a larger vocabulary, and order each window's
        offsets from its rarest term on (-1: none)."""
        self.terms = np.searchsorted(vocabulary, self.vocabulary)[self.terms]
        at = np.minimum(self.start[:, None] + np.arange(self.window), max(len(self.terms) - 1, 0))
        inside = np.arange(self.window) < self.length[:, None]
        rarity = np.where(inside, frequency[self.terms[at]] if len(self.terms) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(rarity, axis=1, kind="stable")
        self.order[np.take_along_axis(~inside, self.order, 1)] = -1
        self.term = np.where(self.order >= 0, self.terms[np.minimum(self.start[:, None] + self.order, max(len(self.terms) - 1, 0))] if len(self.terms) else 0, -1)
        # proximity: the three rarest different terms (-1: none) and how often each is asked, once only;
        # a window of fewer different terms asks for each as often as it holds it
        other, rows, chosen = self.term >= 0, np.arange(len(self.term)), []
        for _ in range(3):
            found = np.where(other.any(1), self.term[rows, other.argmax(1)], -1)
            chosen.append(found)
            other &= self.term != found[:, None]
        few = chosen[2] < 0
        often = [np.where(few, (self.term == t[:, None]).sum(1) * (t >= 0), 1) for t in chosen]
        self.ask, of = np.unique(np.stack(chosen + often, 1).astype(np.int64), axis=0, return_inverse=True)
        asked = np.unique(np.stack([of.reshape(-1), self.item], 1), axis=0)
        self.ask_item = asked[:, 1].astype(np.int32)
        self.ask_off = np.searchsorted(asked[:, 0], np.arange(len(self.ask) + 1))
        # only what the search reads is broadcast, as narrow as it can be
        self.order = self.order.astype(np.int16 if self.window < 1 << 15 else np.int32)
        self.term, self.ask = self.term.astype(np.int32), self.ask.astype(np.int32)
        self.item, self.length = self.item.astype(np.int32), self.length.astype(np.int32)
        self.windows = len(self.start)
        del self.terms, self.inside, self.start, self.vocabulary


def _index(vocabulary):
    def run(batches):
        words = vocabulary.value
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, w in batch_words(batch.column(1), ALNUM_WORDS, lower=True, limit=SEGMENT_BYTES):
                place = np.minimum(np.searchsorted(words, w.hash), max(len(words) - 1, 0))
                known = np.flatnonzero(words[place] == w.hash) if len(words) else np.zeros(0, np.int64)
                term = place[known]
                order = np.argsort(term, kind="stable")
                terms, counts = np.unique(term, return_counts=True)
                gaps = np.diff(known[order], prepend=0).astype(np.int32)  # negative where a term begins
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                     pa.array([w.count.tolist()], pa.list_(pa.int32())),
                     pa.array([terms.tolist()], pa.list_(pa.int32())),
                     pa.array([counts.tolist()], pa.list_(pa.int32())),
                     pa.array([pack.compress(gaps.tobytes())], pa.binary())],
                    ["doc_ids", "doc_words", "terms", "counts", "postings"])
    return run


INDEX = "doc_ids array<long>, doc_words array<int>, terms array<int>, counts array<int>, postings binary"


class Segment:
    """An index segment, opened."""

    def __init__(self, doc_words, terms, counts, postings, size):
        self.off = np.concatenate([[0], np.cumsum(doc_words)]).astype(np.int64)
        gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(postings), np.int32)
        self.positions = np.cumsum(gaps, dtype=np.int64)
        self.begin = np.zeros(size + 1, np.int64)
        self.begin[np.asarray(terms, np.int64) + 1] = counts
        np.cumsum(self.begin, out=self.begin)
        self.at = np.full(int(self.off[-1]), -1, np.int64)
        self.at[self.positions] = np.repeat(np.asarray(terms, np.int64), counts)

    def doc(self, position):
        return np.searchsorted(self.off, position, side="right") - 1

    def candidates(self, rarest):
        """(which, position): the positions of each of the terms, in pieces."""
        many = self.begin[rarest + 1] - self.begin[rarest]
        edge, total = 0, np.cumsum(many)
        while edge < len(many):
            done = total[edge - 1] if edge else 0
            stop = max(int(np.searchsorted(total, done + CANDIDATES, side="right")), edge + 1)
            which = np.repeat(np.arange(edge, stop), many[edge:stop])
            if len(which):
                inner = np.arange(len(which)) - np.repeat(total[edge:stop] - many[edge:stop] - done, many[edge:stop])
                yield which, self.positions[self.begin[rarest[which]] + inner]
            edge = stop

    def phrases(self, w: Windows):
        """(window, position) of the exact occurrences, in pieces."""
        if not w.windows:
            return
        for win, pos in self.candidates(w.term[:, 0]):
            pos = pos - w.order[win, 0].astype(np.int64)
            fits = (pos >= 0) & (pos + w.length[win] <= len(self.at))
            win, pos = win[fits], pos[fits]
            for k in range(1, w.window):
                if not len(win):
                    break
                off, term = w.order[win, k].astype(np.int64), w.term[win, k]
                same = (off < 0) | (self.at[pos + np.maximum(off, 0)] == term)
                win, pos = win[same], pos[same]
            one = self.doc(pos) == self.doc(pos + w.length[win] - 1)
            yield win[one], pos[one]

    def near(self, w: Windows):
        """(item, doc) with the three rarest terms of any of the item's windows
        within NEAR windows' lengths of the rarest."""
        if not len(w.ask):
            return
        n, reach = len(self.at) + 1, NEAR * w.window
        keys = self.at[self.positions] * n + self.positions  # sorted by term, then position
        for ask, pos in self.candidates(w.ask[:, 0]):
            doc = self.doc(pos)
            lo, hi = np.maximum(pos - reach, self.off[doc]), np.minimum(pos + reach + 1, self.off[doc + 1])
            for k in (2, 1, 0):
                term, often = w.ask[ask, k].astype(np.int64), w.ask[ask, k + 3]
                ok = (term < 0) | (np.searchsorted(keys, term * n + hi) - np.searchsorted(keys, term * n + lo) >= often)
                ask, doc, lo, hi = ask[ok], doc[ok], lo[ok], hi[ok]
            for x, d in np.unique(np.stack([ask, doc], 1), axis=0).tolist():
                for item in w.ask_item[w.ask_off[x]: w.ask_off[x + 1]]:
                    yield item, d


def _search(windows, size, state):
    """One pass: segments with what earlier passes found -> the same with this
    pass's hits (packed bits over words; item ids by document)."""
    def run(batches):
        w = windows.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["doc_words"], row["terms"], row["counts"], row["postings"], size)
                n, docs = len(seg.at), len(row["doc_ids"])
                hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8))[:n].astype(bool) if state else np.zeros(n, bool)
                items = [set(x) for x in row["items"]] if state else [set() for _ in range(docs)]
                near = [set(x) for x in row["near"]] if state else [set() for _ in range(docs)]
                cover = np.zeros(n + 1, np.int64)
                for win, pos in seg.phrases(w):
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + w.length[win], -1)
                    for d, i in np.unique(np.stack([seg.doc(pos), w.item[win]]), axis=1).T:
                        items[d].add(str(w.ids[i]) if w.ids[i] is not None else "")
                hit |= np.cumsum(cover)[:n] > 0
                for item, d in seg.near(w):
                    i = w.ids[item]
                    near[d].add(str(i) if i is not None else "")
                row.update(hit=np.packbits(hit).tobytes(), items=[sorted(x) for x in items], near=[sorted(x) for x in near])
                yield pa.RecordBatch.from_pylist([row], schema=_STATE)
    return run


_STATE = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.int32())), ("postings", pa.binary()), ("hit", pa.binary()),
    ("items", pa.list_(pa.list_(pa.string()))), ("near", pa.list_(pa.list_(pa.string())))])


def _report(batches):
    """Found state -> a row per document."""
    for batch in batches:
        for row in batch.select(["doc_ids", "doc_words", "hit", "items", "near"]).to_pylist():
            count = np.asarray(row["doc_words"], np.int64)
            off = np.concatenate([[0], np.cumsum(count)])
            hit = np.unpackbits(np.frombuffer(row["hit"], np.uint8))[: off[-1]]
            total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
            n_hit = total[off[1:]] - total[off[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(count), pa.array(n_hit),
                 pa.array(row["items"], pa.list_(pa.string())), pa.array(row["near"], pa.list_(pa.string())),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in row["items"]])],
                ["doc_id", "n_words", "n_hit", "items", "near_items", "items_sha256"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id: long, text): doc_id, n_words, n_hit
    (words inside an occurrence of a window of an item), items (ids of items
    with occurring windows, as sorted strings), near_items (items with a
    proximity match of any window: its three rarest terms - fewer different ones
    as often as it holds them - within NEAR window lengths of the rarest),
    n_near, items_sha256, near_sha256, contaminated (n_hit > 0).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; an
    item of fewer words than ``window`` is one window.  ``benchmark`` (item_id,
    text) is the query set: it is searched in blocks of about PASS_BYTES of its
    text, one pass over the index each, whatever its size; only one block is
    broadcast at a time, and the benchmark's distinct terms (8 bytes each).  Null and blank texts have no words, items without
    words no windows; a null item_id counts as ``""``; equal items are each
    reported; repeated documents are answered one by one; other columns are not
    read; empty tables give an empty result, or no hits."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    queries = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // PASS_BYTES))

    def block(k: int) -> Windows:
        part = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        return Windows([(r[0], r[1] or "") for r in part.collect()], window)

    first = block(0)
    vocabulary = first.vocabulary
    for k in range(1, passes):
        vocabulary = np.union1d(vocabulary, block(k).vocabulary)
    index = stored(rows.mapInArrow(_index(sc.broadcast(vocabulary)), INDEX), "postings")
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    counts = counts.toArrow()  # two numbers per benchmark term
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[counts["term"].to_numpy()] = counts["n"].to_numpy()
    out = index
    for k in range(passes):
        w = block(k) if k else first
        w.rank(vocabulary, frequency)
        out = out.mapInArrow(_search(sc.broadcast(SimpleNamespace(**vars(w))), len(vocabulary), k > 0),
                             f"{INDEX}, hit binary, items array<array<string>>, near array<array<string>>")
        if passes > 1:
            out = stored(out, "found")
    return out.mapInArrow(_report, "doc_id long, n_words long, n_hit long, items array<string>, near_items array<string>, items_sha256 string").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "near_items", "items_sha256",
        F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
