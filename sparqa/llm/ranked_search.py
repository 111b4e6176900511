"""Ranked lexical search over document FP-trees.

The query items' terms are a restricted vocabulary.  A document's restricted
vector - (term, tf) by descending document frequency - is a path; documents
with equal prefixes share it.  Every scan task packs its documents into trees
of bounded size: single-child chains are one node, neighbouring subtrees of few
documents share a leaf.  A node knows the largest tf of every term and the
smallest length norm m below it, which bound the score of every document in
its subtree.  For each item the tree is walked depth first, the child of the
highest bound first, and a subtree whose bound is under the item's k-th score
so far is left out.  Nothing but the k best of a task per item is shuffled.

Items are asked in blocks of bounded size against all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import finished, stored
from .words import ALNUM_WORDS, batch_words

#: bytes of distinct terms of a block of items: what a pass broadcasts (a larger item is a block of its own)
BLOCK_BYTES = 1 << 20
#: documents of a leaf and of a tree, cells (documents x terms) of a tree
LEAF, TREE_DOCS, TREE_CELLS = 32, 8192, 16 << 20
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item; rows with one item_id
    are one item."""
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).distinct()


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """(block, item_id, item, terms) and the number of blocks."""
    rows = _item_terms(items).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    rows = stored(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    size = rows.select("item", F.octet_length(F.concat_ws(" ", "terms")).alias("bytes"))
    blocks = max(1, -(-2 * (size.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    while True:  # hashing fills blocks unevenly: more of them until none but single items are too large
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        over = size.groupBy(block.alias("block")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") > BLOCK_BYTES) & (F.col("n") > 1))
        if over.isEmpty():
            return rows.withColumn("block", block), blocks
        blocks *= 2


def _hashes(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte length of each term, hashed as the documents' words are."""
    out, sizes = [], []
    for _, _, w in batch_words(pa.array(terms, pa.string()), ALNUM_WORDS):
        out.append(w.hash)
        sizes.append(w.end - w.start)
    return np.concatenate(out), np.concatenate(sizes)


def _vectors(hashes: np.ndarray, sizes: np.ndarray):
    """(doc_id, text) -> (doc_id, n, terms, tfs) of documents with a term;
    ``hashes`` ascending, a term is its place there."""
    def run(batches):
        for batch in batches:
            for lo, hi, w in batch_words(batch.column(1), ALNUM_WORDS, lower=True):
                n = w.count
                at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                hit = np.flatnonzero((hashes[at] == w.hash) & (sizes[at] == w.end - w.start))
                row = np.searchsorted(w.off, hit, side="right") - 1
                pair, tf = np.unique(row.astype(np.int64) * len(hashes) + at[hit], return_counts=True)
                ends = np.searchsorted(pair, np.arange(hi - lo + 1) * len(hashes)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pair % len(hashes)).astype(np.int32), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
    return run


def _frequencies(terms: int):
    def run(batches):
        """(terms) -> (term, df) of the whole partition."""
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])
    return run


class Tree:
    """FP-tree of documents: ``vectors`` are (ranks ascending, tfs) per
    document, ``m`` their norms.  ``order`` is the documents in path order; a
    node covers order[lo:hi] and has children, or none if it is a leaf."""

    def __init__(self, vectors: list, m: np.ndarray, width: int):
        paths = [r.astype(">u4").tobytes() for r, _ in vectors]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        ranks = [vectors[i][0] for i in self.order]
        self.m = m[self.order]
        self.tf = np.zeros((len(ranks), width), np.int32)
        for k, i in enumerate(self.order):
            self.tf[k, vectors[i][0]] = np.minimum(vectors[i][1], np.iinfo(np.int32).max)
        shared = np.full(len(ranks) + 1, -1, np.int64)  # terms shared with the document before
        for k in range(1, len(ranks)):
            x, y = ranks[k - 1], ranks[k]
            size = min(len(x), len(y))
            differs = np.flatnonzero(x[:size] != y[:size])
            shared[k] = differs[0] if len(differs) else size
        self.lo, self.hi, self.children = [0], [len(ranks)], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            for lo, hi in self._split(shared, self.lo[node], self.hi[node]):
                self.children[node].append(len(self.lo))
                if hi - lo > LEAF:
                    todo.append(len(self.lo))
                self.lo.append(lo)
                self.hi.append(hi)
                self.children.append([])
        nodes = len(self.lo)
        self.top, self.least = np.zeros((nodes, width), np.int32), np.zeros(nodes, np.int64)
        for k in range(nodes - 1, -1, -1):  # children come after their parent
            below = self.children[k]
            if below:
                self.top[k], self.least[k] = self.top[below].max(axis=0), self.least[below].min()
            else:
                self.top[k], self.least[k] = self.tf[self.lo[k]: self.hi[k]].max(axis=0), self.m[self.lo[k]: self.hi[k]].min()

    @staticmethod
    def _split(shared, lo, hi):
        """Ranges of a node's children: subtrees where paths part, the heaviest
        followed as long as it holds more than half; then neighbours of few
        documents together."""
        if hi - lo <= LEAF:
            return []
        parts, a, b = [], lo, hi
        left, right = [], []
        while True:
            inner = shared[a + 1: b]
            if not len(inner):
                parts = [(a, b)]
                break
            cuts = a + 1 + np.flatnonzero(inner == inner.min())
            edges = np.concatenate([[a], cuts, [b]])
            sizes = np.diff(edges)
            big = int(np.argmax(sizes))
            if 2 * sizes[big] <= hi - lo or sizes[big] <= LEAF:
                parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                break
            ranges = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            left += ranges[:big]
            right = ranges[big + 1:] + right
            a, b = ranges[big]
        out = []
        for x, y in left + parts + right:
            if out and y - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    def best(self, ranks: np.ndarray, weights: np.ndarray, found: tuple, ids: np.ndarray, none: np.ndarray, k: int) -> tuple:
        """The k best of ``found`` and this tree's documents for one item:
        (scores, ids, flags of missing ids), best first."""
        bounds = _scores(self.top[:, ranks], self.least, weights)
        todo = [0]
        while todo:
            node = todo.pop()
            full = len(found[0]) == k
            if not bounds[node] or full and bounds[node] < found[0][-1]:
                continue
            below = self.children[node]
            if below:
                todo += sorted(below, key=bounds.__getitem__)  # the highest is popped first
                continue
            lo, hi = self.lo[node], self.hi[node]
            scores = _scores(self.tf[lo:hi, ranks], self.m[lo:hi], weights)
            good = np.flatnonzero(scores >= max(found[0][-1], 1) if full else scores > 0)
            if len(good):
                at = self.order[lo:hi][good]
                found = _k_best(np.concatenate([found[0], scores[good]]), np.concatenate([found[1], ids[at]]), np.concatenate([found[2], none[at]]), k)
        return found


def _k_best(scores, ids, none, k):
    at = np.lexsort((ids, none, -scores))[:k]
    return scores[at], ids[at], none[at]


def _scores(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row the sum of w * ((10**9 * tf) div (1000 * tf + 20 * m)).  It
    grows with tf and falls with m, so maxima and a minimum give a bound."""
    tf = tf.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None])) @ weights


def _search(rank: np.ndarray, items: list, documents: int, words: int, k: int):
    """(doc_id, n, terms, tfs) -> (item, score, doc_id): the partition's k best
    of every item.  ``items`` are (item, ranks, weights); ``rank`` maps terms."""
    def run(batches):
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = [empty] * len(items)
        most = max(1, min(TREE_DOCS, TREE_CELLS // len(rank)))
        vectors, m, ids = [], [], []

        def ask():
            tree = Tree(vectors, np.array(m, np.int64), len(rank))
            none = np.array([i is None for i in ids], bool)
            known = np.array([0 if i is None else i for i in ids], np.int64)
            for j, (_, ranks, weights) in enumerate(items):
                best[j] = tree.best(ranks, weights, best[j], known, none, k)

        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            terms = rank[batch.column(2).values.to_numpy(zero_copy_only=False)]
            tfs = batch.column(3).values.to_numpy(zero_copy_only=False)
            norms = 50 + (50 * batch.column(1).to_numpy() * documents) // words
            for i, doc in enumerate(batch.column(0).to_pylist()):
                r = terms[ends[i]: ends[i + 1]]
                by = np.argsort(r)
                vectors.append((r[by], tfs[ends[i]: ends[i + 1]][by]))
                m.append(int(norms[i]))
                ids.append(doc)
                if len(ids) == most:
                    ask()
                    vectors, m, ids = [], [], []
        if ids:
            ask()
        for j, (item, _, _) in enumerate(items):
            scores, docs, none = best[j]
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), item)), pa.array(scores), pa.array(docs, mask=none)], ["item", "score", "doc_id"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its ``k``
    highest-scoring rows of ``docs`` (doc_id: long, text) with a score above 0,
    all if there are fewer; equal scores by ascending doc_id.

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``
    with A-Z lower-cased, told apart by a 64-bit hash and their length.  A
    term's weight is floor(1000 ln((2N+2)/(2df+1))), a score the sum over the
    item's distinct terms of w * ((10**9 tf) div (1000 tf + 20 m)), m being
    50 + ((50 n N) div L); N, L and df count all documents with a term.

    Null and blank texts have no terms: such documents are in no result and no
    count, such items have no rows.  Rows with one item_id are one item (their
    terms together; a null item_id is one too).  Every row of ``docs`` is a
    document of its own, repeated ones too; those without a doc_id come last
    among equals.  Other columns are not read.  Empty tables give an empty
    result."""
    return finished(docs.sparkSession, "ranked", lambda: _search_all(docs, items, k))


def _search_all(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    rows, blocks = _blocks(items)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        asked = rows.where(F.col("block") == b)
        block = asked.select("item", "terms").collect()  # bounded by BLOCK_BYTES
        if block:
            best = _search_block(texts, block, k)
            named = asked.select("item", "item_id")
            out = out.unionByName(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _search_block(texts: DataFrame, block: list, k: int) -> DataFrame:
    vocabulary = sorted({t for row in block for t in row["terms"]})
    hashes, sizes = _hashes(vocabulary)
    by = np.argsort(hashes)
    place = {vocabulary[j]: i for i, j in enumerate(by)}
    vectors = stored(texts.mapInArrow(_vectors(hashes[by], sizes[by]), "doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")
    documents, words = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    counts = vectors.select("terms").mapInArrow(_frequencies(len(by)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(by), np.int64)
    for term, n in counts.collect():  # one row per term of the block
        df[term] = n
    rank = np.empty(len(by), np.int64)
    rank[np.lexsort((np.arange(len(by)), -df))] = np.arange(len(by))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    asked = []
    for row in block:
        terms = np.array([place[t] for t in row["terms"] if df[place[t]]], np.int64)
        asked.append((row["item"], rank[terms], weight[terms]))
    best = vectors.where(F.size("terms") > 0).mapInArrow(_search(rank, asked, documents, words or 1, k), "item long, score long, doc_id long")
    best = stored(best, "task_best")
    # first the best of about sqrt(tasks) groups, so that no task gathers every task's rows of an item
    groups = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item", "__group").orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    best = best.withColumn("__group", F.pmod(F.xxhash64("doc_id", "score"), F.lit(groups)))
    best = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("__group")
