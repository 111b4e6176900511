"""Prefix trie of conversations by union-find over sorted neighbours.

Equal conversations are one *class*; classes are sorted by their sequences of
turn digests and dealt to range partitions.  Neighbours are linked by edges of
their longest common prefix (LCP).  Taking the edges in descending depth, every
union of components makes or extends the branching node at that depth: a
component of depth q united by an edge of depth p < q is a finished node whose
parent is at depth p, and the turns p+1..q are a chain of nodes with the same
members.

A partition cannot finish what touches its ends.  Its forest is contracted: each
finished subtree leaves only sums behind, and the few components still open go
on as items.  The items of up to ``FAN`` neighbouring partitions are then
united in the same way, until one partition is left.  An open component is never
taken apart again, so a round moves no more than about twice the depth of two
conversations per partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import finished, lookup, stored

#: partitions united in a round, turns of classes a partition should hold
FAN, PART_TURNS = 64, 400_000
#: conv_ids joined into one string before the strings of a class are hashed in order
ID_BLOCK = 2048
#: bytes of a turn's digest
D = 16
WORD = r"[^\x20\x09-\x0D]+"

_ITEM = "q long, conv_id long, n long, words long, repeats long, leaves long, edges long, size long, total long, seq binary, cum array<long>"
#: an open component: depth, smallest member, members, their words, words of classes after the
#: first beyond their LCP, leaves in finished subtrees, edges at depth q, turns and words of the
#: first class, common prefix and its running words (0 turns, 1 turn, ...)
ITEM = [x.split()[0] for x in _ITEM.split(", ")]
_OUT = f"node boolean, grp long, place long, lcp long, {_ITEM}, p long, key binary, parent_key binary, children long, chain array<long>"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, words) in order of turn): texts go no
    further than their digest and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation
    c - c % every, h being crc32(decimal c) % most: that one's first h turns
    (all if there are fewer, none if it is absent), then c's own after h."""
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most - 1).alias("__head"))
    c = F.col("conv_id")
    rows = turns.withColumns({"__base": c - c % every, "__h": (F.crc32(c.cast("string").cast("binary")) % most).cast("int")}).join(heads, "__base", "left")
    head = F.slice(F.coalesce("__head", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), F.col("__h"))
    own = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def classes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, conv_id, n, seq, cum) of the distinct sequences - key is the
    sequence's digest, cum its running words - and (key, conv_id) of all."""
    seq = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")
    rows = stored(turns.select("conv_id", F.unhex(seq).alias("seq"), F.transform("turns", lambda x: x["words"]).alias("words"))
                  .withColumn("key", F.unhex(F.md5("seq"))), "sequences")
    one = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("seq").alias("seq"), F.first("words").alias("words"))
    return one, rows.select("key", "conv_id")


def _digest(seq: bytes) -> bytes:
    return hashlib.md5(seq).digest()


def _lcp(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y)) // D * D
    if x[:size] == y[:size]:
        return size // D
    differs = np.frombuffer(x[:size], np.uint8) != np.frombuffer(y[:size], np.uint8)
    return int(np.argmax(differs)) // D


class Forest:
    """Union-find over a run of items in sorted order, edge i joining items
    i - 1 and i.  ``ends`` are the depths below which edges at the first and at
    the last component must wait (-1: nothing stands beyond)."""

    def __init__(self, items: list[dict], lcps: list[int], ends: tuple[int, int]):
        self.items, self.lcps = items, lcps
        count = len(items)
        self.parent = list(range(count))
        self.last = list(range(count))  # of a component's root, its first item: the last item
        self.left, self.right = [-1] * count, [-1] * count
        self.left[0], self.right[count - 1] = ends
        self.nodes: list[tuple[dict, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def close(self, x: dict, p: int) -> int:
        """A finished node with its parent at depth p; the leaves below it."""
        children = x["edges"] + (x["size"] > x["q"])
        x["leaves"] += children == 0
        self.nodes.append((x, p, children))
        return x["leaves"]

    def unite(self, waits: list) -> list[int]:
        """Unites along the edges in descending depth; the edges left over."""
        for i in sorted(range(1, len(self.items)), key=lambda i: -self.lcps[i]):
            l, a, b = self.lcps[i], self.find(i - 1), i
            if self.left[a] > l or self.right[self.last[b]] > l:
                # what is on the other side waits for this edge
                self.right[i - 1] = self.left[i] = l
                waits.append(i)
                continue
            x, y = self.items[a], self.items[b]
            edges = 1 + sum(z["edges"] for z in (x, y) if z["q"] == l)
            leaves = sum(z["leaves"] if z["q"] == l else self.close(z, l) for z in (x, y))
            self.items[a] = {
                "q": l, "conv_id": min(x["conv_id"], y["conv_id"]), "n": x["n"] + y["n"], "words": x["words"] + y["words"],
                "repeats": x["repeats"] + y["repeats"] + y["total"] - y["cum"][l], "leaves": leaves, "edges": edges,
                "size": x["size"], "total": x["total"], "seq": x["seq"], "cum": x["cum"]}
            self.parent[b] = a
            self.last[a] = self.last[b]
        return sorted(waits)


def _grow(final: bool):
    """(grp, place, lcp, item columns) in sorted order -> finished nodes and,
    unless ``final``, open items of each group."""
    def forest(grp, rows):
        lcps = [r["lcp"] if r["lcp"] is not None else -1 for r in rows]
        for i in range(1, len(rows)):
            if rows[i]["lcp"] is None:  # neighbours from different runs
                lcps[i] = _lcp(rows[i - 1]["seq"], rows[i]["seq"])
        items = [{c: r[c] for c in ITEM} for r in rows]
        # nothing is known beyond the ends: whatever shares a prefix with the first or last class may go on there
        f = Forest(items, lcps, (-1, -1) if final else (len(items[0]["seq"]) // D, len(items[-1]["seq"]) // D))
        f.unite(waits := [])
        open_at = [0, *sorted(waits)]
        if final:
            f.close(f.items[0], -1)
            open_at = []
        out = []
        for x, p, children in f.nodes:
            q = x["q"]
            # words of the prefix before each turn of the chain; the root has none
            chain = x["cum"][p:q] if p >= 0 else [0, *x["cum"][:q]]
            out.append({"node": True, "grp": grp, **{c: x[c] for c in ITEM if c not in ("seq", "cum")}, "p": p, "children": children, "chain": chain,
                        "key": _digest(x["seq"][: q * D]), "parent_key": _digest(x["seq"][: p * D]) if p >= 0 else None})
        for i in open_at:
            x = f.items[i]
            out.append({"node": False, "grp": grp, "place": i, "lcp": lcps[i] if i else None, **x, "seq": x["seq"][: x["q"] * D], "cum": x["cum"][: x["q"] + 1]})
        return out

    def run(batches):
        grp, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["grp"] != grp:
                    yield from _batches(forest(grp, rows))
                    rows = []
                grp = r["grp"]
                rows.append(r)
        if rows:
            yield from _batches(forest(grp, rows))
    return run


def _schema():
    of = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], of[c.split()[1]]) for c in _OUT.split(", ")])


def _batches(rows: list[dict], size: int = 4096):
    schema = _schema()
    for lo in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[lo: lo + size], schema)


def _items(batches):
    """(grp, conv_id, n, seq, words) in sorted order -> single-class items."""
    before = (None, b"")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            size, cum = len(r["seq"]) // D, [0, *np.cumsum(np.array(r["words"], np.int64)).tolist()]
            lcp = _lcp(before[1], r["seq"]) if before[0] == r["grp"] else None
            before = (r["grp"], r["seq"])
            out.append({"node": False, "grp": r["grp"], "place": 0, "lcp": lcp, "q": size, "conv_id": r["conv_id"], "n": r["n"], "words": r["n"] * cum[size],
                        "repeats": 0, "leaves": 0, "edges": 0, "size": size, "total": cum[size], "seq": r["seq"], "cum": cum})
        yield from _batches(out)


def _member_hashes(members: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of each class's conv_ids, ascending and joined by
    commas.  Ids are sorted over range partitions, joined to strings of up to
    ``ID_BLOCK`` ids, and only the strings of a class meet, in order, to be
    streamed into the hash, which has to be computed in one go."""
    def join(batches):
        key, first, ids = None, None, []
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == ID_BLOCK):
                    out.append((key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first = k, c
                ids.append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([",".join(ids)])], ["key", "first", "ids"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "sha"])

    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = members.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return blocks.repartition(parts, "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "key binary, sha string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node of the prefix trie of ``turns`` (conv_id, turns: array of
    (digest, words)): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, from the empty one (depth
    0); its members are the conversations that start with it.  ``n_leaves``
    counts nodes without children in its subtree (itself included),
    ``saved_tokens`` sums (n_convs - 1) * words of the last turn over the
    subtree, ``ends_sha256`` hashes the members that end there.  Turns are the
    same if their 128-bit digests are.  A conversation without turns ends at
    the root; without conversations there are no nodes.  A conversation is one
    row of 24 bytes a turn."""
    return finished(turns.sparkSession, "prefix_trie", lambda: _prefix_trie(turns))


def _prefix_trie(turns: DataFrame) -> DataFrame:
    one, members = classes(turns)
    one = stored(one, "classes")
    total = one.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    spark = turns.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TURNS)) if total else 1
    ordered = one.select("conv_id", "n", "seq", "words").repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    ordered = ordered.withColumn("grp", F.spark_partition_id().cast("long")).select("grp", "conv_id", "n", "seq", "words")
    # a partition is one sorted run; where its forest is grown, its rows are still together
    grown = stored(ordered.mapInArrow(_items, _OUT).mapInArrow(_grow(False), _OUT), "forests")
    found = [grown]
    parts = (grown.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        last = parts <= FAN
        groups = -(-parts // FAN)
        items = grown.where(~F.col("node")).withColumns({"old": F.col("grp"), "grp": F.floor(F.col("grp") / FAN).cast("long")})
        met = items.repartition(groups, "grp").sortWithinPartitions("grp", "old", "place").drop("old")
        grown = stored(met.mapInArrow(_grow(last), _OUT), "forests")
        found.append(grown)
        parts = groups
        if last:
            break
    nodes = found[0].where("node")
    for more in found[1:]:
        nodes = nodes.unionByName(more.where("node"))
    nodes = stored(nodes.join(_member_hashes(members), "key", "left"), "nodes")
    parents = nodes.where("children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv"), "children")
    linked = lookup(nodes.select("parent_key", "conv_id", "q", "p", "n", F.col("children").alias("own_children"), "leaves", "words", "total", "repeats", "chain", "size", "sha"),
                    parents, ["parent_key"], "children", nodes.count())
    rows = linked.select("*", F.posexplode("chain").alias("at", "before"))
    depth, bottom = F.col("p") + 1 + F.col("at"), F.col("at") == F.col("q") - F.col("p") - 1
    nothing = F.sha2(F.lit(b""), 256)
    return rows.select(
        "conv_id", depth.alias("depth"), F.when(F.col("at") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("own_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("words") - F.col("total") - F.col("repeats") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(bottom & (F.col("size") == F.col("q")), F.col("sha")).otherwise(nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """:func:`prefix_trie` of the conversations (conv_id, turn, role, text)
    after :func:`rebuilt`.

    Turns are ordered by ``turn``, null first, equal ones by the digest of role
    and text; null roles and texts count as empty; repeated rows are turns of
    their own; rows without a conv_id belong to no conversation.  Other columns
    are not read."""
    return prefix_trie(rebuilt(sequences(conversations), every, most))
