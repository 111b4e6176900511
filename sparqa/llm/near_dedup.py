"""MinHash near-duplicate detection by a multi-index Hamming join.

Signature: 66 MinHash values of 14 bits of a document's shingle set, cut into
11 chunks of 6.  By pigeonhole two signatures that differ in at most 21 values
agree in some chunk up to one value, so every chunk is indexed under its 6
"one value left out" variants (66 keys a set): all pairs within distance 21
meet under a key, and most pairs far beyond it.  At similarity 0.8 a chunk
fails with probability 0.345, all eleven with 8e-6.

Work is shared between *classes* (documents with equal shingle sets), never
between single copies.  Candidates are confirmed on the full shingle sets.  A
bucket of more than two classes is not expanded into all its pairs.  Its
members are confirmed against the bucket's two extremes; members outside the
bucket's largest component then against a random member of that component (a
different one in each of the buckets they share).  What is still apart is
compared by signature in buckets of up to ``SMALL`` classes (with 189 further
values that are not indexed); the classes of larger buckets go through an exact
prefix-filtered set join, the rarest shingles first.  No link between components
is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, finished, lookup, stored
from .words import SPACE_WORDS, batch_words, mix, shingles

CHUNKS, WIDTH = 11, 6
VALUES = CHUNKS * WIDTH
#: values only used to estimate the similarity of two classes
FINE = 189
#: MinHash values are packed into longs, each below a guard bit: (bits, values a long)
INDEXED, SKETCHED = (14, 4), (8, 7)
#: pairs whose signatures differ in more of the 255 values are not confirmed: at
#: similarity 0.8 the difference has mean 51 and deviation 6.4, so this is beyond 4.5 deviations
MAX_DISTANCE = 80
#: classes of a bucket that are compared one with another
SMALL = 64
_SALT = mix(np.arange(1, VALUES + FINE + 1, dtype=np.uint64)) | np.uint64(1)


def _longs(values: int, packing: tuple) -> int:
    return -(-values // packing[1])


LANES, FINE_LANES = _longs(VALUES, INDEXED), _longs(FINE, SKETCHED)


def _signature_rows(g: np.ndarray, off: np.ndarray):
    """Per row: distinct shingles, two set hashes, indexed and sketched values
    (packed, rows x longs)."""
    rows = len(off) - 1
    n, f1, f2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    indexed, sketched = np.zeros((rows, LANES), np.uint64), np.zeros((rows, FINE_LANES), np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        a, b = mix(g ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix(g + np.uint64(0x632BE59BD9B4E019))
        for i in full:
            s = slice(off[i], off[i + 1])
            distinct, first = np.unique(g[s], return_index=True)
            n[i] = len(distinct)
            f1[i], f2[i] = a[s][first].sum(), b[s][first].sum()
        at = off[full]  # rows between are empty, so each run ends where the next begins
        for j in range(VALUES + FINE):
            value = mix(np.minimum.reduceat(g * _SALT[j], at))
            k, out, (bits, many) = (j, indexed, INDEXED) if j < VALUES else (j - VALUES, sketched, SKETCHED)
            out[full, k // many] |= (value & np.uint64((1 << bits) - 1)) << np.uint64((bits + 1) * (k % many))
    return n, f1, f2, indexed, sketched


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def _prints(shingle_words: int):
    def run(batches):
        for batch in batches:
            for lo, hi, w in batch_words(batch.column(1), SPACE_WORDS, lower=True):
                g, off = shingles(w, shingle_words)
                n, f1, f2, indexed, sketched = _signature_rows(g, off)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in (0, 2, 3)], pa.array(n), pa.array(f1.view(np.int64)),
                     pa.array(f2.view(np.int64)), _lists(indexed), _lists(sketched)], ["doc_id", "k1", "k2", "n_shingles", "f1", "f2", "sig", "fine"])
    return run


def _keys(batches):
    """Index keys of signatures: (cid, keys)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        bits, many = INDEXED
        shift = np.arange(many, dtype=np.uint64) * np.uint64(bits + 1)
        values = (flat.reshape(-1, LANES, 1) >> shift) & np.uint64((1 << bits) - 1)
        chunk = values.reshape(-1, LANES * many)[:, :VALUES].reshape(-1, CHUNKS, WIDTH)
        out = np.empty((len(chunk), CHUNKS, WIDTH), np.uint64)
        for leave in range(WIDTH):
            kept = [j for j in range(WIDTH) if j != leave]
            head = chunk[:, :, kept[0]]
            for j in kept[1:4]:
                head = (head << np.uint64(bits)) | chunk[:, :, j]
            place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(leave)
            out[:, :, leave] = mix(mix(head) + (chunk[:, :, kept[4]] << np.uint64(8)) + place)
        keys = _lists(out.reshape(len(out), VALUES))
        yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["cid", "keys"])


def _sets(shingle_words: int):
    def run(batches):
        """(cid, text) -> (cid, members): the set's distinct shingles, sorted."""
        for batch in batches:
            for lo, hi, w in batch_words(batch.column(1), SPACE_WORDS, lower=True):
                g, off = shingles(w, shingle_words)
                sets = [np.unique(g[off[i]: off[i + 1]]).view(np.int64) for i in range(len(off) - 1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["cid", "members"])
    return run


def _confirm(percent: int):
    def run(batches):
        """(a, b, members_a, members_b) -> linked pairs (a, b)."""
        for batch in batches:
            ends = [batch.column(c).offsets.to_numpy() for c in (2, 3)]
            data = [batch.column(c).values.to_numpy() for c in (2, 3)]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (data[c][ends[c][i]: ends[c][i + 1]] for c in (0, 1))
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges the two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                union = len(both) - common
                keep[i] = union > 0 and 100 * common >= percent * union
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def _differences(x: str, y: str, packing: tuple, values: int):
    """Values in which two packed columns differ: adding all ones to a
    difference that is not zero carries into its guard bit."""
    bits, many = packing
    ones = F.lit(sum(((1 << bits) - 1) << (bits + 1) * j for j in range(many)))
    guard = F.lit(sum(1 << bits << (bits + 1) * j for j in range(many)))
    return sum((F.bit_count((F.col(x)[i].bitwiseXOR(F.col(y)[i]) + ones).bitwiseAND(guard)) for i in range(_longs(values, packing))), F.lit(0))


def _close(x: str, y: str, percent: int, max_distance: int | None):
    """The sizes allow the similarity, and the signatures are near enough."""
    nx, ny = F.col(f"n_{x}"), F.col(f"n_{y}")
    sized = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    if max_distance is None:
        return sized
    return sized & (_differences(f"sig_{x}", f"sig_{y}", INDEXED, VALUES) + _differences(f"fine_{x}", f"fine_{y}", SKETCHED, FINE) <= max_distance)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, max_distance: int | None = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id: long, text): (doc_id, n_shingles,
    component_id, kept).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; sets of
    distinct ``shingle_words``-word shingles (a shorter text: its whole
    sequence) are linked at Jaccard ``percent`` / 100 or more.  ``component_id``
    is the smallest doc_id reachable.

    Null and blank texts have no shingles and are linked with nothing (their
    component is themselves).  Null doc_ids are ignored when the smallest is
    taken; a component without any doc_id has a null ``component_id`` and keeps
    nothing (rows without a doc_id are linked like any other).  Rows with the same doc_id are all judged by their own text, so
    several may be kept.  Other columns of ``docs`` are not read.  An empty
    table gives an empty result.

    ``max_distance`` bounds the signature difference of pairs that are
    confirmed after the first pass; None confirms all that meet under a key."""
    def build():
        found = stored(_components(docs, shingle_words, percent, max_distance), "found")
        linked = found.where("n_shingles > 0")
        lowest = stored(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "lowest")
        linked = lookup(linked, lowest, ["component"], "n", found.count())
        alone = found.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
        names = ["doc_id", "n_shingles", "component_id"]
        return linked.select(*names).unionByName(alone.select(*names)).withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return finished(docs.sparkSession, "near_duplicates", build)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): (k1, k2) identify the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))


def _components(docs: DataFrame, shingle_words: int, percent: int, max_distance: int | None) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component): a row per row of ``docs``; the
    component is null for empty sets, which are linked with nothing."""
    prints = stored(
        _keyed(docs).mapInArrow(_prints(shingle_words), "doc_id long, k1 long, k2 long, n_shingles long, f1 long, f2 long, sig array<long>, fine array<long>"),
        "prints")
    full = prints.where("n_shingles > 0")
    # one row's text stands for its class
    sample = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k1", "k2")).alias("sample")
    classes = stored(
        full.groupBy("f1", "f2", "n_shingles", "sig", "fine").agg(sample, F.count(F.lit(1)).alias("n_rows"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = (classes.select("cid", "sig").mapInArrow(_keys, "cid long, keys array<long>")
            .select("cid", F.explode("keys").alias("key")))
    buckets = stored(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("a"), F.max("cid").alias("b"))
        .where("n > 1"), "buckets")
    members = stored(
        keys.join(buckets.where("n > 2").select("key", "a", "b"), "key"), "members")
    sets = _members(docs, classes, buckets, members, shingle_words)
    sizes = classes.select("cid", "n_shingles")

    first = buckets.select("a", "b").unionByName(
        members.select(F.col("a").alias("a"), F.col("cid").alias("b"))).unionByName(
        members.select(F.col("cid").alias("a"), "b")).where("a <> b").distinct()
    tested = stored(_same_size(first, sizes, percent), "first_pairs")
    links = stored(_linked(tested, sets, percent), "first_links")
    for find in (_pivots, _across):
        labelled = members.select("key", "cid").join(components(links), F.col("cid") == F.col("node"), "left").select(
            "key", "cid", F.coalesce("component", "cid").alias("component"))
        found = find(stored(labelled, "bucket_labels"), classes, sets, percent, max_distance)
        fresh = stored(found.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "more_pairs")
        links = stored(links.unionByName(_linked(fresh, sets, percent)), "links")
        tested = tested.unionByName(fresh)
    label = components(links)

    named = classes.join(label, classes["cid"] == label["node"], "left").select(
        "f1", "f2", F.coalesce("component", "cid").alias("component"), "n_rows")
    names = ["doc_id", "k1", "k2", "n_shingles"]
    linked = lookup(full.select(*names, "f1", "f2"), stored(named, "named"), ["f1", "f2"], "n_rows", prints.count())
    return linked.select(*names, "component").unionByName(
        prints.where("n_shingles = 0").select(*names, F.lit(None).cast("long").alias("component")))


def _members(docs, classes, buckets, members, shingle_words) -> DataFrame:
    """(cid, members) of the classes that meet another one."""
    wanted = buckets.select(F.col("a").alias("cid")).unionByName(buckets.select(F.col("b").alias("cid"))).unionByName(
        members.select("cid")).distinct()
    wanted = classes.join(wanted, "cid", "left_semi").select("cid", "sample")
    rows = _keyed(docs).where("text is not null")
    same = [rows[c].eqNullSafe(wanted["sample"][c]) for c in ("doc_id", "k1", "k2")]
    texts = rows.join(wanted, same).select("cid", "text").dropDuplicates(["cid"])
    return stored(texts.mapInArrow(_sets(shingle_words), "cid long, members array<long>"), "sets")


def _same_size(pairs, sizes, percent) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    x = sizes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"))
    y = sizes.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"))
    return pairs.join(x, "a").join(y, "b").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def _linked(pairs, sets, percent) -> DataFrame:
    x = sets.select(F.col("cid").alias("a"), F.col("members").alias("members_a"))
    y = sets.select(F.col("cid").alias("b"), F.col("members").alias("members_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "members_a", "members_b").mapInArrow(
        _confirm(percent), "a long, b long")


def _mixed(labelled: DataFrame) -> DataFrame:
    """(key, top, pivot, size): buckets with members of several components,
    their largest component, a pseudo-random member of it and their size."""
    # the order of (cid xor key) differs from bucket to bucket
    per = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("cid").bitwiseXOR(F.xxhash64("key"))).alias("drawn"))
    largest = F.max(F.struct("n", "component", "drawn"))
    return per.groupBy("key").agg(largest.alias("t"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(
        "key", F.col("t.component").alias("top"), F.col("t.drawn").bitwiseXOR(F.xxhash64("key")).alias("pivot"), "size")


def _signed(rows: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, cid, ...) with the class's signature, as side ``name`` of a join."""
    out = rows.join(classes.select("cid", "sig", "fine", "n_shingles"), "cid")
    for c, to in (("cid", name), ("component", f"c{name}"), ("sig", f"sig_{name}"), ("fine", f"fine_{name}"), ("n_shingles", f"n_{name}")):
        out = out.withColumnRenamed(c, to)
    return out


def _pairs(close: DataFrame) -> DataFrame:
    return close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _pivots(labelled, classes, sets, percent, max_distance) -> DataFrame:
    """Each mixed bucket's members outside its largest component, paired with
    one member of that component (another one in each bucket they share)."""
    mixed = _mixed(labelled)
    outside = _signed(labelled.join(mixed.select("key", "top"), "key").where("component <> top").drop("top"), classes, "x")
    pivot = _signed(mixed.select("key", F.col("pivot").alias("cid")), classes, "y")
    return _pairs(outside.join(pivot, (outside["key"] == pivot["key"]) & _close("x", "y", percent, max_distance)))


def _across(labelled, classes, sets, percent, max_distance) -> DataFrame:
    """All pairs of one bucket in different components that may be linked.  In
    buckets of up to SMALL classes members are compared by signature; the
    classes of larger mixed buckets go through :func:`_prefix_pairs`."""
    mixed = stored(_mixed(labelled), "mixed")
    here = labelled.join(mixed.where(F.col("size") <= SMALL).select("key", "top"), "key")
    outside = _signed(here.where("component <> top"), classes, "x").drop("top")
    others = _signed(here, classes, "y")
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("top")) | (F.col("x") < F.col("y")))
    few = _pairs(outside.join(others, (outside["key"] == others["key"]) & apart & _close("x", "y", percent, max_distance)))
    many = labelled.join(mixed.where(F.col("size") > SMALL).select("key"), "key", "left_semi").select("cid", "component").distinct()
    return few.unionByName(_prefix_pairs(stored(many, "crowded").join(sets, "cid"), percent)).distinct()


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``rows`` (cid, component, members) in different components that
    may be linked, by an exact prefix-filtered set join.

    With all sets in one order of shingles, the rarest first, linked sets share
    one of their first n - ceil(percent/100 n) + 1 shingles.  Shingles of a
    single set match nothing, they only push the others back; so a set of which
    a fifth is its own has no prefix left to match.  For the first common
    shingle at places i and j, at most n - i of one and m - j of the other are
    common; pairs whose bounds are too low are left out."""
    rows = rows.select("cid", "component", F.size("members").cast("long").alias("n"), "members")
    prefix = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    counts = stored(rows.select("cid", F.explode("members").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("cid").alias("cid")), "counts")
    own = counts.where("df = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("own"))
    left = rows.join(own, "cid", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") < prefix)
    tokens = left.select("cid", "component", "n", "own", F.explode("members").alias("g"))
    ordered = tokens.join(counts.where("df > 1").select("g", "df"), "g").groupBy("cid", "component", "n", "own").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    ordered = ordered.withColumn("s", F.slice("s", F.lit(1), (prefix - F.col("own")).cast("int")))
    probe = stored(ordered.select("cid", "component", "n", "own", F.posexplode("s").alias("at", "t")).select(
        "cid", "component", "n", (F.col("own") + F.col("at")).alias("at"), F.col("t.g").alias("g")), "prefixes")
    x, y = (probe.select("g", *[F.col(c).alias(f"{c}_{side}") for c in ("cid", "component", "n", "at")]) for side in ("x", "y"))

    def enough(p, q):  # common <= n_p - at_p
        return 100 * (F.col(f"n_{p}") - F.col(f"at_{p}")) >= percent * (F.col(f"n_{q}") + F.col(f"at_{p}"))

    met = x.join(y, (x["g"] == y["g"]) & (F.col("cid_x") < F.col("cid_y")) & (F.col("component_x") != F.col("component_y")) & enough("x", "y") & enough("y", "x"))
    return met.select(F.col("cid_x").alias("a"), F.col("cid_y").alias("b")).distinct()


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80, max_distance: int | None = MAX_DISTANCE) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``:
    that of the smallest doc_id (rows without one come last), of several such
    rows one with the smallest text hash.  All rows without words are kept."""
    def build():
        found = _components(docs, shingle_words, percent, max_distance)
        lead = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k1", "k2")).alias("lead")
        leads = found.where("n_shingles > 0").groupBy("component").agg(lead).select(
            *[F.col("lead")[c].alias(f"__lead_{c}") for c in ("doc_id", "k1", "k2")])
        text = F.col("text").cast("string")
        rows = docs.withColumns({"__doc_id": F.col("doc_id").cast("long"), "__k1": F.xxhash64(F.lit(1), text), "__k2": F.xxhash64(F.lit(2), text)})
        words = F.rlike(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
        same = [F.col(f"__{c}").eqNullSafe(F.col(f"__lead_{c}")) for c in ("doc_id", "k1", "k2")]
        # a row leads its own group only: its id and text are those of the lead
        kept = rows.where(words).join(leads, same, "left_semi").dropDuplicates(["__doc_id", "__k1", "__k2"])
        return kept.unionByName(rows.where(~words)).select(*docs.columns)
    return finished(docs.sparkSession, "keep_first", build)
