"""Mixing sources to target weights by Poisson replication.

A source whose rows should be repeated ``rate`` times on average gets, for
each row, a Poisson(rate) count: the inverse of the distribution function at a
uniform number hashed from the seed, the row's doc_id and text, and its number
among equal rows.  Rows are exploded by their count and all copies are put in
one global random order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered

#: sources whose rates are broadcast; more are joined by a shuffle
BROADCAST_SOURCES = 2_000
HASH_BITS = 52


def uniform(*parts):
    """A number in [0, 1) from an md5 hash of ``parts`` (52 bits)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << HASH_BITS))


def rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0) -> DataFrame:
    """(source, n_rows, mean_rate): the mean repetitions that bring ``docs`` to
    the target weights.

    ``weights`` gives the share of the output for the sources it names; what
    is left to 1 is shared by all other sources in proportion to their rows (a
    null source counts as the source ``""``).  The output has ``epochs`` times
    the rows of the input on average.  A named source without rows has its
    share spread over the rest in the same way."""
    if epochs <= 0 or any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be shares that sum to at most 1, epochs positive")
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    named = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
    counts = counts.withColumn("weight", F.try_element_at(named, F.col("source")))
    all_rows, given, others = counts.agg(
        F.sum("n_rows"), F.sum("weight"), F.sum(F.when(F.col("weight").isNull(), F.col("n_rows")))).first()
    # without other sources the given weights share the whole
    scale = 1.0 if others or not given else 1.0 / given
    share = F.when(F.col("weight").isNotNull(), F.col("weight") * scale).otherwise(
        F.col("n_rows") * F.lit((1.0 - (given or 0.0)) / (others or 1)))
    return counts.select("source", "n_rows", (share * F.lit(float(epochs) * (all_rows or 0)) / F.col("n_rows")).alias("mean_rate"))


def _distribution(rate):
    """Array of the Poisson distribution function at 0, 1, 2, ... by the
    recursion p(k) = p(k-1) rate/k, up to mean + 12 deviations + 30, beyond
    which less than 1e-16 is left."""
    top = F.ceil(rate + 12 * F.sqrt(rate)).cast("int") + 30
    start = F.array(F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c")))
    steps = F.aggregate(
        F.sequence(F.lit(1), top), start,
        lambda acc, k: F.concat(acc, F.array(F.struct(
            (F.element_at(acc, -1)["p"] * rate / k).alias("p"),
            (F.element_at(acc, -1)["c"] + F.element_at(acc, -1)["p"] * rate / k).alias("c")))))
    return F.transform(steps, lambda x: x["c"])


def mix(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, any other columns), each repeated by
    its Poisson count, in a global random order, with added columns
    ``mean_rate``, ``n_copies``, ``copy`` (1..n_copies) and ``order_key``
    (a number in [0, 1); partitions are a hash split of it and sorted by it).

    The draws depend on the seed, doc_id, text and the row's number among rows
    that agree in doc_id, text and source (``numbered``), and on the source's
    rate, so rows without a doc_id and repeated rows are drawn and placed one by
    one.  A null doc_id or text hashes as ``""``, a null source counts as ``""``.  Added names that
    clash with columns of ``docs`` replace them.  An empty table stays empty.
    Rates above 600 are refused (exp(-rate) would lose digits)."""
    added = ["mean_rate", "n_copies", "copy", "order_key"]
    keep = [c for c in docs.columns if c not in added]
    table = rates(docs, weights, epochs)
    known = table.agg(F.count(F.lit(1)), F.max("mean_rate")).first()
    if known[1] is not None and known[1] > 600:
        raise ValueError(f"a source would be repeated {known[1]:.0f} times; raise its share of rows or lower its weight")
    table = table.select(F.col("source").alias("__source"), "mean_rate", _distribution(F.col("mean_rate")).alias("__cdf"))
    if known[0] <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(*keep).withColumns({"__source": F.coalesce(F.col("source"), F.lit("")), "__text": text, "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    rows = numbered(rows, ["__id", "__text", "__source"], "__number").join(table, "__source")
    drawn = [F.col("__id"), F.col("__text"), F.col("__number")]
    u = uniform(F.lit(seed), *drawn)
    # __u is bound first: a filter lambda would hash again for each element
    rows = rows.withColumn("__u", u).withColumn(
        "n_copies", F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))).cast("long"))
    rows = rows.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    rows = rows.withColumn("order_key", uniform(F.lit(seed + 1), *drawn, F.col("copy")))
    return rows.select(*keep, *added).repartition("order_key").sortWithinPartitions("order_key", "doc_id")
