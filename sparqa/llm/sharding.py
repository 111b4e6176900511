"""Global shuffle of documents into shards, in two external passes.

Pass 1 scatters rows uniformly into buckets of a size that fits in memory, by
a seeded hash.  Pass 2 puts each bucket in random order (``shuffle``, Spark's
seeded Fisher-Yates over an array) and writes it.  The written buckets, one
after the other, are one random permutation of all rows; it is cut into shards
of equal row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, stored

BUCKET_BYTES = 16 << 20
#: partitions that buckets are dealt to at most (a task then does several buckets, one at a time)
MOST_PARTITIONS = 20_000
#: neighbouring buckets whose offsets are summed together; buckets whose offsets are broadcast
GROUP, BROADCAST_BUCKETS = 1000, 100_000


def shuffled(docs: DataFrame, columns: list[str], seed: int, bucket_bytes: int, least_buckets: int) -> DataFrame:
    """``columns`` of ``docs`` in written, shuffled buckets: (bucket, place, columns...)."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(least_buckets, -(-int(size) // bucket_bytes))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # equal rows are numbered, so that they spread as well
    rows = numbered(docs.select(*columns).withColumns({"__text": text, "__id": F.col("doc_id").cast("string")}), ["__id", "__text"], "__number")
    draw = F.xxhash64(F.lit(seed), "__id", "__text", "__number")
    rows = rows.withColumns({"__bucket": F.pmod(draw, F.lit(buckets)).cast("int"), "__draw": draw})
    # buckets come in order, so what the seeded shuffle does to each does not depend on how rows arrive
    dealt = rows.repartition(min(buckets, MOST_PARTITIONS), "__bucket").sortWithinPartitions("__bucket")
    grouped = dealt.groupBy("__bucket").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__draw"), F.col("__number"), *columns))).alias("__rows"))
    out = grouped.select(F.col("__bucket"), F.posexplode(F.shuffle("__rows", seed)).alias("__place", "__row")).select(
        "__bucket", "__place", *[F.col("__row")[c].alias(c) for c in columns])
    return stored(out, "shuffled")


def _offsets(rows: DataFrame) -> DataFrame:
    """(bucket, rows before it, rows in all): sums within groups of neighbouring
    buckets, and over the groups (one row for GROUP buckets)."""
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__group", F.floor(F.col("__bucket") / GROUP))
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = counts.groupBy("__group").agg(F.sum("__n").alias("__in")).select(
        "__group", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__start"), F.sum("__in").over(whole).alias("__total"))
    inside = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(groups, "__group").select(
        "__bucket", (F.col("__start") + F.col("__inside")).alias("__before"), "__total")


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, other columns), with ``shard``
    (0..shards-1) and ``slot`` (0, 1, ... without gaps within the shard).

    Law: ``rows`` - shard row counts differ by one at most, whatever the keys,
    sources or texts are.  Repeated rows, null doc_ids and null texts are rows
    like any other; each row gets its own slot.  A row longer than a bucket
    makes its bucket larger by that row only.  The permutation depends on the
    seed, doc_ids and texts, not on how the input is laid out in files (rows that
    agree in doc_id and text may change places).  Columns of ``docs`` named shard or slot are
    replaced.  Empty input gives an empty result."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = shuffled(docs, columns, seed, bucket_bytes, shards)
    offsets = stored(_offsets(rows), "offsets")
    if offsets.count() <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    rows = rows.join(offsets, "__bucket").withColumn("__at", F.col("__before") + F.col("__place"))
    # shard s holds places ceil(s * total / shards) up to ceil((s + 1) * total / shards)
    rows = rows.withColumn("shard", F.expr(f"(__at * {shards}) div __total").cast("int"))
    first = F.expr(f"(shard * __total + {shards} - 1) div {shards}")
    return rows.withColumn("slot", F.col("__at") - first).select(*columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shards as Parquet folders ``shard=<s>`` under ``path``, each
    file in slot order.  Rows, nulls, repeats and clashing names are treated as
    by :func:`shard`; an existing ``path`` is an error; an empty table writes no
    shard."""
    out = shard(docs, shards, seed, bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
