"""Written intermediate tables and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch, work_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: computed once, lineage cut, safe against lost executors, and later
    readers get column pruning."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, name: str, build) -> DataFrame:
    """The DataFrame that ``build()`` returns, written; the intermediate tables
    made on the way are dropped."""
    ensure_checkpoint_dir(spark)
    path = work_dir(spark, name)
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: keys that hold more than this part of all rows are looked up by broadcast
HOT_PART = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left joined with ``table`` (stored; unique ``keys``) by ``keys``.
    ``weight`` is a column of ``table``: how many rows have the key, or an
    upper bound of it, in all ``total``.  Keys with more than a thousandth of
    ``total`` - a thousand at most - are broadcast, so none of the
    others can fill a task of the shuffled join."""
    hot = table.where(F.col(weight) * HOT_PART > total).withColumn("__hot", F.lit(True))
    rest = table.where(F.col(weight) * HOT_PART <= total)
    tried = rows.join(F.broadcast(hot), keys, "left")
    more = [c for c in table.columns if c not in keys]
    found = tried.where("__hot").drop("__hot")
    missed = tried.where("__hot is null").drop("__hot", *more).join(rest, keys, "left")
    return found.unionByName(missed.select(*found.columns))


#: repeated keys that are broadcast; more are joined by a shuffle
BROADCAST_KEYS = 50_000


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... among the rows that agree in ``keys``
    (nulls agree).  Rows of a repeated key are numbered within each input
    partition and go on after those of the partitions before, so a key that a
    third of all rows share is not gathered in one task."""
    repeated = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(
        *[F.col(k).alias(f"__key_{k}") for k in keys]), "repeated")
    few = repeated.limit(BROADCAST_KEYS + 1).count()
    if not few:
        return df.withColumn(name, F.lit(1).cast("long"))
    known = F.broadcast(repeated) if few <= BROADCAST_KEYS else repeated
    rows = df.withColumn("__part", F.spark_partition_id())
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    alone = rows.join(known, same, "left_anti").drop("__part").withColumn(name, F.lit(1).cast("long"))
    many = rows.join(known, same, "left_semi")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(*[F.col(k).alias(f"__at_{k}") for k in keys], F.col("__part").alias("__at_part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    many = many.withColumn("__row", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(F.lit(1))))
    placed = many.join(counts, [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in [*keys]] + [F.col("__part") == F.col("__at_part")])
    return alone.unionByName(placed.withColumn(name, F.col("__before") + F.col("__row")).select(*alone.columns))


def _contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the smallest node each is connected to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _stars(batches):
    """(u, v) -> (node, label): the connected components of a task's edges, as
    stars around their smallest node.  Stars so far and the next block of edges
    are contracted together, so memory goes with the task's nodes."""
    u, v, waiting = [], [], 0
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        waiting += batch.num_rows
        if waiting >= BLOCK_EDGES:
            nodes, labels = _contract(np.concatenate(u), np.concatenate(v))
            u, v, waiting = [nodes], [labels], 0
    if u:
        nodes, labels = _contract(np.concatenate(u), np.concatenate(v))
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo: lo + (1 << 16)]), pa.array(labels[lo: lo + (1 << 16)])], ["node", "label"])


#: edges that a task contracts at a time
BLOCK_EDGES = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long; stored): (node,
    component), the component being its smallest node.

    A round deals the edges, in both directions, by their first node (hubs are
    split, small partitions joined, by rebalancing), contracts every task's
    edges to stars and goes on with the edges between labels that meet in a
    node.  A node that is not split meets all its neighbours, so the labels
    that are left are at most half the nodes.  Then labels are followed back."""
    e = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    steps = []
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).hint("rebalance", "u")
        stars = both.mapInArrow(_stars, "node long, label long")
        # a node has one label from each task that it was split over
        labels = stored(stars.groupBy("node").agg(F.min("label").alias("least"), F.collect_set("label").alias("labels")), "labels")
        steps.append(labels.select("node", "least"))
        met = labels.where(F.size("labels") > 1)
        if met.isEmpty():
            break
        met = met.select(F.explode("labels").alias("u"), F.col("least").alias("v")).where("u <> v")
        e = stored(met.distinct(), "edges")
    out = steps[0].select("node", F.col("least").alias("component"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("component"), "least"), "component", "left").select(
            "node", F.coalesce("least", "component").alias("component"))
    return out
