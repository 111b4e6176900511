"""Session helpers: building a session for local runs and tests, and cutting
lineage with tables written in the directory the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = "local[*]", shuffle_partitions: int | None = 8,
                  app_name: str = "sparqa", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "16g"
        conf["spark.ui.enabled"] = "false"
    # small but compute-heavy shuffles (regexes over whole texts) keep several
    # tasks instead of being coalesced into one
    conf.setdefault("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (local
    runs and tests) create a private directory for it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="sparqa-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: it is written as Parquet in the
    shared work folder and read back, so a lost executor forces no
    recomputation and readers keep column pruning and filter pushdown."""
    path = work_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# open scopes of intermediate data, innermost last
_SCOPES: list = []


@contextmanager
def tracked():
    """Notes the tables and folders that ``materialize``, ``bucketed_table``
    and ``work_dir`` make inside the block, for :func:`drop_tracked`."""
    scope: dict = {"tables": [], "dirs": []}
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)


def drop_tracked(spark: SparkSession, scope: dict) -> None:
    for table in scope["tables"]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in scope["dirs"]:
        delete_path(spark, path)
    scope["tables"].clear()
    scope["dirs"].clear()


@contextmanager
def scratch(spark: SparkSession):
    """Drops what is made inside the block when it ends.  Results that are
    lazily read from it must be written before."""
    with tracked() as scope:
        try:
            yield
        finally:
            drop_tracked(spark, scope)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition ``df`` by ``cols`` only when it arrives in fewer
    partitions than the cluster has cores (a small or single-file input);
    large inputs keep their scan partitioning and pay no shuffle."""
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*cols)
    return df


def bucketed_table(df: DataFrame, cols: list[str], buckets: int, name: str,
                   sort_cols: list[str] | None = None, clustered: bool = False) -> DataFrame:
    """Write ``df`` as a table bucketed by ``cols`` (parquet files under the
    shared work folder) and read it back.  Readers see its hash
    partitioning, so aggregations and joins keyed by ``cols`` (or a superset)
    need no exchange.  ``clustered``: ``df`` is hash-partitioned by ``cols``
    into ``buckets`` partitions already."""
    spark = df.sparkSession
    table = f"sparqa_{name}_{uuid.uuid4().hex[:12]}"
    # one writer per bucket: one file per bucket instead of one per task and bucket
    w = (df if clustered else df.repartition(buckets, *cols)).write.bucketBy(buckets, *cols)
    if sort_cols:
        w = w.sortBy(*sort_cols)
    w.option("path", work_dir(spark, name)).saveAsTable(table)
    track_table(table)
    return spark.table(table)


def track_table(table: str) -> None:
    """Note a catalog table for the open scope."""
    if _SCOPES:
        _SCOPES[-1]["tables"].append(table)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files, under the (shared) checkpoint
    directory of the session."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/work/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1]["dirs"].append(path)
    return path
