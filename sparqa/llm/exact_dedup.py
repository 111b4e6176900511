"""Exact de-duplication by a tree-merge of sorted digest runs.

Every scan partition turns its rows into one run or several: digests of the
normalised texts, sorted, each digest once with its best row and its count.
Runs are merged in rounds, as in a binomial tree of arity ``FAN``: the runs
whose numbers agree but for the last bits meet, their entries are merged in
digest order and equal digests become one entry, at every level.  Digest space
is cut into ranges, each a tree of its own, so no task ever holds a whole run
of the upper levels.  Copies meet inside a partition first, so a text that a
third of all rows share has one entry a run.

An entry's key is verified: two texts are taken as equal only if their SHA-256,
an independent 64-bit hash and the length of the normalised text all agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import finished, lookup, stored

#: bits of the run number that one round removes
FAN_BITS = 4
#: entries of a run; a scan partition with more makes several runs
RUN_ROWS = 400_000
#: digest ranges at least; entry bytes a merge task should take
RANGES, ENTRY_BYTES, TASK_BYTES = 4096, 80, 64 << 20
SPACES = r"[\x20\x09-\x0D]"
_KEY = ["digest", "check", "size"]
_ENTRY = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("digest", pa.binary()), ("check", pa.int64()), ("size", pa.int64()),
                    ("chars", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])
_DDL = "range int, run long, digest binary, check long, size long, chars long, doc_id long, row long, n long"
#: the order of entries, the best row of a text first
_ORDER = [("digest", "ascending"), ("check", "ascending"), ("size", "ascending"), ("chars", "descending"), ("doc_id", "ascending"), ("row", "ascending")]


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, chars, digest, check, size): a row per row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"),
                       F.regexp_replace(text, SPACES, "").alias("__norm"))
    return norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", "chars", F.unhex(F.sha2("__norm", 256)).alias("digest"),
                       F.xxhash64("__norm").alias("check"), F.octet_length("__norm").cast("long").alias("size"))


def _merged(t: pa.Table) -> pa.Table:
    """A sorted table with one row, the first, per run and key; counts are summed."""
    rows = len(t)
    if rows < 2:
        return t
    differs = np.zeros(rows - 1, bool)
    for c in ("range", "run", *_KEY):
        col = t[c].combine_chunks()
        differs |= pc.not_equal(col.slice(1), col.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.flatnonzero(differs) + 1])
    out = t.take(pa.array(first))
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(np.add.reduceat(t["n"].to_numpy(), first)))


def _runs(ranges: int):
    """(row, doc_id, chars, digest, check, size) -> sorted runs of entries."""
    def run(batches):
        held, count, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, sort_keys=_ORDER))
            digest = t["digest"].combine_chunks()
            data = np.frombuffer(b"".join(x[:2] for x in digest.to_pylist()), ">u2").astype(np.int64)
            t = t.append_column("range", pa.array(((data * ranges) >> 16).astype(np.int32)))
            t = t.append_column("run", pa.array(np.full(len(t), part + (number << 32))))
            t = t.append_column("n", pa.array(np.ones(len(t), np.int64)))
            return _merged(t.select(_ENTRY.names).cast(_ENTRY))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= RUN_ROWS:
                yield from flush().to_batches(65_536)
                held, count, number = [], 0, number + 1
        if held:
            yield from flush().to_batches(65_536)
    return run


def _merge(batches):
    """Entries in (range, run, digest) order -> each run and key once.  The
    last entry of a batch waits for the next batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).cast(_ENTRY)
        t = _merged(pa.concat_tables([last, t]) if last is not None else t)
        last = t.slice(len(t) - 1)
        yield from t.slice(0, len(t) - 1).combine_chunks().to_batches()
    if last is not None:
        yield from last.combine_chunks().to_batches()


def best_rows(rows: DataFrame) -> DataFrame:
    """(digest, check, size, chars, doc_id, row, n) of the stored digest
    ``rows``: of each text the row with the most characters, then the smallest
    doc_id (none: last), then the smallest row, and the number of rows."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * ENTRY_BYTES // TASK_BYTES))
    ranges = min(max(RANGES, 4 * tasks), 1 << 16)
    entries = stored(rows.mapInArrow(_runs(ranges), _DDL), "runs")
    # runs are numbered by partition, second and later runs of a partition far beyond: dense numbers first
    most = entries.agg(F.max(F.shiftright("run", 32)), F.max(F.col("run").bitwiseAND(F.lit((1 << 32) - 1)))).first()
    width = (most[1] or 0) + 1
    entries = entries.withColumn("run", F.shiftright("run", 32) * width + F.col("run").bitwiseAND(F.lit((1 << 32) - 1)))
    runs = ((most[0] or 0) + 1) * width
    while True:
        # Spark's spilling sort of a task's runs is the multiway merge; _merge makes equal entries one
        order = ["range", "run", *_KEY, F.col("chars").desc(), F.col("doc_id").asc_nulls_last(), "row"]
        met = entries.withColumn("run", F.shiftright("run", FAN_BITS)).repartition(tasks, "range", "run").sortWithinPartitions(*order)
        entries = stored(met.mapInArrow(_merge, _DDL), "merged")
        runs = -(-runs // (1 << FAN_BITS))
        if runs == 1:
            return entries.drop("range", "run")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id: long, text): (doc_id, keep_id,
    group_size, kept, text_sha256).

    Texts are equal if they are identical without the characters
    ``[\\x20\\x09-\\x0D]``; the row with the most code points in the original
    text, then the smallest doc_id, stays (``keep_id`` is its doc_id);
    ``text_sha256`` is the normalised text's.  Null texts count as empty, and
    all texts without other characters are one group.  Rows without a doc_id
    come after those with one; of rows that agree in text length and doc_id
    the first read stays, so one row of a group is kept even if a doc_id
    occurs twice.  Other columns are not read.  An empty table gives an empty
    result."""
    return finished(docs.sparkSession, "exact_duplicates", lambda: _exact_duplicates(docs))


def _exact_duplicates(docs: DataFrame) -> DataFrame:
    rows = stored(digests(docs), "digests")
    best = best_rows(rows)
    groups = best.where("n > 1").select(*_KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    found = lookup(rows, groups, _KEY, "n", rows.count())
    alone = F.col("n").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    def build():
        # the join is by doc_id too, so the copies of a frequent text do not meet in one task
        best = best_rows(stored(digests(docs), "digests")).select(
            *[F.col(c).alias(f"__best_{c}") for c in (*_KEY, "chars", "doc_id")])
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        norm = F.regexp_replace(text, SPACES, "")
        keyed = docs.withColumns({"__digest": F.unhex(F.sha2(norm, 256)), "__check": F.xxhash64(norm), "__size": F.octet_length(norm).cast("long"),
                                  "__chars": F.length(text).cast("long"), "__doc_id": F.col("doc_id").cast("long")})
        same = [F.col(f"__{c}").eqNullSafe(F.col(f"__best_{c}")) for c in (*_KEY, "chars", "doc_id")]
        kept = keyed.join(best, same, "left_semi").dropDuplicates(["__digest", "__check", "__size"])
        return kept.select(*docs.columns)
    return finished(docs.sparkSession, "keep_one", build)
