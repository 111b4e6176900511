"""CSV files with quoted line breaks, read by many tasks.

A file is read line by line in byte ranges.  Whether a line starts a record
depends on the number of quotes before it in the file, so quotes are counted by
range, the counts are summed over the ranges before (one row per range), and
within a range over the lines before.  A record that began in an earlier range
is put together from its lines.  Positions come from the same counts.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize


def csv_records(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """``(file, place, record)``: the records of the CSV files under ``path``
    (quotes doubled inside quoted cells), ``place`` counting from 0, the header,
    in each file.  Empty lines between records are skipped.  ``encoding`` is an
    ASCII-compatible one; a byte order mark is dropped.  An opened quote that is
    never closed makes the rest of its file one record."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), value.alias("value"))
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
    # stored: the numbering of lines must not change between reads
    lines = materialize(lines.withColumn("odd", odd))
    inside = Window.partitionBy("file", "range").orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    # one row per range from here on: the parity at its first line, ...
    ranges = lines.groupBy("file", "range").agg(F.sum("odd").alias("odds"))
    ranges = ranges.select("file", "range", F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("quotes"))
    marked = lines.join(ranges, ["file", "range"])
    opened = F.pmod(F.col("quotes") + F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)) == 1
    marked = marked.withColumn("first", ~opened).drop("quotes", "odd")
    blank = F.rtrim(F.col("value"), F.lit("\r")) == ""
    marked = materialize(marked.where(~(F.col("first") & blank)))
    # ... the records that begin before it and the last of them
    counts = marked.groupBy("file", "range").agg(F.count_if("first").alias("n"), F.max(F.when(F.col("first"), F.col("at"))).alias("latest"))
    counts = counts.select("file", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("placed"), F.max("latest").over(earlier).alias("carried"))
    known = marked.join(counts, ["file", "range"])
    known = known.select(
        "file", "at", "value", F.coalesce(F.max(F.when(F.col("first"), F.col("at"))).over(up_to), F.col("carried")).alias("start"),
        (F.col("placed") + F.sum(F.col("first").cast("long")).over(up_to) - 1).alias("place"))
    records = known.groupBy("file", "start", "place").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["value"]), "\n")
    joined = F.regexp_replace(F.rtrim(joined, F.lit("\r")), "^\ufeff", "")
    return records.select("file", "place", joined.alias("record"))


def read_csv(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """The rows of the CSV files under ``path``, which share one header, as
    string columns, with ``row_idx``: their position, file after file by name.
    Missing cells are null, cells beyond the header are left out."""
    records = materialize(csv_records(spark, path, encoding))
    head = records.where("place = 0").orderBy("file").limit(1).first()
    if head is None:
        return spark.createDataFrame([], "row_idx long")
    names = next(csv.reader(io.StringIO(head["record"])))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    # one row per file
    sizes = records.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = records.where("place > 0").join(sizes, "file")
    cells = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}).alias("c")
    index = [] if "row_idx" in names else [(F.col("base") + F.col("place") - 1).cast("long").alias("row_idx")]
    return rows.select(cells, *index, "base", "place").select("c.*", *(["row_idx"] if index else []))
