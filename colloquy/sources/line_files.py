"""Text files as numbered lines, and tables of several files side by side.

Line files have no keys: line n of one belongs to line n of another. Files are read
in the byte ranges that Spark cuts them into; the lines of each range are counted, and
a line's number is the count of the files and ranges before it and its place within its
own. The files of a folder follow one another by name, as their writer has ordered them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colloquy.operators.ranking import small_side
from colloquy.session import staged


def numbered_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Lines of a text file, or of the files of a folder by name, as ``(line, name)`` from
    line 0 on. Lines end at line feeds; a last one may lack its own."""
    meta = "_metadata.file_"
    read = staged(spark.read.text(path, lineSep="\n").select(
        F.col(f"{meta}path").alias("file"), F.col(f"{meta}block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias(name)), "lines")
    # rows of a range are numbered in a row, as one task reads it
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (read.groupBy("file", "start")
              .agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
              .withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))
                          - F.col("first")).select("file", "start", "shift"))
    return (read.join(small_side(ranges), ["file", "start"])
            .select((F.col("row") + F.col("shift")).alias("line"), name))


def zipped(files: dict[str, DataFrame]) -> DataFrame:
    """Tables of :func:`numbered_lines` side by side, ``(line, *names)``. Files of unequal
    length fail the job."""
    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return (left.withColumn("_l", F.lit(True))
                .join(right.withColumn("_r", F.lit(True)), "line", "full")
                .withColumn("line", F.when(F.col("_l") & F.col("_r"), F.col("line")).otherwise(
                    F.raise_error(F.concat(F.lit("files of unequal length: line "), "line"))
                    .cast("bigint"))).drop("_l", "_r"))

    tables = [t.select("line", t.columns[1]) if t.columns[1] == n else
              t.withColumnRenamed(t.columns[1], n) for n, t in files.items()]
    return reduce(beside, tables)


def zip_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Line files by name, read and put side by side."""
    return zipped({name: numbered_lines(spark, path, name) for name, path in paths.items()})
