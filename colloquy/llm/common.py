"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a run of anything but these six characters: blank, tab, line feed,
# vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
NOT_BLANK = r"[^\x20\x09-\x0D]"

# What may be broadcast: this many rows of together this many bytes.
BROADCAST_ROWS = 1 << 17
BROADCAST_BYTES = 16 << 20

# A key with more than this part of all rows is handled apart from the others.
# At most as many keys can have it, so the table of these keys may be broadcast.
HEAVY_PARTS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    spaced = reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit(" ")),
                    BLANKS[1:], text_of(text))
    return F.array_remove(F.split(spaced, " ", -1), "")


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, a null text counting as empty, as lowercase hex."""
    return F.sha2(F.encode(text_of(text), "UTF-8"), 256)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is within the bounds of what may be broadcast."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0))
                       if kind in ("string", "binary") else F.lit(8))
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return row["n"] <= rows and row["size"] <= BROADCAST_BYTES


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small enough; if not, the join
    shuffles both sides and adaptive execution splits its large partitions."""
    return F.broadcast(df) if fits_broadcast(df) else df


def join_classes(rows: DataFrame, classes: DataFrame, key: str, count: str,
                 total: int) -> DataFrame:
    """Inner join of ``rows`` with one row of ``classes`` for each ``key``.

    ``count`` says how many of the ``total`` rows have a key. Keys with over
    1/1024 of all rows are at most 1024 and are broadcast, so that their rows
    stay where they are; the others are shuffled. Both tables are read twice.
    """
    heavy = F.col(count) * HEAVY_PARTS > max(total, HEAVY_PARTS)
    hot = F.broadcast(classes.filter(heavy))
    rest = rows.join(F.broadcast(classes.filter(heavy).select(key)), key, "left_anti")
    return (rows.join(hot, key)
            .unionByName(rest.join(classes.filter(~heavy), key)))


def without(docs: DataFrame, dropped: DataFrame,
            keys: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows of ``docs`` whose keys are not among the rows of ``dropped``.

    ``keys`` names the columns of ``dropped`` and says how to work each out from
    a document. Documents may have columns of any name: they travel inside one
    struct. Keys are compared null-safely. Few dropped rows are broadcast and
    the texts stay where they are; many are joined by shuffling.
    """
    document = F.col("_document")
    inside = docs.select(F.struct("*").alias("_document"))
    gone = small_side(dropped.select(*[F.col(n).alias(f"_{n}") for n in keys]))
    same = [make(document).eqNullSafe(F.col(f"_{n}")) for n, make in keys.items()]
    return inside.join(gone, same, "left_anti").select("_document.*")
