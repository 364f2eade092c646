"""One JSON document read by many tasks.

A document is read in the byte ranges that Spark's text source cuts files into, in
pieces that end at a closing brace. Whether a place is inside a string, and how deep it
is, depends on all that stands before it; so each range first says what it does to
either state: whether it turns "inside a string" round, and how much deeper it
leads when it begins outside or inside of one. These effects are composed in file order,
a row per range, and give every range its state at the beginning. A second
reading marks where the objects of the wanted depth begin and end, and the pieces
of each object are put together. No task holds more than a batch of its range and
the objects that it puts together.

A range begins right after a closing brace, so no backslash reaches over its
border; and all marks of JSON are ASCII, so no letter of more bytes is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.session import staged

# Ranges up to this many are broadcast; one stands for maxPartitionBytes of a file.
BROADCAST_RANGES = 100_000
RANGE = ["file", "start"]
RANGE_DDL = ("file string, start bigint, bytes bigint, full bigint, pieces bigint, "
             "turned bigint, deeper0 bigint, deeper1 bigint")
PIECE_DDL = ("file string, start bigint, place bigint, ended bigint, head string, "
             "body string, closes boolean, inherits boolean, within int")
# A piece or several, of about so many bytes together, are looked at at once.
RUN_BYTES = 1 << 20
QUOTE, BACKSLASH, OPEN, CLOSE, OPEN_LIST, CLOSE_LIST = b'"\\{}[]'


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands before each closing brace, with its file and byte range."""
    meta = "_metadata.file_"
    return spark.read.text(path, lineSep="}").select(
        F.col(f"{meta}path").alias("file"), F.col(f"{meta}block_start").alias("start"),
        F.col(f"{meta}size").alias("full"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, range by range, and no more than ``RUN_BYTES`` at once but for
    single pieces."""
    if not batch.num_rows:
        return
    start = batch["start"].to_numpy()
    file = pc.dictionary_encode(batch["file"]).indices.to_numpy()
    part = np.cumsum(pc.binary_length(batch["value"]).to_numpy(), dtype=np.int64) // RUN_BYTES
    cuts = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0) | (np.diff(part) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def _marks(values: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text of pieces with their braces, where each ends, the parity of quotes up to
    each place, and how much deeper each place leads outside of strings."""
    texts = [t + b"}" for t in values.cast(pa.binary()).to_pylist()]
    ends = np.cumsum([len(t) for t in texts])
    text = b"".join(texts)
    data = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(data == QUOTE)
    plain = np.flatnonzero(data != BACKSLASH)
    # how far before a quote is the last place that is no backslash
    nearest = np.searchsorted(plain, quotes) - 1
    before = np.where(nearest >= 0, plain[nearest], -1) if len(plain) else quotes - quotes - 1
    turns = np.zeros(len(data), np.int8)
    turns[quotes[(quotes - before) % 2 == 1]] = 1
    parity = np.bitwise_xor.accumulate(turns)
    deeper = (((data == OPEN) | (data == OPEN_LIST)).astype(np.int8)
              - ((data == CLOSE) | (data == CLOSE_LIST)).astype(np.int8))
    return text, ends, parity, deeper


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a batch of a range does to either state."""
    for batch in batches:
        for run in _runs(batch):
            text, ends, parity, deeper = _marks(run["value"])
            outside = int(deeper[parity == 0].sum(dtype=np.int64))
            row = [run["file"][0].as_py(), run["start"][0].as_py(), len(text),
                   run["full"][0].as_py(), run.num_rows, int(parity[-1]), outside,
                   int(deeper.sum(dtype=np.int64)) - outside]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in row], [c.split()[0] for c in RANGE_DDL.split(", ")])


def ranges(found: DataFrame) -> DataFrame:
    """State at the beginning of each range ``(file, start, inside, depth)``."""
    numbered = found.mapInArrow(effects, RANGE_DDL).withColumn(
        "row", F.monotonically_increasing_id())  # batches of a range are in order
    batches = staged(numbered, "json-ranges")
    # a document ends with a brace, or with white space after it
    whole = batches.groupBy("file").agg(
        F.sum("bytes").alias("bytes"), F.first("full").alias("full"))
    before = Window.partitionBy("file").orderBy("start", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    states = (batches.withColumn("inside", F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2)
              .withColumn("deeper", F.when(F.col("inside") == 0, F.col("deeper0"))
                          .otherwise(F.col("deeper1")))
              .withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0))))
    last = states.groupBy("file").agg(
        F.max_by(F.struct((F.col("inside") + F.col("turned")) % 2,
                          F.col("depth") + F.col("deeper")), F.struct("start", "row")).alias("end"))
    # a brace that was put after white space at the end of the file leads one too high
    lacking = F.when(F.lower("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$"),
                     -F.col("end.col2")).otherwise(F.col("bytes") - F.col("full"))
    fine = ((F.col("end.col1") == 0) & (F.col("end.col2") == -lacking)
            & lacking.isin(0, 1))
    ended = whole.join(last, "file").select("file", F.when(fine, True).otherwise(
        F.raise_error(F.concat(F.lit("malformed document, which does not end: "), "file"))).alias("fine"))
    firsts = states.groupBy(*RANGE).agg(
        F.min_by(F.struct("inside", "depth"), "row").alias("state"))
    return (firsts.join(ended, "file").where("fine")
            .select(*RANGE, "state.inside", "state.depth"))


def _marker(depth: int):
    """Rows of pieces with what belongs before an object and what into it."""
    names = [c.split()[0] for c in PIECE_DDL.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, level, place, ended, within = None, 0, 0, 0, 0, -1
        for batch in batches:
            for run in _runs(batch):
                key = (run["file"][0].as_py(), run["start"][0].as_py())
                if key != here:
                    # whether a range begins within an object is known from its first
                    # border of one, or from the ranges before
                    here, place, ended, within = key, 0, 0, -1
                    inside, level = run["inside"][0].as_py(), run["depth"][0].as_py()
                text, ends, parity, deeper = _marks(run["value"])
                change = np.where((parity ^ inside) == 0, deeper, 0)
                levels = level + np.cumsum(change, dtype=np.int32)
                data = np.frombuffer(text, np.uint8)
                opens = np.flatnonzero((levels == depth) & (change == 1) & (data == OPEN))
                starts = np.concatenate([[0], ends[:-1]])
                shut = np.flatnonzero((levels == depth - 1) & (change == -1) & (data == CLOSE))
                border = np.concatenate([opens, shut])
                order = np.argsort(border)
                border, kind = border[order], (order < len(opens)).astype(np.int64)
                if within < 0 and len(kind):
                    within = 1 - int(kind[0])
                    known = np.searchsorted(ends, border[0], "right")
                else:
                    known = 0 if within >= 0 else len(ends)
                first = np.searchsorted(border, starts)
                state = np.concatenate([[within], kind])[first]
                opened = np.concatenate([opens, [len(data)]])[np.searchsorted(opens, starts)]
                cut = np.where(state == 1, starts, np.minimum(opened, ends))
                inherits = np.arange(len(ends)) < known
                cut[inherits] = ends[inherits]
                closes = np.isin(ends - 1, shut)
                number = ended + np.cumsum(closes) - closes
                rows = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[0]] * rows), pa.array([key[1]] * rows),
                    pa.array(place + np.arange(rows)), pa.array(number),
                    pa.array([text[a:b].decode() for a, b in zip(starts, cut)], pa.string()),
                    pa.array([text[a:b].decode() for a, b in zip(cut, ends)], pa.string()),
                    pa.array(closes), pa.array(inherits),
                    pa.array(np.full(rows, kind[-1] if len(kind) else -1, np.int32))], names)
                within = int(kind[-1]) if len(kind) else within
                inside, level = int(parity[-1]) ^ inside, int(levels[-1])
                place, ended = place + rows, ended + int(closes.sum())

    return work


def objects(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """Objects at a depth of each document ``(file, number, head, body)``, in order.

    ``head`` is what stands between the object before and this one. The last row of a
    file has what stands after all objects and no body.
    """
    found = pieces(spark, path)
    states = staged(ranges(found), "json-states")
    side = F.broadcast(states) if states.count() <= BROADCAST_RANGES else states
    read = found.join(side, RANGE)
    if side is states:
        read = read.sortWithinPartitions(*RANGE)
    marked = staged(read.select(*RANGE, "value", "inside", "depth")
                    .mapInArrow(_marker(depth), PIECE_DDL), "json-pieces")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = (marked.groupBy(*RANGE)
              .agg(F.count_if(F.col("closes")).alias("n"),
                   F.max_by("within", F.when(F.col("within") >= 0, F.col("place"))).alias("last"))
              .select(*RANGE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                      (F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(0)) == 1)
                      .alias("within_before")))
    counts = F.broadcast(counts) if side is not states else counts
    ordered = F.array_sort(F.collect_list(F.struct("start", "place", "head", "body")))

    def text(name: str) -> Column:
        return F.array_join(F.transform("parts", lambda p: p[name]), "").alias(name)

    moved = F.col("inherits") & F.col("within_before")
    marked = marked.drop("within").join(counts, RANGE).withColumns({
        "head": F.when(moved, "").otherwise(F.col("head")),
        "body": F.when(moved, F.col("head")).otherwise(F.col("body"))})
    return staged(marked
                  .groupBy("file", (F.col("base") + F.col("ended")).alias("number"))
                  .agg(ordered.alias("parts"))
                  .select("file", "number", text("head"), text("body")), "json-objects")
