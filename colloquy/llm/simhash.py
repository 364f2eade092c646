"""Near-duplicates by SimHash, compared exactly in tiles.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of
a text's three-word shingles. Distinct fingerprints are compared with exclusive
or and bit counts, tile by tile: rows are sorted by population count, and a
pair of tiles whose counts differ beyond the radius is skipped.

So that the work does not grow with the square of the table, tiles are made within
cells. A fingerprint is cut into four blocks of 16 bits, and a cell holds those that
agree in two given blocks: two fingerprints that differ in at most two bits agree
in two blocks at least, so no link is lost. A cell over ``CELL_ROWS`` is cut further,
by population count and hash, and each pair of its tiles within the radius is
a group of its own; rows are repeated for that, never dropped.

Links are reduced to a forest within a task before they are written. Classes are
the connected components of the links.

Cases: a null or blank text has fingerprint zero and is linked like any other; a null
id is never a representative unless the group has no other; repeated rows share
their class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from colloquy.llm.common import join_classes, text_digest, without
from colloquy.llm.components import components
from colloquy.session import staged

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
BLOCK_BITS = 16
CELL_ROWS = 4096
TILE = 256
# Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[:1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans),
                         np.uint64, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(
            axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a bigint."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}"
                     for f in rows.schema.fields[:-1]] + ["fp bigint"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch["_text"]),
                                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch[name] for name in keep], pa.array(found.view(np.int64))],
                [*keep, "fp"])

    return rows.mapInArrow(make, ddl)


def _block(fp: Column, number: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * number).bitwiseAND((1 << BLOCK_BITS) - 1)


def _cells(prints: DataFrame) -> DataFrame:
    """``(cell, fp, ones)``: each fingerprint in the six cells it belongs to."""
    fp = F.col("fp")
    keys = [F.shiftleft(F.lit(n).cast("bigint"), 2 * BLOCK_BITS)
            .bitwiseOR(F.shiftleft(_block(fp, i), BLOCK_BITS)).bitwiseOR(_block(fp, j))
            for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    return prints.select(F.explode(F.array(*keys)).alias("cell"), "fp",
                         F.bit_count("fp").alias("ones"))


def _groups(cells: DataFrame) -> DataFrame:
    """Rows ``(cell, fp, ones)`` whose cells hold two fingerprints or more, large
    cells cut into groups of two tiles."""
    counts = staged(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
                    .filter("n > 1"), "cells")
    total = cells.count()
    rows = join_classes(cells, counts, "cell", "n", total)
    small = rows.filter(F.col("n") <= CELL_ROWS).select("cell", "fp", "ones")
    tiles = F.ceil(F.col("n") / (2 * CELL_ROWS)).cast("bigint")
    here = F.col("ones") * F.col("tiles") + F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = (rows.filter(F.col("n") > CELL_ROWS).withColumn("tiles", tiles)
             .withColumn("here", here)
             .withColumn("there", F.explode(F.sequence(
                 (F.col("ones") - RADIUS) * F.col("tiles"),
                 (F.col("ones") + RADIUS + 1) * F.col("tiles") - 1)))
             .select(F.xxhash64("cell", F.least("here", "there"),
                                F.greatest("here", "there")).alias("cell"), "fp", "ones"))
    return small.unionByName(pairs)


def _forest(size: int, left: np.ndarray, right: np.ndarray) -> tuple:
    """Links between ``size`` rows as one link from each row to the least row
    that it is connected with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rows = np.flatnonzero(label != np.arange(size))
    return rows, label[rows]


def tile_links(cell: np.ndarray, prints: np.ndarray, ones: np.ndarray) -> tuple:
    """Linked rows of a table sorted by cell and population count: compares each
    pair of tiles that have a cell in common and counts within the radius."""
    left, right = [], []
    for a in range(0, len(prints), TILE):
        a_end = min(a + TILE, len(prints))
        for b in range(a, len(prints), TILE):
            b_end = min(b + TILE, len(prints))
            if cell[b] > cell[a_end - 1]:
                break
            # one cell throughout: counts ascend, so later tiles are further off
            if cell[a] == cell[b_end - 1] and ones[b] - ones[a_end - 1] > RADIUS:
                break
            far = np.bitwise_count(prints[a:a_end, None] ^ prints[None, b:b_end])
            i, j = np.nonzero(far <= RADIUS)
            i, j = i + a, j + b
            later = i < j
            left.append(i[later])
            right.append(j[later])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    if len(left) > len(prints):
        left, right = _forest(len(prints), left, right)
    return left, right


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fp`` that differ in two
    bits or fewer, enough of them to connect all that are linked."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            fps = rows[1].view(np.uint64)
            i, j = tile_links(rows[0], fps, rows[2])
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[1][i]), pa.array(rows[1][j])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in ("cell", "fp", "ones")])
            whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last cell may go on
            if whole:
                yield found(np.concatenate([*held, rows[:, :whole]], axis=1))
                held = []
            held.append(rows[:, whole:])
        if held:
            yield found(np.concatenate(held, axis=1))

    groups = _groups(_cells(prints))
    return (groups.repartition("cell").sortWithinPartitions("cell", "ones", "fp")
            .mapInArrow(compare, "a bigint, b bigint").filter("a != b").distinct())


def _best() -> Column:
    """The representative's place in the order: ids first, null last, then text."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "digest")


def near_classes(rows: DataFrame) -> DataFrame:
    """Rows ``(id, digest, fp)`` with ``best``, the representative of the class,
    and ``members``, the number of rows in it."""
    total = rows.count()
    prints = staged(rows.groupBy("fp").agg(F.min(_best()).alias("best"),
                                           F.count(F.lit(1)).alias("n")), "prints")
    roots = components(links(prints.select("fp")))
    rooted = staged(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")), "rooted")
    classes = rooted.groupBy("root").agg(
        F.min("best").alias("best"), F.sum("n").alias("members"),
        F.count(F.lit(1)).alias("prints"))
    # a class of one fingerprint is its own answer; only the others are joined
    alone = rooted.select("fp", "n", "root")
    joined = staged(join_classes(alone, staged(classes, "near"), "root", "prints",
                                 max(prints.count(), 1)), "near-prints")
    return join_classes(rows, joined.select("fp", "n", "best", "members"),
                        "fp", "n", total)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` as 16 hex digits and
    ``component_id``, the smallest id reachable over links."""
    rows = staged(fingerprints(docs.select(
        F.col("doc_id").cast("bigint").alias("id"), F.lit("").alias("digest"), "text"),
        "text", "id", "digest"), "fingerprints")
    return near_classes(rows).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, all columns: the one with the
    smallest id, of several with one id that whose text has the smallest digest."""
    rows = staged(fingerprints(docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        text_digest(F.col("text")).alias("digest"), "text"),
        "text", "id", "digest"), "fingerprints")
    classes = near_classes(rows)
    dropped = staged(classes.filter(
        "members > 1 and (not id <=> best.id or digest != best.digest)")
        .select("id", "digest"), "near-copies")
    return without(docs, dropped, {"id": lambda d: d["doc_id"],
                                   "digest": lambda d: text_digest(d["text"])})
