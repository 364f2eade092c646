"""Exact deduplication by a tree merge of sorted digest runs.

Each partition of the input makes a sorted run of digests, one entry per digest
with its smallest identifier and its count. Runs are then exchanged in rounds:
in round r, runs whose numbers agree from digit r on meet, each bringing the
entries of one slice of the digest range, and a multiway merge makes one run of
them. Numbers are to base ``FAN``, so after R rounds each of FAN**R slices is
one run that has seen every piece. A partition's pieces are runs of their own, each
of at most 3 * ``RUN_ROWS`` entries, and their numbers are spread over all there are.
So all groups of all rounds are of like size, whatever the number of partitions; a
digest has at most one entry in each run: a text with any number of copies shrinks
before it travels.

Digests are SHA-256 with 64 bits of another hash and the length of the text
behind; entries are merged only if all of it agrees, at every level.

Cases: a null text counts as empty; a null id loses against any other id, and
stays if the group has no other; of rows with the same id and text one is kept;
an empty table gives an empty result; other columns are read only to tell rows with
the same id and text apart.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import join_classes, small_side, text_of, without
from colloquy.session import staged

FAN = 16
# Rows that one run holds about, which sets the number of runs.
RUN_ROWS = 1 << 14
# Multiples of it, without their whole part, are spread evenly over 0 to 1.
GOLDEN = (5 ** 0.5 - 1) / 2

RUN_SCHEMA = pa.schema([("run", pa.int64()), ("slice", pa.int64()),
                        ("digest", pa.string()), ("id", pa.int64()),
                        ("copies", pa.int64())])
RUN_DDL = "run bigint, slice bigint, digest string, id bigint, copies bigint"


def digest_of(text: Column) -> Column:
    """What is compared in place of a text: 64 hex digits of SHA-256, 16 of a
    second hash, and the length in bytes."""
    whole = F.encode(text_of(text), "UTF-8")
    return F.concat(F.sha2(whole, 256), F.lpad(F.hex(F.xxhash64(whole)), 16, "0"),
                    F.octet_length(whole).cast("string"))


def _merged(runs: list[list[tuple]], largest: bool) -> Iterator[tuple]:
    """Merge sorted runs of ``(digest, id, copies)`` into one, an entry per digest."""
    better = max if largest else min
    for digest, same in groupby(heapq.merge(*runs), key=lambda entry: entry[0]):
        ids, copies = [], 0
        for _, known, chosen, count in same:
            copies += count
            if known:
                ids.append(chosen)
        yield digest, bool(ids), better(ids) if ids else 0, copies


def _entries(table: pa.Table) -> list[tuple]:
    return [(d, i is not None, i or 0, n) for d, i, n in zip(
        table["digest"].to_pylist(), table["id"].to_pylist(),
        table["copies"].to_pylist())]


def _table(run: int, part: int | None, entries: Iterator[tuple], slices: int) -> pa.Table:
    rows = list(entries)
    digests = [r[0] for r in rows]
    parts = ([part] * len(rows) if part is not None
             else [int(d[:15], 16) * slices >> 60 for d in digests])
    return pa.Table.from_arrays([
        pa.array([run] * len(rows), pa.int64()), pa.array(parts, pa.int64()),
        pa.array(digests, pa.string()),
        pa.array([r[2] if r[1] else None for r in rows], pa.int64()),
        pa.array([r[3] for r in rows], pa.int64())], schema=RUN_SCHEMA)


def digest_runs(rows: DataFrame, slices: int, largest: bool) -> DataFrame:
    """Each partition's rows ``(part, digest, id)`` as sorted runs of bounded
    length, numbered below ``slices`` by partition and piece."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        run = None
        for whole in batches:
            for at in range(0, whole.num_rows, RUN_ROWS):
                batch = whole.slice(at, RUN_ROWS)
                if run is None:
                    run = int(batch["part"][0].as_py() * GOLDEN % 1 * slices)
                held += [(d, i is not None, i or 0, 1) for d, i in zip(
                    batch["digest"].to_pylist(), batch["id"].to_pylist())]
                if len(held) >= 2 * RUN_ROWS:
                    held = list(_merged([sorted(held)], largest))
                    if len(held) > RUN_ROWS:
                        yield from _table(run, None, iter(held), slices).to_batches()
                        held, run = [], (run + 1) % slices
        if held:
            yield from _table(run, None, _merged([sorted(held)], largest),
                              slices).to_batches()

    return rows.mapInArrow(make, RUN_DDL)


def merge_round(runs: DataFrame, round_no: int, slices: int, largest: bool) -> DataFrame:
    """Let the runs that differ in digit ``round_no`` of their number exchange
    the slices of the digest range, and merge what each slice gets. Earlier
    rounds have taken the digits before it off the number."""
    block = slices // FAN ** round_no

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        run = key[0].as_py()
        parted: dict[tuple, list] = {}
        for number, part, entry in zip(table["run"].to_pylist(),
                                       table["slice"].to_pylist(), _entries(table)):
            parted.setdefault((number, part), []).append(entry)
        # a run may have come in several sorted pieces
        pieces = [sorted(piece) for piece in parted.values()]
        return _table(run, None, _merged(pieces, largest), slices)

    return (runs.withColumn("_run", (F.col("run") / FAN).cast("bigint"))
            .withColumn("_block", (F.col("slice") / block).cast("bigint"))
            .groupBy("_run", "_block").applyInArrow(merge, RUN_DDL))


def digest_classes(rows: DataFrame, total: int, keep: str = "smallest") -> DataFrame:
    """One row for each digest of ``rows (digest, id)``: ``(digest, keep_id,
    copies)``, by ceil(log(total / RUN_ROWS)) rounds to base ``FAN``, two at least."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    largest = keep == "largest"
    rounds = max(2, math.ceil(math.log(max(total, 1) / RUN_ROWS, FAN)))
    slices = FAN ** rounds
    runs = digest_runs(rows.select(F.spark_partition_id().cast("bigint").alias("part"),
                                   "digest", "id"), slices, largest)
    for round_no in range(1, rounds + 1):
        runs = merge_round(runs, round_no, slices, largest)
    return runs.select("digest", F.col("id").alias("keep_id"), "copies")


def duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, keep_id, group_size, kept``.

    ``keep`` says whether the smallest or the largest id of equal texts stays.
    """
    rows = staged(docs.select(F.col("doc_id").cast("bigint").alias("id"),
                              digest_of(F.col("text")).alias("digest"),
                              F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.count()
    classes = staged(digest_classes(rows, total, keep), "classes")
    found = join_classes(rows, classes, "digest", "copies", total)
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    twins = (found.filter(same & (F.col("copies") > 1)).groupBy("digest")
             .agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("digest", "first"))
    return (found.join(small_side(staged(twins, "twins")), "digest", "left")
            .select(F.col("id").alias("doc_id"), "digest", "keep_id",
                    F.col("copies").alias("group_size"),
                    (same & F.coalesce(F.col("first") == F.col("row"), F.lit(True)))
                    .alias("kept")))


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each text, all columns.

    Rows that go are found by id and digest. Of rows that repeat with id and text,
    the one whose other columns have the smallest digest stays; rows equal in those
    too are one row. Each task picks its own smallest before rows are exchanged.
    """
    rows = staged(docs.select(F.col("doc_id").cast("bigint").alias("id"),
                              digest_of(F.col("text")).alias("digest")), "digests")
    total = rows.count()
    classes = staged(digest_classes(rows, total, keep).filter("copies > 1"), "classes")
    copies = staged(
        join_classes(rows, classes, "digest", "copies", total)
        .groupBy("digest", "id")
        .agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id")), "copies")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    keys = {"id": lambda d: d["doc_id"], "digest": lambda d: digest_of(d["text"])}
    left = without(docs, copies.filter(~same), keys)
    repeated = copies.filter(same & (F.col("n") > 1)).select(F.col("digest").alias("_digest"))
    if not repeated.take(1):
        return left
    document = F.col("_document")
    inside = left.select(F.struct("*").alias("_document")).withColumn(
        "_digest", digest_of(document["text"]))
    repeated = small_side(staged(repeated, "repeated"))
    others = [document[c] for c in docs.columns if c not in ("doc_id", "text")]
    order = F.sha2(F.to_json(F.struct(*others)), 256) if others else F.lit("")
    one = (inside.join(repeated, "_digest").groupBy("_digest")
           .agg(F.min_by("_document", order).alias("_document")))
    return (inside.join(repeated, "_digest", "left_anti").unionByName(one)
            .select("_document.*"))
