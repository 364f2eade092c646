"""Removal of passages that an earlier document has, found by difference-cover anchors.

Two documents share a passage if the same ``WINDOW`` words in a row begin somewhere in
both. Shorter windows are hashed only where the position modulo ``PERIOD`` is in a
difference cover: for any two positions there is a step below the period that brings
both onto the cover, so each shared passage has an anchor at the same place in
both. Anchors found in two documents or more are then extended: the full windows
around them are hashed (128 bits) and go to whichever document is first.

A window's words go if the window also begins in a document with a smaller id.
Windows are judged on the input, not on what is left.

Copies of whole texts are set aside first: only the first of equal texts is searched.
Everything that is compared is aggregated before it is shuffled, so a passage in
a third of all documents is a few rows per task.

Cases: a null text has no words; a null id comes after all others, in the order of a
hash of its text; equal texts with one id do not remove each other; a text below
``WINDOW`` words loses nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from colloquy.llm.common import (fits_broadcast, join_classes, text_digest, text_of, without,
                                 words_of)
from colloquy.session import staged

WINDOW = 50
# A perfect difference set modulo 31.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
# Odd multipliers of the two window hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
# Hashes that may be broadcast, as bigints.
BROADCAST_HASHES = 1 << 21
# Words whose hashes are summed up in one go.
SPAN = 1 << 20
# Windows that are passed on at once.
OUT_ROWS = 1 << 17
NULL_IDS = 1 << 62

_POWERS: dict[int, tuple] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` modulo 2**64 and of its inverse, at least ``size``."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < size:
        size = max(1 << 15, 1 << (size - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        known = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(
            np.full(size - 1, b, np.uint64))]) for b in (base, inverse))
        _POWERS[base] = known
    return known


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Mix the high bits of rolling sums into the low ones."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each ``width`` words in a row, independent of their position."""
    count = len(hashes) - width + 1
    if count < 1:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, count, SPAN):
        part = hashes[at:at + SPAN + width - 1]
        up, down = _powers(base, len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[:len(part)])])
        parts.append(_spread((sums[width:] - sums[:-width]) * down[:len(part) - width + 1]))
    return np.concatenate(parts)


def cover_positions(count: int) -> np.ndarray:
    """Positions below ``count`` that lie on the cover."""
    starts = np.arange(0, count, PERIOD)[:, None] + np.array(COVER)
    return starts[starts < count]


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions on the cover and the hashes of the short windows there."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    short = rolling(hashes, ANCHOR, BASES[0])
    places = cover_positions(len(short))
    return places, short[places].view(np.int64)


def around(places: np.ndarray, windows: int) -> np.ndarray:
    """Windows that hold an anchor at one of ``places`` within a period of their
    beginning."""
    steps = np.zeros(windows + 1, np.int64)
    np.add.at(steps, np.clip(places - PERIOD + 1, 0, windows), 1)
    np.add.at(steps, np.clip(places + 1, 0, windows), -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def candidates(hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Beginnings of the windows around anchors in ``shared``, and both hashes."""
    places, found = anchors(hashes)
    at = around(places[np.isin(found, shared)], max(len(hashes) - WINDOW + 1, 0))
    first, second = (rolling(hashes, WINDOW, b)[at].view(np.int64) for b in BASES)
    return at, first, second


def kept_words(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """The words that no window from ``starts`` covers."""
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return [w for w, gone in zip(words, covered.tolist()) if not gone]


def _words(value: pa.Scalar) -> list[bytes]:
    return value.as_py().encode().split()


def order_id(doc_id: Column, text: Column) -> Column:
    """The id that orders documents; null ids are behind, by a hash of the text."""
    behind = F.shiftrightunsigned(F.xxhash64(text_of(text)), 2) + F.lit(NULL_IDS)
    return F.coalesce(doc_id.cast("bigint"), behind)


def document_anchors(docs: DataFrame) -> DataFrame:
    """``(hash, id)``: the anchors of ``docs (id, text)``, one row each per text."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"]):
                own = np.unique(anchors(word_hashes(_words(text)))[1])
                found.append(own)
                ids.append(np.full(len(own), doc_id, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))],
                ["hash", "id"])

    return docs.select("id", "text").mapInArrow(make, "hash bigint, id bigint")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that two documents or more have, with the first and their number."""
    return (rows.groupBy(*keys)
            .agg(F.min("id").alias("first"), F.max("id").alias("last"),
                 F.count(F.lit(1)).alias("n"))
            .filter("first < last").drop("last"))


def affected(docs: DataFrame) -> DataFrame:
    """``docs (id, digest, text)`` that share an anchor, with ``hashes``, the anchors
    that they share."""
    found = document_anchors(docs)
    common = staged(_shared(found, "hash").select("hash"), "anchors")
    if fits_broadcast(common, BROADCAST_HASHES):
        common = F.broadcast(common)
    lists = (found.join(common, "hash").groupBy("id")
             .agg(F.collect_list("hash").alias("hashes")))
    return staged(docs.join(lists, "id"), "affected")


def windows(docs: DataFrame) -> DataFrame:
    """``(first_hash, second_hash, id)``: the full windows around shared anchors, each
    once per document."""
    names = ["first_hash", "second_hash", "id"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            for doc_id, text, shared in zip(batch["id"].to_pylist(), batch["text"],
                                            batch["hashes"]):
                _, one, two = candidates(word_hashes(_words(text)),
                                         shared.values.to_numpy())
                one, at = np.unique(one, return_index=True)
                held.append(np.stack([one, two[at], np.full(len(one), doc_id, np.int64)]))
                rows += len(one)
                if rows >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays(
                        list(map(pa.array, np.concatenate(held, axis=1))), names)
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(
                list(map(pa.array, np.concatenate(held, axis=1))), names)

    return docs.select("id", "text", "hashes").mapInArrow(
        make, "first_hash bigint, second_hash bigint, id bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` of :func:`affected` that lose words, with ``gone``: the first hashes of
    the windows that begin in an earlier document."""
    found = staged(windows(docs), "windows")
    keys = ["first_hash", "second_hash"]
    both = staged(_shared(found, *keys), "passages")
    total = found.count()
    name = F.xxhash64(*keys).alias("key")
    later = join_classes(
        found.select(name, *keys, "id"),
        both.select(name, F.col("first_hash").alias("_one"),
                    F.col("second_hash").alias("_two"), "first", "n"), "key", "n", total)
    lists = (later.filter("first_hash = _one and second_hash = _two and first < id")
             .groupBy("id").agg(F.collect_list("first_hash").alias("gone")))
    return docs.join(lists, "id")


def removals(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each of ``docs (id, digest, text)`` that loses words: ``id, digest,
    n_removed, kept_sha256`` and, if asked for, ``kept_text``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, left = [], [], []
            for text, shared, gone in zip(batch["text"], batch["hashes"], batch["gone"]):
                words = _words(text)
                at, one, _ = candidates(word_hashes(words), shared.values.to_numpy())
                kept = kept_words(words, at[np.isin(one, gone.values.to_numpy())])
                joined = b" ".join(kept)
                counts.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["digest"], pa.array(counts, pa.int64()),
                 pa.array(digests, pa.string())] + [pa.array(left, pa.string())] * texts,
                ["id", "digest", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    ddl = "id bigint, digest string, n_removed bigint, kept_sha256 string"
    return (repeated(affected(docs)).select("id", "digest", "text", "hashes", "gone")
            .mapInArrow(make, ddl + ", kept_text string" * texts))


def substring_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` (the
    words that stay, joined by one blank). With ``texts`` also ``kept_text``,
    which is null where a text keeps all its words."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", order_id(F.col("doc_id"), F.col("text")).alias("id"),
        text_digest(F.col("text")).alias("digest"))
    words = words_of(F.col("text"))
    base = staged(named.select(
        "doc_id", "id", "digest", F.size(words).cast("bigint").alias("n_words"),
        F.sha2(F.encode(F.array_join(words, " "), "UTF-8"), 256).alias("whole")), "texts")
    total = base.count()
    firsts = staged(base.groupBy("digest").agg(F.min("id").alias("first_id"),
                                               F.count(F.lit(1)).alias("n")), "firsts")
    base = join_classes(base, firsts, "digest", "n", total)
    copies = staged(base.filter("id > first_id").select("id", "digest"), "copies")
    searched = without(named, copies, {"id": lambda d: d["id"],
                                       "digest": lambda d: d["digest"]})
    lost = staged(removals(searched.select("id", "digest", "text"), texts)
                  .dropDuplicates(["id", "digest"]), "removals")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    found = base.join(lost, ["id", "digest"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole"))
        .alias("kept_sha256"),
        *[F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] * texts)
    return found
