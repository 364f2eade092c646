"""Phrase collocations from FM-indexes over word ids.

Texts are cut into shards. A first pass counts the words of each shard; the words
that are frequent over all shards are numbered by frequency, and every shard gets the
numbers of its own. Rare words, and the places where texts are cut, are breaks
that no phrase crosses. Each shard then makes FM-indexes of its numbers in both
directions, for a block of bounded length at a time: the Burrows-Wheeler transform, the first row of each symbol, and the
map from a row to the row of the symbol before it. Beginning with single
words, the intervals of all phrases are extended together by one word, to the right
in the backward index and to the left in the forward index, and each step keeps the
interval in the other index in line. An interval's size is the phrase's count in the
block. Phrases, the extensions of shorter ones, are summed over the blocks of a shard
and then across shards in rounds of up to ``FAN_MOST`` runs, exchanged by digits of a hash, so a common phrase has one
entry per run however often it occurs.

A phrase's score is its count squared over the product of the counts of its two
parts, at the cut where that is lowest.

Cases: a null text is empty; a null language is ``und``; repeated rows count each;
languages never share a phrase; empty texts and tables have no phrases; other columns
are ignored, whatever their names. One text is a unit of work. Bytes compare
as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm import shards
from colloquy.llm.common import small_side
from colloquy.operators.ranking import ranked
from colloquy.session import staged

BLANKS = " \t"
CUTS = ".,;:!?\n\x0b\x0c\r"
# What a score of one is written as.
UNIT = 1_000_000
# Bytes of text in a shard; bytes whose words are cut out and symbols that are indexed
# at once.
SHARD_BYTES = 9 << 20
SLICE_BYTES = 1 << 20
BLOCK = 1 << 17
# How many runs meet in a round, and how many parts their phrases are dealt to: as many
# as there are runs within these bounds, so that one round is enough and no part grows.
FAN = 128
FAN_MOST = 1 << 13
MIXER = np.uint64(0x9E3779B97F4A7C15)
SHARD_DDL = ("shard bigint, lang string, word binary, local bigint, n bigint, "
             "symbols binary")
RUN_DDL = "run bigint, part bigint, size int, entries bigint, packed binary"
RUN_SCHEMA = pa.schema([("run", pa.int64()), ("part", pa.int64()), ("size", pa.int32()),
                        ("entries", pa.int64()), ("packed", pa.binary())])


# --- order and index -------------------------------------------------------------


def row_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of whole numbers from 0, equal rows as they are."""
    size = len(columns[0])
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    place = max(size - 1, 0).bit_length()
    if sum(bits) + place > 63:
        return np.lexsort(columns[::-1])
    packed = np.zeros(size, np.int64)
    for column, width in zip(columns, bits):
        packed = (packed << width) | column.astype(np.int64)
    packed = (packed << place) | np.arange(size)
    packed.sort()
    return packed & ((1 << place) - 1)


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes by their first ``depth`` symbols, at least, by
    doubling; equal ones by place. Beyond the end stand breaks."""
    rank, size = text, 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:max(len(rank) - size, 0)] = rank[size:]
        order = row_order([rank, ahead])
        size *= 2
        if size >= depth:
            return order
        new = _changes([rank[order], ahead[order]])
        # the end is smallest, also where the text has no break
        dense = np.cumsum(new, dtype=np.int64)
        rank = np.empty_like(dense)
        rank[order] = dense


class Index:
    """FM-index of a text of symbols, 0 being a break, for patterns up to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        before = np.where(order > 0, order - 1, len(text) - 1)
        # no text has 2^31 symbols
        self.transform = np.where(order > 0, text[before], 0).astype(np.int32)
        place = np.empty(len(text), np.int32)
        place[order] = np.arange(len(text), dtype=np.int32)
        self.to_row = place[before]


def extended(index: Index, first: np.ndarray, size: np.ndarray, other: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All one-symbol extensions of intervals ``[first, first + size)`` of ``index``.

    ``other`` is where each interval begins in the index of the other direction.
    Returns the extended interval's number, the symbol, and the new first row, size
    and first row in the other direction.
    """
    owner = np.repeat(np.arange(len(first), dtype=np.int32), size)
    ends = np.cumsum(size)
    rows = np.arange(len(owner)) + np.repeat(first - (ends - size), size)
    symbols = index.transform[rows]
    order = row_order([owner, symbols])
    owner, symbols = owner[order], symbols[order]
    starts = np.flatnonzero(_changes([owner, symbols]))
    counts = np.diff(starts, append=len(order))
    lowest = (np.minimum.reduceat(index.to_row[rows[order]], starts)
              if len(starts) else starts)
    owner, symbols = owner[starts], symbols[starts]
    # rows with a smaller symbol come first in the other direction, too
    moved = other[owner] + starts - (ends - size)[owner]
    kept = symbols > 0
    return owner[kept], symbols[kept], lowest[kept], counts[kept], moved[kept]


def phrase_counts(text: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All phrases of 2 to ``depth`` symbols without a break, as rows of a matrix,
    and their counts, a length at a time."""
    if depth < 2 or not len(text):
        return
    forward, backward = Index(text, depth), Index(text[::-1], depth)
    sizes = np.bincount(text)
    starts = np.cumsum(sizes) - sizes
    words = np.flatnonzero(sizes[1:])[:, None] + 1
    size, ahead = sizes[words[:, 0]], starts[words[:, 0]]
    behind = ahead
    for length in range(2, depth + 1):
        if length % 2 == 0:
            owner, symbol, behind, size, ahead = extended(backward, behind, size, ahead)
            words = np.column_stack([words[owner], symbol])
        else:
            owner, symbol, ahead, size, behind = extended(forward, ahead, size, behind)
            words = np.column_stack([symbol, words[owner]])
        yield words, size


def block_counts(text: np.ndarray, depth: int
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``phrase_counts`` gives, in parts whose counts add up, from indexes of
    ``BLOCK`` symbols each.

    A block reaches ``depth - 1`` symbols into the next one, for phrases that begin in
    it. What lies wholly in there is found by both, and once taken off.
    """
    for start in range(0, len(text), BLOCK):
        block = text[start:start + BLOCK + depth - 1]
        for words, counts in phrase_counts(block, depth):
            yield words, counts.astype(np.int32)
        for words, counts in phrase_counts(block[BLOCK:], depth):
            yield words, -counts.astype(np.int32)


# --- runs of phrases -------------------------------------------------------------


def fan_of(count: int) -> int:
    """How many of ``count`` runs meet in a round, a power of two."""
    return min(max(FAN, 1 << max(count - 1, 0).bit_length()), FAN_MOST)


def _digit(words: np.ndarray, number: int, fan: int) -> np.ndarray:
    """Digit ``number`` of a hash of each phrase, below ``fan``."""
    mixed = np.zeros(len(words), np.uint64)
    for column in words.T:
        mixed = (mixed ^ column.astype(np.uint64)) * MIXER
        mixed ^= mixed >> np.uint64(29)
    shift = np.uint64((fan.bit_length() - 1) * number)
    return ((mixed >> shift) & np.uint64(fan - 1)).astype(np.uint16)


def _dealt(words: np.ndarray, counts: np.ndarray, digit: int, fan: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases, a column per place, and counts by a digit of the phrase's hash, and where
    each digit ends."""
    digits = _digit(words, digit, fan)
    order = np.argsort(digits, kind="stable")
    return (words[order].T.astype(np.uint32, order="C"), counts[order],
            np.cumsum(np.bincount(digits, minlength=fan)))


def _run_rows(run: int, part: int, digit: int, fan: int,
              found: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Phrases and counts of one run, dealt to parts by a digit of their hash; those of
    several tables are summed part by part."""
    dealt: dict[int, list[tuple]] = {}
    for words, counts in found:
        if len(words):
            dealt.setdefault(words.shape[1], []).append(
                _dealt(words, counts, digit, fan))
    rows: list[tuple] = []
    for size, tables in dealt.items():
        for number in range(fan):
            cuts = [slice(ends[number - 1] if number else 0, ends[number])
                    for _, _, ends in tables]
            words, counts = summed([(words[:, cut], counts[cut]) for cut, (words, counts, _)
                                    in zip(cuts, tables)])
            if not len(counts):
                continue
            packed = (shards.pack(words), shards.pack(counts.astype(np.int64)))
            rows.append((run, part * fan + number, size, len(counts),
                         len(packed[0]).to_bytes(4, "little") + b"".join(packed)))
    return pa.Table.from_arrays(
        [pa.array(column, field.type) for column, field in
         zip(zip(*rows) if rows else [()] * 5, RUN_SCHEMA)], schema=RUN_SCHEMA)


def _opened(size: int, entries: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(packed[:4], "little")
    words = shards.unpack(packed[4:cut], np.uint32, size * entries).reshape(size, entries)
    return words, shards.unpack(packed[cut:], np.int64, entries)


def summed(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of several tables, a column per place, each once with its total."""
    if len(tables) == 1:
        return tables[0]
    words = np.concatenate([t[0] for t in tables], axis=1)
    counts = np.concatenate([t[1] for t in tables])
    order = row_order(list(words))
    words, counts = words[:, order], counts[order]
    starts = np.flatnonzero(_changes(list(words)))
    return words[:, starts], np.add.reduceat(counts, starts)


def merge_round(runs: DataFrame, digit: int, last: bool, min_count: int,
                fan: int) -> DataFrame:
    """Let ``fan`` runs exchange their parts and sum what meets. The last round
    gives phrases with at least ``min_count``."""
    def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return summed([_opened(*row) for row in zip(
            table["size"].to_pylist(), table["entries"].to_pylist(),
            table["packed"].to_pylist())])

    def finished(key: tuple, table: pa.Table) -> pa.Table:
        words, counts = opened(table)
        kept = counts >= min_count
        matrix = np.ascontiguousarray(words[:, kept].T.astype(np.int64))
        ends = np.arange(len(matrix) + 1, dtype=np.int32) * words.shape[0]
        return pa.Table.from_arrays(
            [pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel())),
             pa.array(counts[kept])], ["ids", "n"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        words, counts = opened(table)
        return _run_rows(key[0].as_py(), key[1].as_py(), digit, fan, [(words.T, counts)])

    grouped = (runs.withColumn("_run", F.floor(F.col("run") / fan))
               .groupBy("_run", "part", "size"))
    if last:
        return grouped.applyInArrow(finished, "ids array<bigint>, n bigint")
    return grouped.applyInArrow(merged, RUN_DDL)


# --- passes over the texts -------------------------------------------------------


def coded(texts: pa.Table, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different words of ``text`` and the number of each word in turn, from 1, with
    a break before each piece."""
    slices, breaks = [], []
    for part in shards.blocks(texts.to_batches(), "text", SLICE_BYTES):
        known, codes, _, cuts = shards.tokenized(shards.joined(part["text"])[0], table)
        slices.append(pa.DictionaryArray.from_arrays(codes, known))
        breaks.append(np.flatnonzero(np.diff(cuts, prepend=-1)))
    whole = pa.chunked_array(slices).unify_dictionaries()
    symbols = [np.insert(chunk.indices.to_numpy() + 1, new, 0)
               for chunk, new in zip(whole.chunks, breaks)]
    return whole.chunk(0).dictionary, np.concatenate(symbols)


def shard_rows(shard: int, block: pa.Table, table: np.ndarray) -> pa.RecordBatch:
    """The rows of one shard: its words by language, then its symbols."""
    names, words, symbols, counts, used = [], [], [], [], 0
    for name in pc.unique(block["lang"]).to_pylist():
        known, own = coded(block.filter(pc.equal(block["lang"], name)), table)
        names.append(pa.repeat(pa.scalar(name, pa.string()), len(known)))
        words.append(known)
        counts.append(np.bincount(own, minlength=len(known) + 1)[1:])
        symbols.append(np.where(own > 0, own + np.int32(used), np.int32(0)))
        used += len(known)
    size = sum(map(len, symbols))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(used + 1, shard)),
        pa.concat_arrays([*names, pa.nulls(1, pa.string())]),
        pa.concat_arrays([*words, pa.nulls(1, pa.binary())]),
        pa.array(np.arange(1, used + 2)),
        pa.array(np.append(np.concatenate(counts), size)),
        pa.array([None] * used + [shards.pack(np.concatenate(symbols))], pa.binary()),
    ], SHARD_DDL.replace(",", "").split()[::2])


def word_shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Shards of texts: a row of symbols for each, and a row for each of its words."""
    table = shards.kinds(BLANKS, CUTS)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                       F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, block in enumerate(shards.blocks(batches, "text", SHARD_BYTES)):
            yield shard_rows((part << 32) + number, block, table)
            # workers outlive the stage, and would keep what Arrow has freed
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(make, SHARD_DDL)


def vocabulary(words: DataFrame, min_count: int) -> DataFrame:
    """Words ``(lang, word, n, id)`` with at least ``min_count``, by frequency; the
    first id is 1."""
    counted = (words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
               .filter(F.col("n") >= min_count))
    return ranked(counted, [], [F.col("n").desc(), F.col("lang"), F.col("word")],
                  "id").withColumn("id", F.col("id") + 1)


def phrase_runs(texts: DataFrame, numbered: DataFrame, max_words: int,
                fan: int = FAN) -> DataFrame:
    """The phrases of each shard as runs, from its symbols and its frequent words."""
    def make(key: tuple, text: pa.Table, words: pa.Table) -> pa.Table:
        run = text["run"][0].as_py() if text.num_rows else 0
        if not text.num_rows or not words.num_rows:
            return _run_rows(run, 0, 0, fan, [])
        symbols = shards.unpack(text["symbols"][0].as_py(), np.int32, text["n"][0].as_py())
        ids = words["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        if ids[-1] >= 1 << 32:
            raise ValueError("over 2^32 frequent words")
        dense = np.zeros(int(max(symbols.max(initial=0), words["local"].to_numpy().max())) + 1,
                         np.int32)
        dense[words["local"].to_numpy()[order]] = np.arange(1, len(ids) + 1)
        short = dense[symbols]
        broken = short == 0
        short = short[~(broken & np.concatenate([[True], broken[:-1]]))]
        del symbols, broken
        named = np.concatenate([[0], ids])
        return _run_rows(run, 0, 0, fan, ((named[found], counts) for found, counts
                                          in block_counts(short, max_words)))

    return (texts.groupBy("shard").cogroup(numbered.groupBy("owner"))
            .applyInArrow(make, RUN_DDL))


def phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10,
            text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages ``(lang, total)``, words ``(lang, word, n, id)`` and phrases
    ``(ids, n)`` of 2 to ``max_words`` words, the last two with at least ``min_count``."""
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words at least and a positive count")
    made = staged(word_shards(docs, text, lang), "word-shards")
    words = made.filter("symbols is null").drop("symbols")
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    known = staged(vocabulary(words, min_count), "word-ids")
    numbered = (words.select("shard", "lang", "word", "local")
                .join(known.select("lang", "word", "id"), ["lang", "word"])
                .select(F.col("shard").alias("owner"), "local", "id"))
    texts = made.filter("symbols is not null").select("shard", "n", "symbols")
    places = ranked(texts.select("shard"), [], [F.col("shard")], "run")
    count = places.count()
    texts = texts.join(small_side(places), "shard")
    fan = fan_of(count)
    runs = phrase_runs(texts, numbered, max_words, fan)
    rounds = max(1, math.ceil(math.log(max(count, 1), fan)))
    for number in range(1, rounds + 1):
        runs = staged(merge_round(runs, number, number == rounds, min_count, fan), "phrases")
    return totals, known, runs


def scored(words: DataFrame, found: DataFrame) -> DataFrame:
    """Phrases ``(ids, a, l, r, score)`` at their lowest cut."""
    parts = (words.select(F.array("id").alias("part"), F.col("n"))
             .unionByName(found.select(F.col("ids").alias("part"), "n")))
    cuts = found.select("ids", F.col("n").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")),
                             "right": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select(F.col("part").alias(side), F.col("n").alias(name)), side)
    # up to 38 digits; as l and r are at least a, the quotient is at most UNIT
    cuts = cuts.withColumn("score", F.expr(
        f"(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * {UNIT}) "
        "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    return (cuts.groupBy("ids", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
            .select("ids", "a", "low.l", "low.r", "low.score"))


def longer_counts(found: DataFrame) -> DataFrame:
    """For each phrase the largest count of its extensions ``(ids, left_n, right_n)``
    by one word to the left and to the right."""
    longer = found.filter(F.size("ids") > 2)

    def shorter(start: int, name: str, other: str) -> DataFrame:
        return longer.select(
            F.slice("ids", F.lit(start), F.size("ids") - 1).alias("ids"),
            F.col("n").alias(name), F.lit(None).cast("bigint").alias(other))

    return (shorter(2, "left_n", "right_n")
            .unionByName(shorter(1, "right_n", "left_n"))
            .groupBy("ids").agg(F.max("left_n").alias("left_n"),
                                F.max("right_n").alias("right_n")))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10,
                 swallowed: int = 50, top: int = 2000, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase goes if a longer frequent one around it has ``swallowed`` per cent of its
    count; since a phrase around it has no more than the one between them, one
    word more is enough to look at.
    """
    totals, words, found = phrases(docs, max_words, min_count, text, lang)
    around = longer_counts(found).select(
        "ids", F.greatest("left_n", "right_n").alias("longer"))
    candidates = (scored(words, found).join(around, "ids", "left")
                  .filter(F.coalesce(F.col("longer") * 100 < F.col("a") * swallowed,
                                     F.lit(True))).drop("longer"))
    first = words.select(F.col("id").alias("first"), F.col("lang"))
    candidates = candidates.withColumn("first", F.get("ids", F.lit(0))).join(first, "first")
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    # ties are kept whole until the phrases are spelled out
    best = staged(candidates.withColumn("_place", F.rank().over(by))
                  .filter(F.col("_place") <= top).drop("_place", "first"), "collocations")
    spelled = (best.select("ids", F.posexplode("ids").alias("at", "id"))
               .join(words.select("id", "word"), "id")
               .groupBy("ids")
               .agg(F.array_join(F.transform(
                   F.array_sort(F.collect_list(F.struct("at", "word"))),
                   lambda w: w["word"].cast("string")), " ").alias("phrase")))
    rank = Window.partitionBy("lang").orderBy(
        F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (best.join(spelled, "ids").withColumn("rank", F.row_number().over(rank))
            .filter(F.col("rank") <= top)
            .join(small_side(totals), "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l",
                    "r", F.col("total").alias("n"), "score"))
