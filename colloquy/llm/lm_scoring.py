"""Language-model scores from a hashed maximum-entropy model with word classes.

A word's chance is that of its class given the words before it, times that of its slot
in the class given class and words before it, times its share of the slot. Classes and
slots are softmaxes of sums of weights, one row of a hashed table for each feature that
holds: the word before, the two words before (n-grams), the word before those
alone (skip), and one constant row. Common words have a slot of their own, in classes of
like frequency; the other words share slots by their last letters, each with its part of
the slot's counts. Words unknown in training count as one more word with no occurrences.
With all weights zero but the constant row this is the smoothed frequency of words.

Counts of all words come from an exchange of packed words: a shard deals its words to parts by
a hash, each part counts its words over all shards and gives every shard its own back
with their counts and slots.

Training reads every token that may be learned from once. The shards are dealt to
``ROUNDS`` rounds. In a round each shard starts from the same tables, takes gradient
steps over batches of its tokens, and gives back how its rows moved. Moves are summed
by row block on the executors and averaged over the shards that moved a row, and the
tables, whose size is fixed, go out again. Scores are worked out in numpy for batches of
tokens, reading only the rows whose features hold.

Cases: a null or empty text has one token, its end; a null id is never held out; repeated
rows are scored, and learned from, each; without any training document every token is
unknown and has chance one; other columns are ignored. One text is a unit of work.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colloquy.llm import shards
from colloquy.session import staged

BLANKS = " \t\n\x0b\x0c\r"
# The end of a text, as a word; no word can contain a blank.
END = b"\n"
SMOOTH = 0.1
FOLDS, FOLD = 10, 0

CLASSES = 32
SLOTS = 32
# Rows of each hashed table.
ROWS = 1 << 14
# Words with a slot of their own are looked for among this many, of this many bytes.
COMMON = 4096
COMMON_BYTES = 128
# The part of all classes that other words may use, at least.
OPEN_CLASSES = 12
LETTERS = 2

ROUNDS = 6
BATCH = 1 << 13
RATE = 0.25
BLOCK_ROWS = 1 << 11
MIXER = 0x9E3779B97F4A7C15
FEATURES = 3

# Words are dealt to this many parts, and to one more for each so many shards.
PARTS, PART_SHARDS = 64, 16
SHARD_DDL = ("shard bigint, part int, n bigint, words binary, locals binary, counts binary, "
             "ids array<bigint>, learn array<boolean>, sizes array<bigint>, symbols binary")
RETURN_DDL = ("owner bigint, n bigint, locals binary, counts binary, slots binary, "
              "hashes binary, slot int, mass bigint, different bigint")
READY_DDL = ("shard bigint, ids array<bigint>, learn array<boolean>, sizes array<bigint>, "
             "symbols binary, counts binary, slots binary, hashes binary, words bigint")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in
                      (column.split() for column in ddl.split(", "))])


SHARD_SCHEMA, RETURN_SCHEMA = _schema(SHARD_DDL), _schema(RETURN_DDL)


def names_of(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


# --- model -----------------------------------------------------------------------


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(MIXER)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def features(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the features of each token, a row for each kind. ``words`` are hashes
    of words, ``starts`` says where texts begin; before them stands nothing."""
    size = len(words)
    place = np.arange(size) - np.repeat(starts, np.diff(starts, append=size))
    before = np.zeros((2, size), np.uint64)
    for back in (1, 2):
        at = np.flatnonzero(place >= back)
        before[back - 1, at] = words[at - back]
    one, two = before
    return np.stack([mixed(one ^ np.uint64(1)),
                     mixed(mixed(one ^ np.uint64(2)) ^ two),
                     mixed(two ^ np.uint64(3))])


class Tables:
    """Weights of classes and slots; the last row of each table is the constant."""

    def __init__(self, masses: np.ndarray):
        self.masses = np.maximum(masses, 1e-12)
        in_class = self.masses.sum(axis=1)
        self.classes = np.zeros((ROWS + CLASSES, CLASSES), np.float32)
        self.slots = np.zeros((ROWS + CLASSES, SLOTS), np.float32)
        # constants: the first of the last rows for classes, one for each class for slots
        self.classes[ROWS] = np.log(in_class)
        self.slots[ROWS:] = np.log(self.masses / in_class[:, None])


def rows_of(found: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both tables for tokens with these features and classes."""
    size = found.shape[1]
    first = np.empty((FEATURES + 1, size), np.int64)
    first[:FEATURES] = (found % np.uint64(ROWS)).astype(np.int64)
    first[FEATURES] = ROWS
    second = np.empty_like(first)
    second[:FEATURES] = (((found >> np.uint64(20)) + classes.astype(np.uint64)
                          * np.uint64(0x632BE5AB)) % np.uint64(ROWS)).astype(np.int64)
    second[FEATURES] = ROWS + classes
    return first, second


def weights(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Summed weights of each token's classes or slots."""
    out = table.take(rows[0], axis=0)
    for row in rows[1:]:
        out += table.take(row, axis=0)
    return np.clip(out, -60, 60, out=out)


def log_chances(tables: Tables, found: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance of each token's slot."""
    classes = slots // SLOTS
    at = np.arange(len(slots))
    out = np.zeros(len(slots))
    for table, rows, target in zip((tables.classes, tables.slots), rows_of(found, classes),
                                   (classes, slots % SLOTS)):
        summed = weights(table, rows)
        out += summed[at, target]
        out -= np.log(np.exp(summed, out=summed).sum(axis=1))
    return out


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step for a batch, each row at a rate by what it has seen."""
    wrong = weights(table, rows)
    np.exp(wrong, out=wrong)
    wrong /= wrong.sum(axis=1, keepdims=True)
    size = len(target)
    wrong[np.arange(size), target] -= 1
    place = max(size - 1, 0).bit_length()
    for kind in rows:
        if kind[0] == kind[-1] and (kind == kind[0]).all():
            used, slope = kind[:1], wrong.sum(axis=0, keepdims=True)
        else:
            packed = (kind << place) | np.arange(size)
            packed.sort()
            kind = packed >> place
            starts = np.flatnonzero(np.diff(kind, prepend=-1))
            slope = np.add.reduceat(
                wrong.take(packed & ((1 << place) - 1), axis=0), starts, axis=0)
            used = kind[starts]
        seen[used] += np.einsum("ij,ij->i", slope, slope) / slope.shape[1]
        slope *= (RATE / np.sqrt(seen[used]))[:, None]
        table[used] -= slope


def train_shard(tables: Tables, found: np.ndarray, slots: np.ndarray) -> None:
    """Gradient steps over the tokens of a shard, in their order."""
    seen = [np.ones(len(tables.classes), np.float32), np.ones(len(tables.slots), np.float32)]
    for start in range(0, len(slots), BATCH):
        target = slots[start:start + BATCH]
        classes = target // SLOTS
        first, second = rows_of(found[:, start:start + BATCH], classes)
        _step(tables.classes, seen[0], first, classes)
        _step(tables.slots, seen[1], second, target % SLOTS)


# --- shards ----------------------------------------------------------------------


def word_shards(docs: DataFrame, parts: int, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """Shards of texts: a row of symbols for each, and a row for each part that some of
    its words belong to, with their counts in texts to learn from."""
    table = shards.kinds(BLANKS)
    learn = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS != FOLD, F.lit(True))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), learn.alias("learn"),
                       F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, block in enumerate(shards.blocks(batches, "text")):
            data, begin = shards.joined(block["text"])
            known, codes, starts, _ = shards.tokenized(data, table)
            # the end of each text has the number after all words
            stops = np.searchsorted(starts, np.append(begin[1:], len(data)))
            symbols = np.insert(codes.astype(np.int32), stops, len(known))
            sizes = np.diff(stops, prepend=0) + 1
            may = block["learn"].combine_chunks().to_numpy(zero_copy_only=False)
            words = known.to_pylist() + [END]
            counts = np.bincount(symbols[np.repeat(may, sizes)], minlength=len(words))
            part = np.array([xxhash.xxh64_intdigest(w) % parts for w in words])
            order = np.argsort(part, kind="stable")
            out = [dict(shard=first + number, n=len(symbols), ids=block["id"].to_pylist(),
                        learn=may, sizes=sizes, symbols=shards.pack(symbols))]
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                out.append(dict(
                    shard=first + number, part=int(part[own[0]]), n=len(own),
                    words=packed_words([words[i] for i in own]),
                    locals=shards.pack(own.astype(np.int32)),
                    counts=shards.pack(counts[own].astype(np.int64))))
            yield from pa.Table.from_pylist(out, SHARD_SCHEMA).to_batches()

    return rows.mapInArrow(make, SHARD_DDL)


def packed_words(words: list[bytes]) -> bytes:
    """Words, none of which has a blank but the end of texts, one after another."""
    data = b" ".join(words)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, "zstd", asbytes=True).split(b" ")


def common_slots(common: list[tuple[bytes, int]], total: int) -> dict[bytes, int]:
    """A slot of its own for words, most frequent first, in classes of like size."""
    out: dict[bytes, int] = {}
    target = total / CLASSES
    number, inside, mass = 0, 0, 0
    for word, count in common:
        if inside and (mass + count > target or inside == SLOTS):
            number, inside, mass = number + 1, 0, 0
        if number >= CLASSES - OPEN_CLASSES:
            break
        out[word] = number * SLOTS + inside
        inside, mass = inside + 1, mass + count
    return out


def open_slot(word: bytes, first: int) -> int:
    """The slot of a word without one of its own: the class by its last letters, the slot
    by one letter more and its length. Classes from ``first`` on are open."""
    number = first + zlib.crc32(word[-LETTERS:]) % (CLASSES - first)
    return number * SLOTS + zlib.crc32(word[-LETTERS - 1:], min(len(word), 12)) % SLOTS


def _counted(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of a part, their counts over all shards, and the number of
    each word that shards have sent, in turn."""
    sent = [w for data in table["words"].to_pylist() for w in unpacked_words(data)]
    coded = pa.array(sent, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = np.concatenate([shards.unpack(c, np.int64, n) for c, n in zip(
        table["counts"].to_pylist(), table["n"].to_pylist())])
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, codes, counts)
    return coded.dictionary.to_pylist(), total, codes


def common_words(dealt: DataFrame) -> tuple[list[tuple[bytes, int]], int, int]:
    """The most frequent words with their counts, and how many words there are in texts
    to learn from, repeated and different ones."""
    def work(key: tuple, table: pa.Table) -> pa.Table:
        words, total, _ = _counted(table)
        short = np.array([len(w) <= COMMON_BYTES for w in words])
        may = np.flatnonzero(short & (total > 0))
        best = may[np.argsort(-total[may], kind="stable")]
        if len(best) > COMMON:  # words as frequent as the last one stay in
            best = best[:int(np.searchsorted(-total[best], -total[best[COMMON - 1]], "right"))]
        rows = [dict(word=words[i], c=int(total[i])) for i in best]
        rows.append(dict(c=int(total.sum()), different=int((total > 0).sum())))
        return pa.Table.from_pylist(rows, pa.schema(
            [("word", pa.binary()), ("c", pa.int64()), ("different", pa.int64())]))

    found = staged(dealt.select("part", "n", "words", "counts").groupBy("part").applyInArrow(
        work, "word binary, c bigint, different bigint"), "lm-common")
    row = found.filter("word is null").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("different"), F.lit(0)).alias("v")).first()
    common = [(bytes(r["word"]), r["c"]) for r in found.filter("word is not null")
              .orderBy(F.col("c").desc(), "word").limit(COMMON).collect()]
    return common, row["n"], row["v"]


def returned_words(dealt: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """For each shard and part its words with counts, slots and hashes; and for each part
    and slot the counts of its words."""
    first = max(own.values(), default=-1) // SLOTS + 1

    def work(key: tuple, table: pa.Table) -> pa.Table:
        words, total, codes = _counted(table)
        slots = np.array([own[w] if w in own else open_slot(w, first) for w in words], np.int32)
        slots[total == 0] = CLASSES * SLOTS - 1
        hashes = np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64)
        ends = np.cumsum(table["n"].to_numpy())
        rows = []
        for shard, locals_, a, b in zip(table["shard"].to_pylist(), table["locals"].to_pylist(),
                                        np.append(0, ends), ends):
            at = codes[a:b]
            rows.append(dict(owner=shard, n=int(b - a), locals=locals_,
                             counts=shards.pack(total[at]), slots=shards.pack(slots[at]),
                             hashes=shards.pack(hashes[at])))
        known = total > 0
        masses = np.zeros(CLASSES * SLOTS, np.int64)
        np.add.at(masses, slots[known], total[known])
        different = np.bincount(slots[known], minlength=len(masses))
        rows += [dict(slot=int(s), mass=int(masses[s]), different=int(different[s]))
                 for s in np.flatnonzero(different)]
        return pa.Table.from_pylist(rows, RETURN_SCHEMA)

    return dealt.select("shard", "part", "n", "words", "locals", "counts").groupBy(
        "part").applyInArrow(work, RETURN_DDL)


def slot_masses(returned: DataFrame) -> np.ndarray:
    """Smoothed counts of classes and slots."""
    out = np.zeros(CLASSES * SLOTS)
    for r in (returned.filter("slot is not null").groupBy("slot")
              .agg(F.sum("mass").alias("c"), F.sum("different").alias("v")).collect()):
        out[r["slot"]] = r["c"] + SMOOTH * r["v"]
    out[-1] += SMOOTH  # unknown words
    return out.reshape(CLASSES, SLOTS)


def ready_shards(texts: DataFrame, returned: DataFrame) -> DataFrame:
    """Shards with count, slot and hash of each of their words."""
    kinds = {"counts": np.int64, "slots": np.int32, "hashes": np.uint64}

    def make(key: tuple, text: pa.Table, words: pa.Table) -> pa.Table:
        made = {n: text[n] for n in ("shard", "ids", "learn", "sizes", "symbols")}
        sizes = words["n"].to_pylist()
        places = np.concatenate([shards.unpack(data, np.int32, n) for data, n in
                                 zip(words["locals"].to_pylist(), sizes)])
        for name, kind in kinds.items():
            column = np.empty(len(places), kind)
            column[places] = np.concatenate([shards.unpack(data, kind, n) for data, n in
                                             zip(words[name].to_pylist(), sizes)])
            made[name] = pa.array([shards.pack(column)], pa.binary())
        made["words"] = pa.array([len(places)], pa.int64())
        return pa.table({n: made[n] for n in names_of(READY_DDL)})

    words = returned.filter("owner is not null").drop("slot", "mass", "different")
    return (texts.groupBy("shard").cogroup(words.groupBy("owner"))
            .applyInArrow(make, READY_DDL))


def opened(batch: pa.RecordBatch, at: int) -> tuple:
    """Ids, marks and sizes of a shard's texts, the symbols of its tokens, and count, slot
    and hash of its words."""
    row = {n: batch[n][at] for n in ("ids", "learn", "sizes")}
    sizes = np.asarray(row["sizes"].values)
    used = batch["words"][at].as_py()
    read = lambda n, kind: shards.unpack(batch[n][at].as_py(), kind, used)
    symbols = shards.unpack(batch["symbols"][at].as_py(), np.int32, int(sizes.sum()))
    return (row["ids"].values, np.asarray(row["learn"].values), sizes, symbols,
            read("counts", np.int64), read("slots", np.int32), read("hashes", np.uint64))


# --- training and scoring --------------------------------------------------------


def _shared(spark, tables: Tables):
    return spark.sparkContext.broadcast(
        (tables.masses, tables.classes.astype(np.float32), tables.slots.astype(np.float32)))


def _tables(shared) -> Tables:
    masses, classes, slots = shared.value
    tables = Tables(masses)
    tables.classes, tables.slots = classes.copy(), slots.copy()
    return tables


def train_round(ready: DataFrame, tables: Tables) -> None:
    """Train on some shards from ``tables``, and move those by the mean of the moves."""
    shared = _shared(ready.sparkSession, tables)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = None
        moves: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for batch in batches:
            for at in range(batch.num_rows):
                _, learn, sizes, symbols, _, slots, hashes = opened(batch, at)
                kept = np.repeat(learn, sizes)
                begin = np.cumsum(sizes) - sizes
                found = features(hashes[symbols], begin)[:, kept]
                if not found.shape[1]:
                    continue
                start = start or _tables(shared)
                moved = _tables(shared)
                train_shard(moved, found, slots[symbols[kept]])
                for n, (new, old) in enumerate(((moved.classes, start.classes),
                                                (moved.slots, start.slots))):
                    if len(moves) <= n:
                        moves.append(np.zeros_like(old))
                        times.append(np.zeros(len(old), np.float32))
                    moves[n] += new - old
                    times[n] += (new != old).any(axis=1)
        for n, (move, time) in enumerate(zip(moves, times)):
            for block, first in enumerate(range(0, len(move), BLOCK_ROWS)):
                part = slice(first, first + BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n * 1000 + block]),
                     pa.array([shards.pack(move[part].astype(np.float16))], pa.binary()),
                     pa.array([shards.pack(time[part])], pa.binary())],
                    ["block", "move", "times"])

    def shape(block: int) -> tuple[int, int]:
        table = tables.classes if block < 1000 else tables.slots
        first = block % 1000 * BLOCK_ROWS
        return min(BLOCK_ROWS, len(table) - first), table.shape[1]

    shapes = {n * 1000 + block: shape(n * 1000 + block) for n in range(2)
              for block in range(-(-len(tables.classes) // BLOCK_ROWS))}

    def averaged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        rows, width = shapes[block]
        move, times = np.zeros((rows, width), np.float32), np.zeros(rows, np.float32)
        for batch in batches:
            for m, t in zip(batch["move"].to_pylist(), batch["times"].to_pylist()):
                move += shards.unpack(m, np.float16, rows * width).reshape(rows, width)
                times += shards.unpack(t, np.float32, rows)
        move /= np.maximum(times, 1)[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([shards.pack(move)], pa.binary())], ["block", "move"])

    moved = (ready.mapInArrow(work, "block bigint, move binary, times binary")
             .groupBy("block").applyInArrow(averaged, "block bigint, move binary"))
    for row in moved.collect():  # as many rows as the tables have blocks
        rows, width = shapes[row["block"]]
        table = tables.classes if row["block"] < 1000 else tables.slots
        first = row["block"] % 1000 * BLOCK_ROWS
        table[first:first + rows] += shards.unpack(
            bytes(row["move"]), np.float32, rows * width).reshape(rows, width)
    shared.destroy()


def scored(ready: DataFrame, tables: Tables, total: int, different: int) -> DataFrame:
    """One row per text: ``doc_id, n_tokens, n_known, base_score, score``."""
    shared = _shared(ready.sparkSession, tables)
    room = total + SMOOTH * (different + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tables(shared)
        for batch in batches:
            for at in range(batch.num_rows):
                ids, _, sizes, symbols, counts, slots, hashes = opened(batch, at)
                begin = np.cumsum(sizes) - sizes
                found = features(hashes[symbols], begin)
                shares = np.log((counts + SMOOTH) / known.masses.ravel()[slots])
                bases = np.log10((counts + SMOOTH) / room)
                chances = shares[symbols]
                for start in range(0, len(symbols), BATCH):
                    part = slice(start, start + BATCH)
                    chances[part] += log_chances(known, found[:, part], slots[symbols[part]])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes),
                     pa.array(np.add.reduceat((counts > 0)[symbols].astype(np.int64), begin)),
                     pa.array(np.add.reduceat(bases[symbols], begin)),
                     pa.array(np.add.reduceat(chances, begin) / math.log(10))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return ready.select(
        "ids", "learn", "sizes", "symbols", "counts", "slots", "hashes", "words").mapInArrow(
        work, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
              rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = PARTS + size // (shards.SHARD_BYTES * PART_SHARDS)
    made = staged(word_shards(docs, parts, text, doc_id), "lm-shards")
    dealt = made.filter("part is not null")
    texts = made.filter("part is null").select("shard", "ids", "learn", "sizes", "symbols")
    common, total, different = common_words(dealt)
    returned = staged(returned_words(dealt, common_slots(common, total)), "lm-words")
    ready = staged(ready_shards(texts, returned), "lm-ready")
    tables = Tables(slot_masses(returned))
    if total:
        for number in range(rounds):
            train_round(ready.filter(F.pmod(F.xxhash64("shard"), F.lit(rounds)) == number),
                        tables)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD, F.lit(False))
    return scored(ready, tables, total, different).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
