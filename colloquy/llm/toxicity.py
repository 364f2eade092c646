"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, hashed into a fixed number of rows of
an embedding table; its vector is their mean, and a text's vector is the mean
of its words. A linear softmax over the text's vector gives the class. Table and
softmax are trained together in numpy, so that a misspelling nobody has seen is near
the word that it shares n-grams with.

The model is fitted on a sample of labelled rows of bounded size (``SAMPLE_ROWS``, a
third of them toxic if there are as many), chosen by a hash of the id. Its size is
fixed, so it may be broadcast. Scoring runs over every whole text: because
the mean and the softmax are linear, each word adds its own share of the score.

Cases: a null or empty text has the score of an empty bag; a null id is never learned
from and is not held out; an id with several labels is toxic if one says so; null
labels are no labels; without labels of both classes the score is the share of
toxic labels (0 without any); repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROWS = 1 << 16
WIDTH = 8
SIZES = (3, 4, 5)
# Hashing of n-grams.
FACTOR = np.uint64(1099511628211)
MIXER = np.uint64(0x9E3779B97F4A7C15)
# A text's mean counts this many words without a share besides its own, so that
# one odd word does not decide on a short text.
NEUTRAL = 20
SAMPLE_ROWS = 6000
# Batches that are trained on, the sample taken again and again.
STEPS = 1300
BATCH = 64
RATE = 0.5
SEED = 11
DECAY = 1e-5
THRESHOLD = 0.7
CACHE_WORDS = 200_000
SCORE_ROWS = 256
EDGES = ".,;:!?\"'()[]{}<>*_-"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table that make up each word, and how many there are for each:
    one for the whole word and one for each n-gram within its two edge marks."""
    marked = [f"<{word.strip(EDGES)}>" for word in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(letters))  # letters from here to the edge
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), FACTOR, np.uint64))
    whole = np.add.reduceat(letters * powers[left - 1], ends - sizes)
    found, owner = [whole * np.uint64(7)], [np.arange(len(words))]
    for size in SIZES:
        at = np.flatnonzero(left >= size)
        gram = np.full(len(at), size, np.uint64)
        for step in range(size):
            gram = gram * FACTOR + letters[at + step]
        found.append(gram)
        owner.append(word[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    mixed = np.concatenate(found)[order] * MIXER
    rows = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(ROWS)).astype(np.int32)
    return rows, np.bincount(owners, minlength=len(words))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a text uses, ascending, and their parts of its mean."""
    counts = Counter((text or "").lower().split())
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    rows, sizes = subwords(list(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    parts = np.repeat(times / sizes, sizes) / (times.sum() + NEUTRAL)
    used, place = np.unique(rows, return_inverse=True)
    return used, np.bincount(place, parts, len(used)).astype(np.float32)


class Model:
    """What each row of the table adds to the score, and a constant."""

    def __init__(self, shares: np.ndarray, constant: float):
        self.shares = shares
        self.constant = constant
        self.known: dict[str, float] = {}

    def words(self, words: list[str]) -> list[float]:
        """The shares of some words."""
        rows, sizes = subwords(words)
        starts = np.cumsum(sizes) - sizes
        return (np.add.reduceat(self.shares[rows], starts) / sizes).tolist()

    def score(self, texts: list[str | None]) -> list[float]:
        """The scores of some texts; shares of words seen lately are looked up."""
        split = [(text or "").lower().split() for text in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        if new:
            self.known.update(zip(new, self.words(new)))
        share = self.known.__getitem__
        means = np.array([sum(map(share, words)) / (len(words) + NEUTRAL)
                          for words in split])
        return (1 / (1 + np.exp(-np.clip(means + self.constant, -30, 30)))).tolist()


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit table and softmax together by AdaGrad on batches of texts."""
    labels = np.asarray(labels, np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(ROWS, np.float32), 30.0 if share else -30.0)
    random = np.random.default_rng(SEED)
    table = random.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
    weights = random.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    offset = np.log(np.array([1 - share, share], np.float32))
    seen = np.full(ROWS, 1e-8, np.float32)
    seen_weights = np.full_like(weights, 1e-8)
    seen_offset = np.full_like(offset, 1e-8)
    for _ in range(-(-STEPS * BATCH // len(bags))):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            sizes = np.array([len(bags[i][0]) for i in chosen])
            rows = np.concatenate([bags[i][0] for i in chosen])
            parts = np.concatenate([bags[i][1] for i in chosen])
            text = np.repeat(np.arange(len(chosen)), sizes)
            entries = table[rows] * parts[:, None]
            means = np.stack([np.bincount(text, entries[:, d], len(chosen))
                              for d in range(WIDTH)], axis=1).astype(np.float32)
            logits = means @ weights + offset
            logits -= logits.max(axis=1, keepdims=True)
            wrong = np.exp(logits)
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(chosen)), labels[chosen]] -= 1
            slope = (wrong @ weights.T)[text] * parts[:, None]
            used, place = np.unique(rows, return_inverse=True)
            step = np.stack([np.bincount(place, slope[:, d], len(used))
                             for d in range(WIDTH)], axis=1).astype(np.float32)
            step += DECAY * table[used]
            seen[used] += (step * step).mean(axis=1)
            table[used] -= RATE * step / np.sqrt(seen[used])[:, None]
            step = means.T @ wrong / len(chosen)
            seen_weights += step * step
            weights -= 0.1 * RATE * step / np.sqrt(seen_weights)
            step = wrong.mean(axis=0)
            seen_offset += step * step
            offset -= 0.1 * RATE * step / np.sqrt(seen_offset)
    line = weights[:, 1] - weights[:, 0]
    return Model((table @ line).astype(np.float32), float(offset[1] - offset[0]))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether an id is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``limit`` rows ``(doc_id, toxic, text)`` that may be learned from."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (known.filter("toxic = 1").orderBy(*order).limit(limit // 3)
              .unionByName(known.filter("toxic = 0").orderBy(*order)
                           .limit(limit - limit // 3)))
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """Train on the sample. Tasks make the bags; the driver gets a bounded number."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"],
                 pa.array([b[0] for b in bags], pa.list_(pa.int32())),
                 pa.array([b[1] for b in bags], pa.list_(pa.float32()))],
                ["doc_id", "toxic", "rows", "parts"])

    # repeated ids would go over the bound; one row of each is enough
    found = (sample(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), labels, limit)
             .groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"),
                                    F.max("toxic").alias("toxic"))
             .select("doc_id", "toxic", "text")
             .mapInArrow(make, "doc_id bigint, toxic int, rows array<int>, "
                               "parts array<float>").toArrow().sort_by("doc_id"))
    bags = [(r.values.to_numpy(zero_copy_only=False), p.values.to_numpy(zero_copy_only=False))
            for r, p in zip(found["rows"], found["parts"])]
    return train(bags, found["toxic"].to_numpy())


def scored(docs: DataFrame, model: Model, text: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score``, the chance that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.shares, model.constant))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SCORE_ROWS):
                batch = whole.slice(at, SCORE_ROWS)
                found = known.score(batch["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[batch[name] for name in keep], pa.array(found, pa.float64())],
                    [*keep, "score"])

    return rows.mapInArrow(make, ", ".join([*kept, "score double"]))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    return scored(docs, fit(docs, labels, limit), "text", "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
