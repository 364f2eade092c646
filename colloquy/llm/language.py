"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent n-grams, of one to three
letters, in order of frequency over all texts that may be learned from. A document's
own most frequent n-grams are ranked in the same way, and compared with each
profile: an n-gram adds the distance between its two ranks, or the length of the
profile if it is missing there. The language with the least sum is predicted.

N-grams are counted within words of lower-case letters, with a mark on both edges.
Letters of 18 bits make one exact number, with a mark for the length, so nothing is
hashed. Counting
and scoring run over whole texts, long ones piece by piece. Profiles have a fixed length, and
languages are checked to be few before the profiles go to the tasks.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
there is nothing to learn from; a null id is learned from and not held out; ties
go to the language that is first by code point; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PROFILE = 300
# Every letter is below 2**18.
BITS = 18
MARK_TWO, MARK_THREE = 1 << 60, 1 << 61
MAX_LANGUAGES = 1000
# Letters that are counted at once.
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point the lower-case letter it counts as, or 0."""
    table = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts, starts)


def _piece_ngrams(letters: np.ndarray, before: int) -> np.ndarray:
    """Numbers of the n-grams in words that a 0 separates. The 0 before or after
    a word may be part of an n-gram, as the mark of an edge. Of n-grams that end
    in the first ``before`` letters none is counted."""
    inside = letters > 0
    two = (letters[:-1] << BITS) | letters[1:]
    three = (two[:-1] << BITS) | letters[2:]
    return np.concatenate([
        letters[before:][inside[before:]],
        (two | MARK_TWO)[before // 2:][(inside[:-1] | inside[1:])[before // 2:]],
        (three | MARK_THREE)[inside[1:-1]]])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, ascending, and their counts."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    all_codes, all_counts = [none], [none]
    for at in range(0, len(points), PIECE):
        # two letters before a piece belong to its first n-grams
        letters = _lower_letters()[points[max(at - 2, 0):at + PIECE]]
        if at == 0:
            letters = np.concatenate([np.zeros(1, np.int64), letters])
        if at + PIECE >= len(points):
            letters = np.concatenate([letters, np.zeros(1, np.int64)])
        codes = np.sort(_piece_ngrams(letters, 2 if at else 0))
        if len(codes):
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            all_codes.append(codes[starts])
            all_counts.append(np.diff(np.append(starts, len(codes))))
    codes, counts = np.concatenate(all_codes), np.concatenate(all_counts)
    return _summed(codes, counts) if len(all_codes) > 2 and len(codes) else (codes, counts)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order of frequency, ties by number."""
    if len(codes) > most:
        least = np.partition(counts, -most)[-most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    """Profiles ready for comparison."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.sorted, self.ranks = [], []
        for name in self.names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            self.sorted.append(codes[order])
            self.ranks.append(order)

    def distances(self, found: np.ndarray) -> np.ndarray:
        """The out-of-place distance of ranked n-grams to each profile."""
        own = np.arange(len(found))
        out = np.empty(len(self.names), np.int64)
        for n, (codes, ranks) in enumerate(zip(self.sorted, self.ranks)):
            at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            away = np.where(codes[at] == found, np.abs(ranks[at] - own), PROFILE)
            out[n] = np.minimum(away, PROFILE).sum()
        return out

    def best(self, text: str | None) -> tuple[str, float]:
        """The language and how much of the greatest distance it stays below."""
        found = ranked(*ngrams(text))
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        distances = self.distances(found)
        least = int(np.argmin(distances))
        return self.names[least], 1.0 - float(distances[least]) / (PROFILE * len(found))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether an id is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, code, n)``: how often each language's texts have an n-gram."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple] = {}
        for batch in batches:
            fresh: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                fresh.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, found in fresh.items():
                found.append(totals.get(lang, (np.empty(0, np.int64),) * 2))
                codes, numbers = (np.concatenate(part) for part in zip(*found))
                if len(codes):
                    totals[lang] = _summed(codes, numbers)
        for lang, (codes, numbers) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes),
                 pa.array(numbers)], ["lang", "code", "n"])

    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    return (known.mapInArrow(make, "lang string, code bigint, n bigint")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame) -> dict[str, list[int]]:
    """The profile of each language that ``docs`` have texts of."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    found = (counts(docs).withColumn("rank", F.row_number().over(order))
             .filter(F.col("rank") <= PROFILE).groupBy("lang")
             .agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("codes")))
    rows = found.select("lang", "codes.code").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {row["lang"]: row["code"] for row in rows}


def predicted(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text",
              *keep: str) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(shared.value)
        for batch in batches:
            found = [known.best(t.as_py()) for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays(
                [*[batch[name] for name in keep],
                 pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                [*keep, "lang_pred", "score"])

    return rows.mapInArrow(make, ", ".join([*kept, "lang_pred string, score double"]))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``, learned
    from the rows that are not held out."""
    profiles = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predicted(docs, profiles, "text", "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
