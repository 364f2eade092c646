"""Tokens of a document attributed to its sections by their offsets.

A document is encoded once, as a whole. The tokens' spans of bytes follow from the
lengths of the vocabulary's strings, and are joined with the spans of the sections by a
search in the sorted ends. A token that crosses a border goes to one section, by an
explicit rule: ``first`` gives it to the section in which it begins, ``last`` to
the one in which it ends, ``most`` to the one with most of its bytes, the first of
several. So the counts of the sections add up to the tokens of the document.

Sections are lines, the line feed being part of the line that it ends, unless the
caller names a column with the places (in characters, ascending) where they begin.
Text before the first place is a section of its own.

Cases: a null or empty text is one empty section without tokens; places beyond the
text or null are left out; special tokens are ordinary text; repeated rows
are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.bpe import PIECES

RULES = ("first", "last", "most")
OUT_ROWS = 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The codec of a file of ranks, and the length of each token in bytes."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks,
                             special_tokens={}), sizes


def line_starts(data: np.ndarray) -> np.ndarray:
    """Places in bytes where lines begin."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(data)]])


def byte_starts(data: np.ndarray, places: list[int | None]) -> np.ndarray:
    """Places in characters as places in bytes, with 0 in front."""
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    inside = [p for p in places if p is not None and 0 < p < len(letters)]
    return np.unique(np.concatenate([[0], letters[np.array(inside, np.int64)]]))


def attributed(sizes: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """How many tokens of the given sizes each section gets."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = np.searchsorted(starts, begins, side="right") - 1
    if rule == "first":
        owner = first
    else:
        last = np.searchsorted(starts, ends - 1, side="right") - 1
        owner = last
        if rule == "most":
            owner = first.copy()
            borders = np.append(starts, ends[-1] if len(ends) else 0)
            for at in np.flatnonzero(first != last):
                cut = np.clip(borders[first[at]:last[at] + 2], begins[at], ends[at])
                owner[at] = first[at] + int(np.argmax(np.diff(cut)))
    return np.bincount(owner, minlength=len(starts))


def section_tokens(docs: DataFrame, ranks: str, *keep: str, text: str = "text",
                   starts: str | None = None, rule: str = "first") -> DataFrame:
    """The columns ``keep`` and one row for each section: ``section`` (from 0),
    ``first_char``, ``n_chars`` and ``n_tokens``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule}")
    rows = docs.select(*keep, F.col(text).alias("_text"),
                       *([F.col(starts).cast("array<bigint>").alias("_starts")]
                         if starts else []))
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    names = ["section", "first_char", "n_chars", "n_tokens"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sizes = encoder(ranks)

        def found(value: str, places: list | None) -> np.ndarray:
            data = np.frombuffer(value.encode(), np.uint8)
            begins = line_starts(data) if places is None else byte_starts(data, places)
            tokens = sizes[codec.encode_ordinary(value)] if value else sizes[:0]
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = letters[np.append(begins, len(data))]
            return np.stack([np.arange(len(begins)), chars[:-1], np.diff(chars),
                             attributed(tokens, begins, rule)])

        for batch in batches:
            held, sources, rows_held = [], [], 0
            for at, value in enumerate(batch["_text"].to_pylist()):
                places = (batch["_starts"][at].as_py() or []) if starts else None
                part = found(value or "", places)
                held.append(part)
                sources.append(np.full(part.shape[1], at))
                rows_held += part.shape[1]
                if rows_held >= OUT_ROWS or at == batch.num_rows - 1:
                    origin = pa.array(np.concatenate(sources))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch[name].take(origin) for name in keep],
                         *map(pa.array, np.concatenate(held, axis=1).astype(np.int64))],
                        [*keep, *names])
                    held, sources, rows_held = [], [], 0

    return rows.mapInArrow(make, ", ".join([*kept, *[f"{n} bigint" for n in names]]))
