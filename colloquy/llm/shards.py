"""Words of many texts as arrays of numbers, a shard of bounded text at a time.

Texts are read as bytes: A-Z become a-z, runs of word bytes become words, and each
different word of a shard gets a number. Nothing here works on one text or word
at a time. All bytes that divide words or texts are ASCII, so no letter of more
bytes is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A shard is closed when its texts have this many bytes. One text is never cut.
SHARD_BYTES = 12 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += ord("a") - ord("A")
WORD, BLANK, CUT = 0, 1, 2


def kinds(blanks: str, cuts: str = "") -> np.ndarray:
    """What each byte is: part of a word, blank between words, or cut of the text."""
    table = np.full(256, WORD, np.int8)
    table[list(blanks.encode())] = BLANK
    table[list(cuts.encode())] = CUT
    return table


def blocks(batches: Iterator[pa.RecordBatch], text: str,
           limit: int = SHARD_BYTES) -> Iterator[pa.Table]:
    """The rows again, in tables of about ``limit`` bytes of ``text``."""
    held: list[pa.RecordBatch] = []
    room = limit
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, done + room)) + 1
            part = batch.slice(start, stop - start)
            held.append(part)
            used = int(ends[min(stop, batch.num_rows) - 1]) - done
            start, done, room = stop, done + used, room - used
            if room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], limit
    if held:
        yield pa.Table.from_batches(held)


def joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and where each begins;
    a null text is empty."""
    ended = pc.binary_join_element_wise(
        pc.fill_null(texts, "").cast(pa.large_string()),
        pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    if isinstance(ended, pa.ChunkedArray):
        ended = pa.concat_arrays(ended.chunks)
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[
        ended.offset:ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0]


def tokenized(data: np.ndarray, table: np.ndarray
              ) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, the number of each word in turn, where it begins, and
    how many cuts stand before it."""
    kind = table[data]
    inside = kind == WORD
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = LOWER[data[inside]]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    cuts = np.searchsorted(np.flatnonzero(kind == CUT), starts)
    return (words.dictionary.cast(pa.binary()),
            words.indices.to_numpy(zero_copy_only=False), starts, cuts)


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize * size
    return np.frombuffer(pa.decompress(data, width, "zstd", asbytes=True), kind)
