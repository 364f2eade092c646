"""Byte-level BPE: encoding with a queue of merges, decoding by concatenation.

A text is cut at special tokens and then into pieces by a pattern. In a piece, each
byte is a symbol; symbols form a doubly linked list, and a priority queue holds the
merges that neighbours allow, by rank and then by place. An entry is stale if one
of its symbols has changed since, and is skipped. Decoding puts the vocabulary's
byte strings one after another.

The vocabulary file is read once by each Python worker; its path is a parameter,
and every worker must be able to read it. Texts are cut into chunks at blanks, and long
chunks into pieces; a batch of texts encodes each of its different chunks once, and
puts ids and decoded bytes of texts together by the numbers of their chunks. Chunks
and pieces seen before are looked up: two tables of bounded size hold the last ones.

Cases: a null text counts as empty and has no tokens; ids that are null decode to the
empty text; bytes that are no UTF-8 become replacement characters; repeated
rows are encoded each; other columns pass through where asked for.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

# Fixed value: the pattern that this kind of vocabulary was made with.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
          r"|\s+(?!\S)|\s+")
# Marks a chunk that is a special token.
SPECIAL = "\x00"
UNEVEN = re.compile(r" (?:\s|$)")
FIRM = re.compile(r" (?=\S)")
CACHE_PIECES = 300_000
CACHE_PIECE_CHARS = 64
# Rows and bytes of text that are passed on at once.
OUT_ROWS = 512
OUT_CHARS = 4 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes stand for themselves,
    the others take the letters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
             *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


class Codec:
    """One vocabulary file, and tables of up to ``held`` pieces seen before."""

    def __init__(self, path: str, held: int | None = None):
        self.held = held or CACHE_PIECES
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.strings = {i: bytes(letters[c] for c in token)
                        for token, i in vocabulary.items()}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.strings |= {i: s.encode() for s, i in specials.items()}
        self.specials = specials
        longest_first = sorted(specials, key=len, reverse=True)
        self.special_pattern = re.compile(
            "(" + "|".join(map(re.escape, longest_first)) + ")") if specials else None
        self.byte_ids = [0] * 256
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary[letter]
        # a pair of symbols is one number; ranks lead to what merges into what
        self.width = 1 + max(self.strings)
        self.pairs = []
        self.ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocabulary[left], vocabulary[right]
            self.pairs.append((*pair, vocabulary[left + right]))
            self.ranks[pair[0] * self.width + pair[1]] = rank
        self.pieces = regex.compile(PIECES)
        self.piece_ids: dict[str, array] = {}
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        size = len(ids)
        if size < 2:
            return ids
        rank_of, pairs, width = self.ranks.get, self.pairs, self.width
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        # an entry is rank and place in one number, as they are to be ordered
        queue = []
        for at in range(size - 1):
            rank = rank_of(ids[at] * width + ids[at + 1])
            if rank is not None:
                queue.append(rank * size + at)
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), size)
            left, right, new = pairs[rank]
            nxt = after[at]
            if ids[at] != left or nxt >= size or ids[nxt] != right:
                continue  # stale: a symbol has been merged since
            ids[at], ids[nxt] = new, -1
            following = after[at] = after[nxt]
            if following < size:
                before[following] = at
                rank = rank_of(new * width + ids[following])
                if rank is not None:
                    heapq.heappush(queue, rank * size + at)
            earlier = before[at]
            if earlier >= 0:
                rank = rank_of(ids[earlier] * width + new)
                if rank is not None:
                    heapq.heappush(queue, rank * size + earlier)
        return [i for i in ids if i >= 0]

    def _remember(self, key: str, known: tuple) -> None:
        if len(key) > CACHE_PIECE_CHARS:
            return
        if len(self.young) >= self.held:
            self.old, self.young = self.young, {}
        self.young[key] = known

    def _known(self, ids: list[int]) -> tuple[bytes, bytes]:
        strings = self.strings
        return array("i", ids).tobytes(), b"".join([strings[i] for i in ids])

    def _piece(self, piece: str) -> array:
        """The ids of one of several pieces of a chunk."""
        found = self.piece_ids.get(piece)
        if found is None:
            whole = self.young.get(piece) or self.old.get(piece)
            found = array("i", whole[0]) if whole else array("i", self.merged(piece.encode()))
            if len(piece) <= CACHE_PIECE_CHARS:
                if len(self.piece_ids) >= self.held:
                    self.piece_ids = {}
                self.piece_ids[piece] = found
        return found

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Packed ids and bytes of a part of a text that begins and ends between pieces."""
        known = self.young.get(chunk) or self.old.get(chunk)
        if known is None:
            pieces = self.pieces.findall(chunk)
            if len(pieces) == 1:
                ids = self.merged(chunk.encode())
            else:
                ids = []
                for piece in pieces:
                    ids.extend(self._piece(piece))
            known = self._known(ids)
        self._remember(chunk, known)
        return known

    def _plain(self, text: str) -> list[str]:
        """The chunks of a text without special tokens."""
        # A blank before anything but white space begins a piece, whatever stands
        # before it, so the text can be cut there.
        if UNEVEN.search(text):
            chunks = FIRM.split(text)
        else:
            chunks = text.split(" ")
        first = chunks[0]
        chunks = [" " + c for c in chunks]
        chunks[0] = first
        return chunks if first else chunks[1:]

    def chunks(self, text: str | None) -> list[str]:
        """The parts of a text that are encoded one by one. Special tokens are parts of
        their own."""
        if not text:
            return []
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._plain(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            if part in self.specials:
                out.append(SPECIAL + part)
            elif part:
                out.extend(self._plain(part))
        return out

    def coded(self, chunk: str) -> tuple[bytes, bytes]:
        if chunk.startswith(SPECIAL) and chunk[1:] in self.specials:
            return self._known([self.specials[chunk[1:]]])
        return self.chunk(chunk)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of some texts one after another, the number of each text, and the bytes
        that each decodes to."""
        numbers: dict[str, int] = {}
        number = numbers.setdefault
        parts, ends = [], []
        for text in texts:
            chunks = self.chunks(text)
            parts.append([number(c, len(numbers)) for c in chunks])
            ends.append(len(chunks))
        known = [self.coded(c) for c in numbers]
        sizes = np.array([len(k[0]) // 4 for k in known], np.int64)
        order = np.fromiter(chain.from_iterable(parts), np.int64, sum(ends))
        taken = sizes[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])[order] if len(known) else order
        # ids of chunk n lie together from starts[n] on
        into = np.repeat(starts - (np.cumsum(taken) - taken), taken)
        flat = np.frombuffer(b"".join([k[0] for k in known]), np.int32)
        ids = flat[into + np.arange(len(into))]
        counts = np.concatenate([[0], np.cumsum(taken)])[np.cumsum([0, *ends])]
        strings = [k[1] for k in known]
        return ids, np.diff(counts), [b"".join([strings[n] for n in part]) for part in parts]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, held: int | None = None) -> Codec:
    return Codec(path, held)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded rows and, but for single rows, bounded text."""
    start = chars = 0
    sizes = pc.fill_null(pc.utf8_length(batch[column]), 0)
    for at, size in enumerate(sizes.to_pylist()):
        if at > start and (at - start >= OUT_ROWS or chars + size > OUT_CHARS):
            yield batch.slice(start, at - start)
            start, chars = at, 0
        chars += size
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(docs: DataFrame, vocabulary: str, *keep: str, text: str = "text",
           decoded: bool = False, held: int | None = None) -> DataFrame:
    """The columns ``keep``, ``ids`` as an array and, if asked for, ``decoded``: the
    text that the ids give. Fewer pieces ``held`` take less memory of a Python worker and
    more time; the results are the same."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    ddl = ", ".join([*kept, "ids array<int>"] + ["decoded string"] * decoded)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary, held)
        for batch in (part for whole in batches for part in _slices(whole, "_text")):
            ids, counts, texts = known.encode_all(batch["_text"].to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            arrays = [*[batch[name] for name in keep], lists]
            yield pa.RecordBatch.from_arrays(
                arrays + ([pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]
                          if decoded else []),
                [*keep, "ids"] + ["decoded"] * decoded)

    return rows.mapInArrow(make, ddl)


def decode(rows: DataFrame, vocabulary: str, *keep: str, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text of the array ``ids``."""
    rows = rows.select(*keep, F.col(ids).alias("_ids"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                texts = [known.decode(i.as_py() or ()) for i in part["_ids"]]
                yield pa.RecordBatch.from_arrays(
                    [*[part[name] for name in keep], pa.array(texts, pa.string())],
                    [*keep, "decoded"])

    return rows.mapInArrow(make, ", ".join([*kept, "decoded string"]))
