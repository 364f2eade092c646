"""Settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Token strings and their order are part of the data format.
SP1 = "<sp1>"
SP2 = "<sp2>"
HST = "<hst>"
RSP = "<rsp>"
PAD = "<pad>"
UNK = "<unk>"
BOS = "<s>"
EOS = "</s>"
MASK = "<mask>"
BASE_SPECIALS = (UNK, BOS, EOS, MASK)
ADDED_SPECIALS = (SP1, SP2, HST, RSP, PAD)
SPECIALS = BASE_SPECIALS + ADDED_SPECIALS
SPLITS = ("train", "valid", "test")

# A conversation is processed in pieces of this many turns, so that one very
# long conversation spreads over many tasks instead of landing in one.
SEGMENT_TURNS = 512

# A vocabulary is broadcast up to this many tokens of at most this many bytes;
# what lies beyond goes through a shuffled join.
BROADCAST_TOKENS = 1 << 18
BROADCAST_TOKEN_BYTES = 128
# Ids follow frequency: a token with over a thousandth of all has an id below this,
# and is broadcast up to a larger size.
HOT_TOKENS = 1 << 10
HOT_TOKEN_BYTES = 1 << 14


@dataclass(frozen=True)
class SpecialIds:
    """Token ids of the special tokens."""

    sp1: int
    sp2: int
    bos: int
    eos: int
    hst: int
    rsp: int
    pad: int
    unk: int = 0
    mask: int = 3

    def all(self) -> list[int]:
        return [self.sp1, self.sp2, self.bos, self.eos, self.hst,
                self.rsp, self.pad, self.unk, self.mask]


@dataclass(frozen=True)
class CorpusConfig:
    """Knobs of corpus preparation, with the customary defaults."""

    max_hist: int = 2
    max_len: int = 50
    file_size: int = 100_000
    bucket_size: int = 1000
    batch_size: int = 64
    world_size: int = 1
    seed: int = 0
    epoch: int = 0

    def __post_init__(self):
        for name in ("max_hist", "max_len", "file_size", "bucket_size",
                     "batch_size", "world_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, "
                                 f"got {getattr(self, name)}")
