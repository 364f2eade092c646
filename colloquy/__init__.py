"""Dialogue corpora on Spark: ingest, examples, batches, metrics, decoding."""

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.session import build_session

__all__ = ["CorpusConfig", "SpecialIds", "build_session"]
