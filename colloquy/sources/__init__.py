"""Readers and writers. A reader gives ``(split, conv_id, turn, text)``."""

from colloquy.sources.readers import SOURCES, read_source, register_source

__all__ = ["SOURCES", "read_source", "register_source"]
