"""Deterministic identifiers and pseudo-random orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def config_fingerprint(max_hist: Column, file_size: Column) -> Column:
    """Last eight decimal digits of the SHA-1 of both settings in a row.

    The 160-bit number is reduced modulo 10^8 in five chunks of 32 bits, which
    keeps every step within a bigint.
    """
    digest = F.sha1(F.concat(max_hist.cast("string"), file_size.cast("string")))
    chunks = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
              for i in range(5)]
    modulus = F.lit(100_000_000)
    remainder = reduce(
        lambda acc, c: F.pmod(acc * F.lit(4_294_967_296) + c, modulus),
        chunks, F.lit(0).cast("bigint"))
    return F.lpad(remainder.cast("string"), 8, "0")


def shuffle_key(*parts: Column) -> Column:
    """A 32-digit hex key that orders rows pseudo-randomly and repeatably."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def key_bin(key: Column) -> Column:
    """The first three hex digits of a shuffle key as a number, in key order."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def unit_draw(*parts: Column) -> Column:
    """A repeatable number strictly between 0 and 1."""
    head = F.conv(F.substring(shuffle_key(*parts), 1, 8), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(4294967296.0)
