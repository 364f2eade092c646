"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's str.split and str.strip see it.
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove whitespace, Unicode spaces included, from both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words; no empty strings, never null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def ids_text(ids: Column) -> Column:
    """A list of numbers as space-separated text."""
    return F.array_join(ids.cast("array<string>"), " ")


def file_stem(path: Column) -> Column:
    """``/a/b/train.json`` -> ``train``."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def split_of_path(path: Column) -> Column:
    """The split that a file belongs to: the folder it lies in, if that is named
    ``train``, ``valid`` or ``test`` (or ``split=train`` and so on), or else the
    name up to the first character that is no letter. Anything else fails."""
    folder = F.regexp_extract(path, r"(?:^|/)(?:split=)?(train|valid|test)/[^/]*$", 1)
    name = F.regexp_extract(path, r"(?:^|/)(train|valid|test)(?![A-Za-z])[^/]*$", 1)
    return (F.when(folder != "", folder).when(name != "", name).otherwise(F.raise_error(
        F.concat(F.lit("no split in the name of "), path))))


def prompt_of(rendered: Column) -> Column:
    """The prompt part of a rendered example: all before the last ``<sp1>``,
    speaker marks replaced by spaces, stripped."""
    parts = F.split(rendered, "<sp1>")
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return strip(F.replace(F.array_join(before, " "), F.lit("<sp2>"), F.lit(" ")))


def reply_of(rendered: Column) -> Column:
    """The reply part of a rendered example: what follows the last ``<sp1>``."""
    return F.element_at(F.split(rendered, "<sp1>"), -1)
