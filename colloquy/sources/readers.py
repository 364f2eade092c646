"""Dialogue layouts, all read into ``(split, conv_id, turn, text)``.

A split may be any number of files: the folder or the beginning of the file's name
says ``train``, ``valid`` or ``test``. Input that cannot be parsed fails the read.

``conv_id`` is unique within one read. Layouts have no ids of their own, but files
from our writers may say that a dialogue is a piece of conversation ``conv_id``
that begins at turn ``first_turn``; then these are taken, and the pieces are one
conversation again. A source either has them throughout or not at all. Write the
result as Parquet once and work from there (``plans.corpus`` does).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.functions.text import file_stem, split_of_path, strip
from colloquy.operators.ranking import ranked, small_side
from colloquy.sources import json_ranges

Reader = Callable[[SparkSession, str], DataFrame]

PIECE = "conv_id bigint, first_turn bigint"
BROKEN = "_corrupt_record"
JSONL_SCHEMA = f"dialogue array<struct<text string>>, {PIECE}, {BROKEN} string"
NESTED_DIALOG = ("utterances array<struct<history array<string>, candidates array<string>>>, "
                 + PIECE)
MAP_DIALOG = f"content array<struct<message string>>, {PIECE}"
# A JSON string, and what may stand before a dialogue of either layout.
STRING = r'"(?:[^"\\]|\\.)*"'
NEXT = r"^\s*,\s*$"
LIST_OF = rf"({STRING})\s*:\s*\[\s*$"
ENTRY = rf"^\s*([{{,])\s*({STRING})\s*:\s*$"


def _split() -> Column:
    return split_of_path(F.col("_metadata.file_path")).alias("split")


def _needed(value: Column, fine: Column, what: str) -> Column:
    """``value``, failing the read where ``fine`` does not hold."""
    return F.when(F.coalesce(fine, F.lit(False)), value).otherwise(F.raise_error(
        F.concat(F.lit(f"{what} in "), F.col("_file"))))


def _as_turns(dialogs: DataFrame) -> DataFrame:
    """``(split, conv_id, first_turn, utterances)`` to one row per utterance."""
    numbered = dialogs.withColumn("conv_id", F.coalesce(
        "conv_id", F.monotonically_increasing_id()))
    return (numbered.select("split", "conv_id", "first_turn",
                            F.posexplode("utterances").alias("turn", "text"))
            .select("split", "conv_id",
                    (F.coalesce("first_turn", F.lit(0)) + F.col("turn")).alias("turn"),
                    "text"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line with a ``dialogue`` list of ``{text}``. Only ``text``
    is parsed; a line that is no such object fails the read."""
    lines = spark.read.schema(JSONL_SCHEMA).option(
        "columnNameOfCorruptRecord", BROKEN).json(path).select(
        "dialogue", "conv_id", "first_turn", BROKEN,
        F.col("_metadata.file_path").alias("_file"), _split())
    fine = F.col(BROKEN).isNull() & F.col("dialogue").isNotNull()
    return _as_turns(lines.select("split", "conv_id", "first_turn", _needed(
        F.col("dialogue.text"), fine, "a line without a dialogue").alias("utterances")))


def _parsed(body: Column, schema: str) -> Column:
    """A dialogue's object; one that cannot be parsed fails the read."""
    return F.from_json(body, schema, {"mode": "FAILFAST"})


def read_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents ``{train: [...], valid: [...]}``. A dialogue is the last entry
    of ``utterances``: its history and the last candidate. There is no test
    data in this layout; the validation dialogues serve as test as well, under
    ids of their own below zero where ids are given.

    A document is read by as many tasks as it has ranges (:mod:`json_ranges`).
    """
    found = json_ranges.objects(spark, path, 3).withColumnRenamed("file", "_file")
    name = F.regexp_extract("head", LIST_OF, 1)
    # objects that follow one another in a list share the name before the first
    lists = (found.where(~F.col("head").rlike(NEXT))
             .select("_file", F.col("number").alias("first"), "head", "body", name.alias("name")))
    lists = lists.withColumn("to", F.lead("first", default=1 << 62).over(
        Window.partitionBy("_file").orderBy("first")))
    heads = found.groupBy("_file").agg(*[
        F.max(F.col("head").rlike(rf'[{{,]\s*"{n}"\s*:\s*\[')).alias(n)
        for n in ("train", "valid")])
    whole = heads.select("_file", _needed(
        F.lit(True), F.col("train") & F.col("valid"), "no document of dialogues").alias("fine"))
    lists = lists.join(whole, "_file").where("fine")
    inside = (found.where("body <> ''").alias("o").join(small_side(lists).alias("l"), (
        F.col("o._file") == F.col("l._file")) & (F.col("number") >= F.col("first"))
        & (F.col("number") < F.col("to")))
        .select("o._file", "number", "o.head", "o.body", "name"))
    split_names = F.when(F.col("name") == '"train"', F.array(F.lit("train"))).when(
        F.col("name") == '"valid"', F.array(F.lit("valid"), F.lit("test")))
    last = F.try_element_at("dialog.utterances", F.lit(-1))
    reply = F.try_element_at(F.col("last.candidates"), F.lit(-1))
    fine = F.col("last.history").isNotNull() & reply.isNotNull()
    own_id = F.when(F.col("split") == "test", -1 - F.col("dialog.conv_id")).otherwise(
        F.col("dialog.conv_id"))
    # what other rows hold is not looked at, wherever the optimizer puts the checks
    used = (F.col("body") != "") & F.col("name").isin('"train"', '"valid"')
    divided = F.trim("head") != ""
    return _as_turns(
        inside.select("_file", F.explode(split_names).alias("split"), used.alias("used"),
                      F.when(used, _parsed(_needed(
                          F.col("body"), divided, "dialogues without a comma between them"),
                          NESTED_DIALOG)).alias("dialog"))
        .select("_file", "split", "used", own_id.alias("conv_id"), "dialog.first_turn",
                last.alias("last"))
        .select("split", "conv_id", "first_turn", F.when(F.col("used"), _needed(
            F.concat("last.history", F.array(reply)), fine,
            "a dialogue without history or candidates")).alias("utterances")))


def read_map_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents ``{id: {content: [{message}]}}`` in files named by split, with
    an optional ``_rare`` or ``_freq`` part. Where both parts of a split hold
    an id, the frequent one wins. Dialogues without an id of their own are numbered
    by split and key, so the numbers are the same in each read.

    A document is read by as many tasks as it has ranges (:mod:`json_ranges`).
    """
    found = json_ranges.objects(spark, path, 2).withColumnRenamed("file", "_file")
    entry = ((F.regexp_extract("head", ENTRY, 1) == F.when(F.col("number") == 0, "{")
              .otherwise(",")) & (F.regexp_extract("head", ENTRY, 2) != ""))
    key = _parsed(F.concat(F.lit('{"key":'), F.regexp_extract("head", ENTRY, 2), F.lit("}")),
                  "key string")["key"]
    empty = F.col("head").rlike(r"^\s*(\{\s*)?\}?\s*\}?\s*$")
    rows = found.select("_file", split_of_path(F.col("_file")).alias("split"), "number", "head",
                        _needed(F.col("body"), F.when(F.col("body") == "", empty)
                                .otherwise(entry), "no entry of a dialogue").alias("body"))
    used = F.col("body") != ""
    dialogs = (rows.where(used)
               .select("_file", "split", F.when(used, key).alias("key"), used.alias("used"),
                       F.when(used, _parsed(F.col("body"), MAP_DIALOG)).alias("dialog"))
               .select("split", file_stem(F.col("_file")).contains("_freq").cast("int")
                       .alias("rank"), "key", F.struct(
                   "dialog.conv_id", "dialog.first_turn", F.when(F.col("used"), _needed(
                       F.col("dialog.content.message"), F.col("dialog.content").isNotNull(),
                       "a dialogue without content")).alias("utterances")).alias("dialog")))
    merged = dialogs.groupBy("split", "key").agg(F.max_by("dialog", "rank").alias("dialog"))
    numbered = ranked(merged.select("split", "key", "dialog.*"), [],
                      [F.col("split"), F.col("key")], "number")
    return _as_turns(numbered.withColumn("conv_id", F.coalesce("conv_id", "number")))


def read_blankline_text(spark: SparkSession, path: str) -> DataFrame:
    """One utterance per line, a blank line between dialogues. The last dialogue
    counts with or without a blank line after it.

    Files are split at empty lines, so one file is read by many tasks. Blank
    lines that hold spaces are found within the pieces.
    """
    pieces = spark.read.text(path, lineSep="\n\n")
    newlines = F.regexp_replace("value", "\r\n?", "\n")
    lines = F.transform(F.split(F.col("dialog"), "\n"), strip)
    none = F.lit(None).cast("bigint")
    return _as_turns(
        pieces.select(_split(), F.explode(
            F.split(newlines, r"\n(?:(?U)[\s\x1c-\x1f])*\n")).alias("dialog"))
        .select("split", F.filter(lines, lambda t: t != "").alias("utterances"),
                none.alias("conv_id"), none.alias("first_turn"))
        .where(F.size("utterances") > 0))


SOURCES: dict[str, Reader] = {
    "jsonl": read_jsonl,
    "nested_json": read_nested_json,
    "map_json": read_map_json,
    "blankline_text": read_blankline_text,
    # public corpora by the layout they come in
    "dailydialog": read_jsonl,
    "personachat": read_nested_json,
    "topicalchat": read_map_json,
}


def register_source(name: str, reader: Reader) -> None:
    """Make a reader available by name."""
    SOURCES[name] = reader


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read a corpus by the name of its source."""
    if name not in SOURCES:
        raise ValueError(f"source must be one of {sorted(SOURCES)}, got {name!r}")
    return SOURCES[name](spark, path)


def scan_split(spark: SparkSession, path: str, split: str,
               shard: int | None = None) -> DataFrame:
    """One split, or one shard of it, of a table that ``write_shards`` has written;
    only its folder is read."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    if shard is not None:
        rows = rows.where(F.col("shard") == shard)
    return rows.withColumn("shard", F.col("shard").cast("bigint"))


HISTORY_SCHEMA = "epoch array<int>, " + ", ".join(
    f"{s}_{m} array<double>" for s in ("train", "valid") for m in ("loss", "acc", "ppl"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Columnar history documents, one row per epoch. ``run_id`` is read where
    a document has it."""
    docs = spark.read.schema("run_id bigint, " + HISTORY_SCHEMA).json(path)
    columns = [c for c in docs.columns if c != "run_id"]
    return docs.select("run_id", F.inline(F.arrays_zip(*columns)))


def read_metric_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines, names and ``mean,std,confidence`` triples, each after a
    leading label; to ``(metric, mean, std, confidence)``."""
    lines = F.split("value", "\r?\n")
    tokens = lambda i: F.split(strip(F.get(lines, i)), r"\s+")
    rest = lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    both = F.arrays_zip(rest(tokens(0)).alias("metric"), rest(tokens(1)).alias("triple"))
    parts = F.split("triple", ",")
    return (spark.read.text(path, wholetext=True)
            .select(F.inline(both).alias("metric", "triple"))
            .where("metric is not null and triple is not null")
            .select("metric", *[F.get(parts, i).cast("double").alias(n)
                                for i, n in enumerate(("mean", "std", "confidence"))]))
