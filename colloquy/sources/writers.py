"""Writers, and exports of a turn table to the layouts the readers know.

A JSON layout holds a dialogue in one value, so exports cut conversations into pieces
of bounded length. Each says of which conversation it is and where it begins, in
fields that other readers ignore and ours put together again. The text
layout has no place for that and is written line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from colloquy.functions.numbers import whole_part
from colloquy.operators.metrics import history_columnar
from colloquy.operators.turns import assembled


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows with ``split``, ``shard``, ``conv_id`` and ``turn`` in order, a
    folder per split and shard. No file has rows of two shards.

    A shard is a number of conversations. Ranges are cut on the whole order, so
    one with long conversations is several files, written by several tasks.
    """
    order = ["split", "shard", "conv_id", "turn"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("split", "shard").parquet(path))


def append_events(events: DataFrame, path: str) -> None:
    """Append scalar log events."""
    events.write.mode("append").parquet(path)


def write_history(wide: DataFrame, path: str) -> None:
    """Columnar JSON, one document per run."""
    history_columnar(wide).write.mode("overwrite").json(path)


def write_lines(table: DataFrame, column: str, path: str) -> None:
    """One text line per row."""
    table.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_metric_text(summary: DataFrame, path: str) -> None:
    """The two-line text form of a metric summary, a handful of rows."""
    triple = F.concat_ws(",", *[F.col(c).cast("string")
                                for c in ("mean", "std", "confidence")])
    rows = F.sort_array(F.collect_list(F.struct("metric", triple.alias("triple"))))
    line = lambda label, field: F.concat_ws(" ", F.lit(label), F.array_join(
        F.transform("rows", lambda r: r[field]), " "))
    (summary.groupBy().agg(rows.alias("rows"))
     .select(F.concat_ws("\n", line("metrics", "metric"), line("values", "triple")))
     .write.mode("overwrite").text(path))


def _pieces(turns: DataFrame) -> DataFrame:
    """Pieces of conversations with their ``split``, if there is one."""
    split = [F.first("split").alias("split")] if "split" in turns.columns else []
    return assembled(turns, *split)


def _with_split_folders(rows: DataFrame, split: bool):
    writer = rows.write.mode("overwrite")
    return writer.partitionBy("split") if split else writer


def write_jsonl(turns: DataFrame, path: str) -> None:
    """One JSON object per line; a folder per split if there is a ``split``."""
    split = "split" in turns.columns
    texts = F.transform("utterances", lambda t: F.struct(t.alias("text")))
    rows = _pieces(turns).select(*["split"] * split, texts.alias("dialogue"), "conv_id",
                                 "first_turn")
    _with_split_folders(rows, split).json(path)


# A document is parsed as a whole, so it gets about this many bytes of text.
DOCUMENT_BYTES = 16 << 20


def _documents(pieces: DataFrame) -> DataFrame:
    """Number the pieces by the document they go to: ``document`` counts the bytes
    before them within their range of conversations."""
    size = F.aggregate("utterances", F.lit(0).cast("bigint"),
                       lambda n, t: n + F.octet_length(t) + 16)
    before = Window.partitionBy("_part").orderBy("conv_id", "segment").rowsBetween(
        Window.unboundedPreceding, -1)
    return (pieces.repartitionByRange("conv_id", "segment")
            .withColumn("_part", F.spark_partition_id())
            .withColumn("document", F.struct("_part", whole_part(
                F.coalesce(F.sum(size).over(before), F.lit(0)), DOCUMENT_BYTES))))


def write_nested_json(turns: DataFrame, path: str) -> None:
    """Documents of dialogues, each its history and last candidate. Conversations
    of split ``valid`` are the document's ``valid`` part, all others ``train``."""
    size = F.size("utterances")
    entry = F.struct(
        F.slice("utterances", F.lit(1), size - 1).alias("history"),
        F.array(F.element_at("utterances", -1)).alias("candidates"))
    dialog = F.struct(F.array(entry).alias("utterances"), "conv_id", "first_turn")
    valid = (F.coalesce(F.col("split") == "valid", F.lit(False)) if "split" in turns.columns
             else F.lit(False))
    (_documents(_pieces(turns)).groupBy("document")
     .agg(F.collect_list(F.when(~valid, dialog)).alias("train"),
          F.collect_list(F.when(valid, dialog)).alias("valid"))
     .select("train", "valid")
     .write.mode("overwrite").option("maxRecordsPerFile", 1).json(path))


def write_map_json(turns: DataFrame, path: str) -> None:
    """Documents of dialogues keyed by conversation and segment; a folder per
    split if there is a ``split``."""
    split = "split" in turns.columns
    messages = F.transform("utterances", lambda t: F.struct(t.alias("message")))
    entry = F.struct(F.concat_ws("-", "conv_id", "segment").alias("key"),
                     F.struct(messages.alias("content"), "conv_id", "first_turn")
                     .alias("value"))
    doc = F.map_from_entries(F.collect_list(entry))
    rows = (_documents(_pieces(turns)).groupBy("document", *["split"] * split)
            .agg(doc.alias("doc")).select(*["split"] * split, F.to_json("doc").alias("value")))
    _with_split_folders(rows, split).option("maxRecordsPerFile", 1).text(path)


def write_blankline_text(turns: DataFrame, path: str) -> None:
    """One line per utterance, a blank line after each dialogue; a folder per split
    if there is a ``split``.

    A dialogue's lines must follow each other in one file, so one task writes a
    conversation, row by row.
    """
    split = "split" in turns.columns
    order = Window.partitionBy("conv_id").orderBy("turn")
    last = F.lead("turn").over(order).isNull()
    rows = turns.select(*["split"] * split, F.when(last, F.concat("text", F.lit("\n")))
                        .otherwise(F.col("text")).alias("value"))
    _with_split_folders(rows, split).text(path)
