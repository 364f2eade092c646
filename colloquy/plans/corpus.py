"""Preparing a corpus once and reading it back for training or evaluation."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.functions.hashing import config_fingerprint
from colloquy.functions.text import words
from colloquy.operators.batching import batch_plan, dialog_layout, with_shards
from colloquy.operators.collation import (
    batch_rows, collate, with_eval_masks, with_train_masks)
from colloquy.operators.examples import build_examples, example_index
from colloquy.operators.splits import split_manifest
from colloquy.operators.turns import with_segments, with_split
from colloquy.operators.vocabulary import (
    Vocabulary, build_vocab, encode, encoded_segments, stored_vocab, words_of)
from colloquy.session import staged
from colloquy.sources.readers import read_source
from colloquy.sources.writers import write_shards


@dataclass(frozen=True)
class Corpus:
    """The tables of a prepared corpus."""

    turns: DataFrame
    vocab: Vocabulary
    manifest: DataFrame
    config: CorpusConfig

    def segments(self) -> DataFrame:
        """Encoded turns laid out for example generation."""
        rows = self.turns.select(
            "conv_id", "turn", "n_ids",
            F.slice("ids", 1, self.config.max_len).alias("ids"))
        return with_segments(rows, self.config.max_hist)

    def index(self) -> DataFrame:
        return example_index(self.turns.select("conv_id", "turn", "n_ids"), self.config)

    def examples(self) -> DataFrame:
        return build_examples(self.segments(), self.vocab.ids, self.config)

    def batches(self, layout: str = "causal", training: bool = True,
                rank: int | None = None, masks: bool = False) -> DataFrame:
        """Padded batches; of one rank if ``rank`` is given. ``masks`` adds the
        permuted layout's masks, quadratic in the batch length."""
        if masks and layout != "permuted":
            raise ValueError("only the permuted layout has masks")
        plan = batch_plan(self.index(), self.turns, self.config, rank)
        rows = collate(batch_rows(plan, self.segments(), self.vocab.ids, self.config),
                       layout, self.vocab.ids.pad, training)
        if not masks:
            return rows
        return with_train_masks(rows) if training else with_eval_masks(rows)


def word_table(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, words)`` stored as Parquet, so that vocabulary, lengths and
    encoding share one pass over the text."""
    return staged(turns.select("conv_id", "turn", words(F.col("text")).alias("words")),
                  "words")


def token_counts(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, n_ids)``: lengths of the encoded turns before encoding."""
    return turns.select("conv_id", "turn", F.size(words_of(turns)).alias("n_ids"))


def text_index(turns: DataFrame, config: CorpusConfig) -> DataFrame:
    """The example index straight from text; only lengths are shuffled."""
    return example_index(token_counts(turns), config)


def text_examples(turns: DataFrame, config: CorpusConfig) -> DataFrame:
    """Examples straight from text with a vocabulary of its own."""
    turns = word_table(turns)
    vocab = build_vocab(turns)
    return build_examples(
        encoded_segments(turns, vocab, config.max_hist, config.max_len),
        vocab.ids, config)


def text_batches(turns: DataFrame, config: CorpusConfig) -> tuple[DataFrame, SpecialIds]:
    """Batch rows straight from text, ready for a collation layout."""
    turns = word_table(turns)
    vocab = build_vocab(turns)
    plan = batch_plan(text_index(turns, config), turns, config)
    encoded = encoded_segments(turns, vocab, config.max_hist, config.max_len)
    return batch_rows(plan, encoded, vocab.ids, config), vocab.ids


def fingerprint(spark: SparkSession, config: CorpusConfig) -> str:
    row = spark.range(1).select(config_fingerprint(
        F.lit(config.max_hist), F.lit(config.file_size)).alias("f"))
    return row.first()["f"]


def source_identity(spark: SparkSession, source: str | DataFrame, path: str) -> str:
    """What tells sources apart: for files the reader, the path and each file's
    name, size and time; for a table its rows in any order."""
    if isinstance(source, DataFrame):
        found, label = source, "table"
        columns = sorted(source.columns)
    else:
        found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .load(path).select("path", "modificationTime", "length"))
        label, columns = f"{source} {path.rstrip('/')}", found.columns
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
            .cast("string") for seed in (1, 2)]
    return found.agg(F.sha2(F.concat_ws(
        " ", F.lit(label), F.lit(" ".join(columns)), F.count(F.lit(1)).cast("string"),
        *sums), 256).alias("d")).first()["d"]


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifests of complete builds, or None if there is none."""
    try:
        return spark.read.option("basePath", root).parquet(f"{root}/build=*/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _built_files(spark: SparkSession, turns_path: str) -> DataFrame:
    """``(split, shard, file, n_rows)`` of a stored turn table."""
    return (spark.read.parquet(turns_path)
            .groupBy("split", F.col("shard").cast("bigint").alias("shard"),
                     F.col("_metadata.file_name").alias("file"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def _build(spark: SparkSession, source: str | DataFrame, path: str, folder: str,
           identity: str, config: CorpusConfig) -> None:
    turns = source if isinstance(source, DataFrame) else read_source(spark, source, path)
    # readers number dialogues per read: write once, then go on from there
    with_split(turns).select("split", "conv_id", "turn", "text").write.parquet(
        f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    build_vocab(raw).table.write.parquet(f"{folder}/vocab")
    vocab = stored_vocab(spark.read.parquet(f"{folder}/vocab"))
    encoded = encode(raw, vocab, ["conv_id", "turn"]).withColumn("n_ids", F.size("ids"))
    write_shards(with_shards(encoded, dialog_layout(raw, config)), f"{folder}/turns")
    _built_files(spark, f"{folder}/turns").write.parquet(f"{folder}/files")
    (split_manifest(spark.read.parquet(f"{folder}/turns"), config)
     .withColumns({"identity": F.lit(identity), "built": F.current_timestamp()})
     .coalesce(1).write.parquet(f"{folder}/manifest"))


def check_files(spark: SparkSession, folder: str) -> None:
    """Raise if a stored turn table is not the one that was written."""
    keys = ["split", "shard", "file", "n_rows"]
    listed = spark.read.parquet(f"{folder}/files").select(*keys)
    there = _built_files(spark, f"{folder}/turns").select(*keys)
    odd = listed.exceptAll(there).unionByName(there.exceptAll(listed)).first()
    if odd:
        raise ValueError(f"{folder}/turns differs from its list of files: {odd}")


def prepare_corpus(spark: SparkSession, source: str | DataFrame, path: str,
                   data_dir: str, config: CorpusConfig = CorpusConfig(),
                   force_rebuild: bool = False, name: str = "corpus") -> Corpus:
    """Ingest, encode and store a corpus, or reopen it if it is there.

    ``source`` is a reader's name, read from ``path``, or a turn table. The
    corpus lies under ``data_dir``, its ``name``, the settings' fingerprint and the
    source's identity, so sources never meet; changed files are another source.
    Each build has a folder of its own, and its manifest is written last: a
    build that fails leaves the earlier one in place, and the last complete one counts.
    """
    identity = source_identity(spark, source, path)
    root = f"{data_dir.rstrip('/')}/{name}/{fingerprint(spark, config)}-{identity[:16]}"
    manifests = None if force_rebuild else _manifests(spark, root)
    if manifests is None:
        _build(spark, source, path, f"{root}/build={uuid.uuid4().hex}", identity, config)
        manifests = _manifests(spark, root)
    last = manifests.orderBy(F.desc("built")).select("build", "identity").first()
    if last["identity"] != identity:
        raise ValueError(f"{root} holds another source")
    folder = f"{root}/build={last['build']}"
    check_files(spark, folder)
    return Corpus(spark.read.parquet(f"{folder}/turns"),
                  stored_vocab(spark.read.parquet(f"{folder}/vocab")),
                  spark.read.parquet(f"{folder}/manifest"), config)
