"""Evaluating predicted responses of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from colloquy.config import CorpusConfig
from colloquy.operators.evaluation import (
    EXAMPLE, eval_table, normalized_examples, rendered_examples, response_scores,
    word_vocab)
from colloquy.operators.metrics import metric_summary
from colloquy.session import staged
from colloquy.sources.writers import write_lines

SCORES = ["length", "distinct_1", "distinct_2"]


@dataclass(frozen=True)
class Evaluation:
    """What scoring needs: training inputs, the aligned test table, the words
    known from training and test, and a summary of the responses."""

    train_inputs: DataFrame
    table: DataFrame
    words: DataFrame
    summary: DataFrame


def evaluate(turns: DataFrame, predictions: DataFrame,
             config: CorpusConfig = CorpusConfig()) -> Evaluation:
    """Evaluate ``predictions``, a ``response`` per example key."""
    examples = normalized_examples(rendered_examples(turns, config))
    table = eval_table(examples.where("split = 'test'"), predictions)
    train = examples.where("split = 'train'").select(
        *EXAMPLE, F.lower("input").alias("input"))
    return Evaluation(train, table, word_vocab(turns, config),
                      metric_summary(response_scores(table), SCORES))


def export_lines(evaluation: Evaluation, path: str) -> None:
    """Write the tables as text, one line per example.

    The test table is put in order and written once, so that the lines of its
    three texts match file by file.
    """
    ordered = evaluation.table.repartitionByRange(*EXAMPLE).sortWithinPartitions(*EXAMPLE)
    table = staged(ordered, "eval-table")
    for column in ("input", "target", "response"):
        write_lines(table, column, f"{path}/test_{column}")
    write_lines(evaluation.train_inputs, "input", f"{path}/train_input")
    write_lines(evaluation.words, "word", f"{path}/words")
