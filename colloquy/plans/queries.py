"""The registered queries: each takes ``(spark, folder of tables)``.

Arrays leave as space-separated text, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.functions import sequences as S
from colloquy.functions import hashing
from colloquy.functions.numbers import rounded
from colloquy.functions.text import ids_text, words
from colloquy.operators import batching as B
from colloquy.operators import collation as C
from colloquy.operators import decoding as D
from colloquy.operators import evaluation as E
from colloquy.operators import examples as X
from colloquy.operators import metrics as M
from colloquy.operators import splits as P
from colloquy.operators import turns as T
from colloquy.operators import vocabulary as V
from colloquy.plans import corpus
from colloquy.plans.tables import conversations, logit_table, step_log
from colloquy.session import staged, staging_path
from colloquy.sources import readers, writers
from colloquy.sources.line_files import zip_lines
from colloquy.streaming.context import check_nothing_waits, stream_context as rolling_stream
from colloquy.streaming.metrics import latest, stream_epoch_means
from colloquy.streaming.runner import drain_append, drain_update, read_table_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Small shards, buckets and batches, so that small tables fill several of each.
CONFIG = CorpusConfig(file_size=40, bucket_size=100, batch_size=16, seed=7)
WORLD = 3
EOS_LOGIT = 0
PAD_LABEL = 9
KEYS = ["conv_id", "begin_idx", "end_idx"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(*names: str, places: int = 6) -> list[Column]:
    return [rounded(F.col(n), places).alias(n) for n in names]


# -- sources ----------------------------------------------------------------

def _round_trip(spark: SparkSession, sf_dir: str, name: str, write,
                text: str = "text") -> DataFrame:
    """Write the conversations in a layout and read them back. Each text is led by
    its own conversation and turn; ``place`` is the turn that the reader gives."""
    rows = T.with_split(conversations(spark, sf_dir))
    path = staging_path(spark, name)
    write(rows.withColumn("text", F.concat_ws(" ", "conv_id", "turn", F.expr(text))), path)
    pattern = r"(?s)^(\d+) (\d+) (.*)$"
    return readers.read_source(spark, name, path).select(
        "split",
        F.regexp_extract("text", pattern, 1).cast("bigint").alias("conv_id"),
        F.regexp_extract("text", pattern, 2).cast("bigint").alias("turn"),
        F.col("turn").alias("place"),
        F.regexp_extract("text", pattern, 3).alias("text"))


@query
def src_jsonl(spark, sf_dir):
    return _round_trip(spark, sf_dir, "jsonl", writers.write_jsonl)


@query
def src_nested_json(spark, sf_dir):
    """The layout has no test part: validation dialogues come back twice."""
    return _round_trip(spark, sf_dir, "nested_json", writers.write_nested_json)


@query
def src_map_json(spark, sf_dir):
    return _round_trip(spark, sf_dir, "map_json", writers.write_map_json)


@query
def src_blankline_text(spark, sf_dir):
    return _round_trip(spark, sf_dir, "blankline_text", writers.write_blankline_text,
                       r"regexp_replace(text, '[\\r\\n]', ' ')")


@query
def scan_split(spark, sf_dir):
    path = staging_path(spark, "splits")
    rows = conversations(spark, sf_dir)
    sharded = B.with_shards(rows, B.dialog_layout(rows, CONFIG))
    writers.write_shards(sharded, path)
    return readers.scan_split(spark, path, "valid").select(
        "split", "shard", "conv_id", "turn", "text")


@query
def read_history(spark, sf_dir):
    path = staging_path(spark, "history")
    writers.write_history(_history(spark, sf_dir), path)
    return readers.read_history(spark, path).select(
        "run_id", "epoch", *_rounded(*M.HISTORY[1:], places=9))


@query
def read_metric_text(spark, sf_dir):
    path = staging_path(spark, "metrics")
    writers.write_metric_text(_summary(spark, sf_dir), path)
    return readers.read_metric_text(spark, path).select(
        "metric", *_rounded("mean", "std", "confidence"))


# -- splits and sinks -------------------------------------------------------

@query
def shard_assign(spark, sf_dir):
    dialogs = T.dialog_sizes(conversations(spark, sf_dir))
    return B.assign_shards(dialogs, CONFIG.file_size).select(
        "split", "conv_id", "shard", "shard_pos")


@query
def split_manifest(spark, sf_dir):
    return P.split_manifest(conversations(spark, sf_dir), CONFIG)


@query
def config_fingerprint(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    return rows.select("conv_id", "turn", hashing.config_fingerprint(
        F.col("turn"), F.col("conv_id")).alias("fingerprint"))


def _predictions(rows: DataFrame) -> DataFrame:
    """Stand-in responses: the prompt's words said back."""
    return rows.select(*KEYS, F.array_join(words(F.col("input")), " ").alias("response"))


def _normalized(spark, sf_dir) -> DataFrame:
    return E.normalized_examples(
        E.rendered_examples(conversations(spark, sf_dir), CONFIG))


@query
def eval_table(spark, sf_dir):
    rows = _normalized(spark, sf_dir).where("split = 'test'")
    return E.eval_table(rows, _predictions(rows))


@query
def eval_lines(spark, sf_dir):
    """The three texts of the evaluation table as line files without keys, read again and
    put side by side by position."""
    table = staged(eval_table(spark, sf_dir), "eval-table")
    path = staging_path(spark, "eval-lines")
    columns = ("input", "target", "response")
    for column in columns:
        writers.write_lines(table, column, f"{path}/{column}")
    return zip_lines(spark, {c: f"{path}/{c}" for c in columns}).select(*columns)


@query
def metric_events(spark, sf_dir):
    steps = M.without_nan(step_log(spark, sf_dir))
    path = staging_path(spark, "events")
    writers.append_events(M.metric_events(steps), path)
    return spark.read.parquet(path).withColumn("value", rounded(F.col("value"), 6))


@query
def history_columnar(spark, sf_dir):
    rows = M.history_columnar(_history(spark, sf_dir))
    millionths = lambda v: F.when(
        v.isNull(), "none").when(v == float("inf"), "inf").otherwise(
            F.round(v * 1e6).cast("decimal(38,0)").cast("string"))
    lists = [F.array_join(F.transform(c, millionths), " ").alias(c)
             for c in M.HISTORY[1:]]
    return rows.select("run_id", ids_text(F.col("epoch")).alias("epoch"), *lists)


# -- projections and joins on turns ----------------------------------------

@query
def dialog_assemble(spark, sf_dir):
    """Pieces of conversations as lists; a long conversation has several."""
    return T.assembled(conversations(spark, sf_dir)).select(
        "conv_id", "first_turn", F.size("utterances").alias("n_turns"),
        F.array_join("utterances", " | ").alias("utterances"))


@query
def dense_turns(spark, sf_dir):
    """Positions of turns whose numbers have gaps and do not begin at 0."""
    source = F.col("turn") * 7 + F.col("conv_id") % 5
    rows = conversations(spark, sf_dir).select(
        "conv_id", source.alias("turn"), source.alias("source_turn"))
    numbered = T.renumbered(rows)
    return numbered.select("conv_id", "source_turn", "turn")


@query
def eligible_dialogs(spark, sf_dir):
    return T.eligible(conversations(spark, sf_dir)).select("conv_id", "n_turns")


@query
def normalize_input(spark, sf_dir):
    return _normalized(spark, sf_dir)


@query
def align_predictions(spark, sf_dir):
    rows = _normalized(spark, sf_dir)
    return E.align(rows, _predictions(rows)).select(*KEYS, "target", "response")


@query
def history_band_join(spark, sf_dir):
    return X.history_band_join(conversations(spark, sf_dir), CONFIG.max_hist)


@query
def merge_precedence(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    rare = rows.where("conv_id % 3 <> 0").withColumn("source", F.lit("rare"))
    freq = (rows.where("conv_id % 2 = 0 or conv_id % 3 = 0")
            .withColumn("source", F.lit("freq")))
    return P.merge_precedence(rare, freq)


@query
def split_overlap(spark, sf_dir):
    rows = T.with_split(conversations(spark, sf_dir))
    dialogs = T.with_split(P.dialog_digest(rows))
    by_dialog = P.split_overlap(dialogs, F.col("digest"))
    by_turn = P.split_overlap(rows, F.md5(F.lower(F.col("text"))))
    return (by_dialog.select(F.lit("dialog").alias("level"), "*")
            .unionByName(by_turn.select(F.lit("turn").alias("level"), "*")))


@query
def context_window(spark, sf_dir):
    return T.rolling_context(conversations(spark, sf_dir), CONFIG.max_hist).select(
        "conv_id", "turn", F.array_join("context", " | ").alias("context"))


@query
def take_n(spark, sf_dir):
    rows = corpus.text_index(conversations(spark, sf_dir), CONFIG)
    return B.take_n(rows, [F.col(c) for c in ("example_len", *KEYS)], 25).select(
        "example_len", *KEYS)


# -- vocabulary -------------------------------------------------------------

def _encoded(spark, sf_dir) -> tuple[DataFrame, V.Vocabulary]:
    rows = conversations(spark, sf_dir)
    vocab = V.build_vocab(rows)
    return V.encoded_segments(rows, vocab, CONFIG.max_hist), vocab


@query
def build_vocab(spark, sf_dir):
    return V.build_vocab(conversations(spark, sf_dir)).table


@query
def encode_tokens(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    return V.encode(rows, V.build_vocab(rows), ["conv_id", "turn"]).select(
        "conv_id", "turn", ids_text(F.col("ids")).alias("ids"))


@query
def decode_tokens(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    vocab = V.build_vocab(rows)
    keys = ["conv_id", "turn"]
    return V.decode(V.encode(rows, vocab, keys), vocab, keys, "ids")


@query
def strip_special(spark, sf_dir):
    """Training inputs back as text, without the special tokens."""
    encoded, vocab = _encoded(spark, sf_dir)
    rows = X.build_examples(encoded, vocab.ids, CONFIG).select(
        *KEYS, V.without_specials(F.col("input_ids"), vocab.ids).alias("ids"))
    return V.decode(rows, vocab, KEYS, "ids")


@query
def word_vocab(spark, sf_dir):
    return E.word_vocab(conversations(spark, sf_dir), CONFIG)


# -- examples ---------------------------------------------------------------

@query
def example_index(spark, sf_dir):
    return corpus.text_index(conversations(spark, sf_dir), CONFIG).drop("segment")


@query
def example_len(spark, sf_dir):
    return X.running_example_len(
        corpus.token_counts(conversations(spark, sf_dir)), CONFIG)


@query
def example_lookup(spark, sf_dir):
    encoded, _ = _encoded(spark, sf_dir)
    index = corpus.text_index(conversations(spark, sf_dir), CONFIG).select(*KEYS)
    found = X.example_lookup(index, encoded, CONFIG.max_hist)
    return found.select(*KEYS, ids_text(F.flatten("history")).alias("history"),
                        ids_text(F.col("target")).alias("target"))


def _histories(spark, sf_dir) -> tuple[DataFrame, SpecialIds]:
    encoded, vocab = _encoded(spark, sf_dir)
    return X.each_history(T.contexts(encoded, "ids", CONFIG.max_hist)), vocab.ids


@query
def speaker_roles(spark, sf_dir):
    rows, ids = _histories(spark, sf_dir)
    return rows.select(*KEYS, ids_text(S.speaker_roles(F.col("history"), ids)).alias("roles"))


@query
def truncate_turns(spark, sf_dir):
    rows, ids = _histories(spark, sf_dir)
    turns = S.truncated_turns(F.col("history"), ids, CONFIG.max_len)
    return rows.select(*KEYS, F.array_join(
        F.transform(turns, ids_text), " | ").alias("turns"))


@query
def input_sequence(spark, sf_dir):
    rows, ids = _histories(spark, sf_dir)
    turns = S.truncated_turns(F.col("history"), ids, CONFIG.max_len)
    return rows.select(*KEYS, ids_text(S.input_sequence(turns, ids)).alias("input_ids"))


@query
def token_types(spark, sf_dir):
    rows, ids = _histories(spark, sf_dir)
    turns = S.truncated_turns(F.col("history"), ids, CONFIG.max_len)
    return rows.select(*KEYS, ids_text(S.token_types(
        S.input_sequence(turns, ids), ids)).alias("token_type_ids"))


@query
def target_sequence(spark, sf_dir):
    encoded, vocab = _encoded(spark, sf_dir)
    rows = T.contexts(encoded, "ids", CONFIG.max_hist)
    return rows.select("conv_id", "end_idx", ids_text(S.target_sequence(
        F.col("target"), vocab.ids, CONFIG.max_len)).alias("target_ids"))


@query
def build_examples(spark, sf_dir):
    rows = corpus.text_examples(conversations(spark, sf_dir), CONFIG)
    return rows.select(*KEYS, "example_len", *[
        ids_text(F.col(c)).alias(c) for c in ("input_ids", "token_type_ids", "target_ids")])


@query
def truncate_at_eos(spark, sf_dir):
    """Turns as generated ids, the most frequent word as their end token."""
    encoded, _ = _encoded(spark, sf_dir)
    kept = S.truncate_at_eos(F.col("ids"), 4, CONFIG.max_len)
    return encoded.where(T.is_own()).select(
        "conv_id", "turn", ids_text(kept).alias("ids"))


@query
def extend_inputs(spark, sf_dir):
    """Prompts extended by the ids of their responses."""
    rows, ids = _histories(spark, sf_dir)
    turns = S.truncated_turns(F.col("history"), ids, CONFIG.max_len)
    prompt = rows.select(*KEYS, S.input_sequence(turns, ids).alias("prompt"),
                         F.col("target").alias("predicted"))
    types = S.token_types(F.col("prompt"), ids)
    return prompt.select(
        *KEYS,
        ids_text(S.extend_inputs(F.col("prompt"), F.col("predicted"), ids, "permuted"))
        .alias("input_ids"),
        ids_text(S.extend_types(types, F.col("predicted"), ids, "permuted"))
        .alias("token_type_ids"))


# -- batches ----------------------------------------------------------------

def _ordered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = conversations(spark, sf_dir)
    layout = B.dialog_layout(rows, CONFIG)
    index = corpus.text_index(rows, CONFIG)
    return B.length_order(B.placed(index, layout, CONFIG)), layout


def _starts(layout: DataFrame) -> DataFrame:
    sizes = layout.groupBy(*B.SHARD).agg(F.sum("n_examples").alias("n_examples"))
    return B.bucket_starts(sizes, CONFIG)


def _plan(spark, sf_dir) -> DataFrame:
    rows = conversations(spark, sf_dir)
    return B.batch_plan(corpus.text_index(rows, CONFIG), rows, CONFIG)


@query
def length_order(spark, sf_dir):
    ordered, _ = _ordered(spark, sf_dir)
    return ordered.select(*B.SHARD, *KEYS, "example_len", "position")


@query
def bucket_assign(spark, sf_dir):
    ordered, _ = _ordered(spark, sf_dir)
    return B.with_buckets(ordered, CONFIG.bucket_size).select(*B.SHARD, *KEYS, "bucket")


@query
def bucket_shuffle(spark, sf_dir):
    return _starts(B.dialog_layout(conversations(spark, sf_dir), CONFIG))


@query
def in_bucket_shuffle(spark, sf_dir):
    ordered, layout = _ordered(spark, sf_dir)
    drawn = B.shuffled(B.with_buckets(ordered, CONFIG.bucket_size), _starts(layout), CONFIG)
    return drawn.select(*B.SHARD, *KEYS, "bucket", "draw")


@query
def batch_assign(spark, sf_dir):
    return _plan(spark, sf_dir).select(*B.BATCH, *KEYS, "draw")


@query
def batch_max_len(spark, sf_dir):
    return _plan(spark, sf_dir).select(*B.BATCH, *KEYS, "input_len", "max_seq", "max_target")


@query
def padding_budget(spark, sf_dir):
    return B.padding_budget(_plan(spark, sf_dir), CONFIG)


@query
def rank_shard(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    dealt = B.rank_share(B.placed(corpus.text_index(rows, CONFIG),
                                  B.dialog_layout(rows, CONFIG), CONFIG), WORLD)
    return B.length_order(dealt, [*B.SHARD, "rank"]).select(
        *B.SHARD, "rank", *KEYS, "position")


@query
def num_steps(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    planned = B.num_steps(P.split_manifest(rows, CONFIG), CONFIG)
    real = B.loader_steps(B.dialog_layout(rows, CONFIG), CONFIG.batch_size)
    return planned.join(real, "split")


def _batch_rows(spark, sf_dir) -> tuple[DataFrame, SpecialIds]:
    return corpus.text_batches(conversations(spark, sf_dir), CONFIG)


def _as_text(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(*B.BATCH, *KEYS, *[ids_text(F.col(n)).alias(n) for n in names])


@query
def collate_causal(spark, sf_dir):
    rows, ids = _batch_rows(spark, sf_dir)
    return _as_text(C.collate(rows, "causal", ids.pad),
                    "input_ids", "token_type_ids", "labels")


@query
def collate_causal_eval(spark, sf_dir):
    rows, ids = _batch_rows(spark, sf_dir)
    return _as_text(C.collate(rows, "causal", ids.pad, training=False),
                    "input_ids", "token_type_ids")


@query
def collate_permuted(spark, sf_dir):
    rows, ids = _batch_rows(spark, sf_dir)
    return _as_text(C.collate(rows, "permuted", ids.pad),
                    "input_ids", "token_type_ids", "labels", "attention_mask")


@query
def collate_permuted_eval(spark, sf_dir):
    rows, ids = _batch_rows(spark, sf_dir)
    batch = C.with_eval_masks(C.collate(rows, "permuted", ids.pad, training=False))
    return batch.select(
        *B.BATCH, *KEYS, ids_text(F.col("input_ids")).alias("input_ids"),
        ids_text(F.col("attention_mask")).alias("attention_mask"),
        F.size("perm_mask").alias("mask_rows"),
        F.element_at("perm_mask", 1).alias("mask_row"),
        F.element_at("target_map", 1).alias("target_map"))


@query
def perm_mask(spark, sf_dir):
    masks = C.with_train_masks(_plan(spark, sf_dir))
    return masks.select(*KEYS, F.posexplode("perm_mask").alias("row", "bits"))


@query
def target_map(spark, sf_dir):
    masks = C.with_train_masks(_plan(spark, sf_dir))
    return masks.select(*KEYS, F.posexplode("target_map").alias("row", "bits"))


# -- scores and decoding ----------------------------------------------------

@query
def log_softmax(spark, sf_dir):
    return D.log_softmax_rows(logit_table(spark, sf_dir)).withColumn(
        "log_prob", rounded(F.col("log_prob"), 6))


@query
def argmax_token(spark, sf_dir):
    return D.argmax_tokens(logit_table(spark, sf_dir))


@query
def token_metrics(spark, sf_dir):
    rows = M.token_metrics(logit_table(spark, sf_dir), PAD_LABEL, ["batch"])
    return rows.select("batch", "n_targets", *_rounded(*M.METRICS))


@query
def min_len_mask(spark, sf_dir):
    masked = D.mask_early_end(logit_table(spark, sf_dir), EOS_LOGIT, 2)
    return masked.select("seq_id", "pos", F.posexplode("logits").alias("token_id", "logit")
                         ).withColumn("logit", rounded(F.col("logit"), 6))


def _kept_rows(kept: DataFrame) -> DataFrame:
    return D.candidate_rows(kept).select(
        "seq_id", "pos", "token_id", *_rounded("logit", "prob"))


@query
def topk_filter(spark, sf_dir):
    return _kept_rows(D.select(logit_table(spark, sf_dir), "topk", top_k=10))


@query
def nucleus_filter(spark, sf_dir):
    return _kept_rows(D.select(logit_table(spark, sf_dir), "nucleus", top_p=0.9))


@query
def sample_token(spark, sf_dir):
    masked = D.mask_early_end(logit_table(spark, sf_dir), EOS_LOGIT, 2)
    return D.sample(D.select(masked, "nucleus", top_p=0.9), CONFIG.seed)


# -- metrics and run history ------------------------------------------------

def _trained(spark, sf_dir) -> DataFrame:
    return M.without_nan(step_log(spark, sf_dir))


def _history(spark, sf_dir) -> DataFrame:
    return M.history(_trained(spark, sf_dir))


@query
def nan_skip(spark, sf_dir):
    return M.nan_skips(step_log(spark, sf_dir), ["run_id", "epoch"])


@query
def epoch_metrics(spark, sf_dir):
    return M.epoch_metrics(_trained(spark, sf_dir)).select(
        "run_id", "epoch", "split", *_rounded("loss", "acc", places=9),
        M.clamped(rounded(F.col("ppl"), 9)).alias("ppl"))


@query
def inf_clamp(spark, sf_dir):
    rows = _trained(spark, sf_dir)
    return rows.select("run_id", "split", "step", rounded(M.clamped(F.col("ppl")), 6).alias("ppl"))


@query
def rank_mean(spark, sf_dir):
    """Four ranks that take reports in turn; a last step may have fewer reports."""
    rows = M.dealt_steps(_trained(spark, sf_dir), 4)
    # means of few hundredths often end in a 5 at the seventh place, where
    # engines round differently: compare such means at the ninth
    return M.rank_mean(rows, 4, partial=True).select(
        "run_id", "epoch", "split", "step",
        *_rounded("loss", "acc", places=9))


@query
def best_epoch(spark, sf_dir):
    return M.best_epoch(_history(spark, sf_dir)).withColumn(
        "best_valid_loss", rounded(F.col("best_valid_loss"), 6))


@query
def early_stop(spark, sf_dir):
    return M.early_stop(_history(spark, sf_dir), patience=3, total_steps=25)


def _summary(spark, sf_dir) -> DataFrame:
    rows = _normalized(spark, sf_dir).where("split = 'test'")
    table = E.eval_table(rows, _predictions(rows))
    return M.metric_summary(E.response_scores(table),
                            ["length", "distinct_1", "distinct_2"])


@query
def metric_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("metric", *_rounded("mean", "std", "confidence"))


# -- streams ----------------------------------------------------------------

@query
def stream_context(spark, sf_dir):
    turns = read_table_stream(spark, sf_dir, "conversations")
    done = drain_append(rolling_stream(turns, CONFIG.max_hist), "stream-context",
                        check_nothing_waits)
    return done.select("conv_id", "turn", F.array_join("context", " | ").alias("context"))


@query
def stream_metrics(spark, sf_dir):
    events = read_table_stream(spark, sf_dir, "events")
    steps = events.select(F.col("user_id").alias("run_id"),
                          F.col("ts").cast("timestamp").alias("ts"),
                          (F.col("value") / 100).alias("loss"))
    done = latest(drain_update(stream_epoch_means(steps), "stream-metrics"))
    return done.select("run_id", F.datediff(F.col("day.start"), F.lit("2024-01-01").cast("date"))
                       .alias("epoch"), "n_steps", *_rounded("loss"))
