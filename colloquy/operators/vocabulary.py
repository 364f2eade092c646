"""Vocabularies, and the mapping between tokens and ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.config import (
    ADDED_SPECIALS, BASE_SPECIALS, BOS, BROADCAST_TOKENS, BROADCAST_TOKEN_BYTES,
    EOS, HOT_TOKENS, HOT_TOKEN_BYTES, HST, MASK, PAD, RSP, SP1, SP2, SPECIALS, UNK, SpecialIds)
from colloquy.functions.text import words
from colloquy.operators.ranking import BROADCAST_PARTS, range_placed, with_rank
from colloquy.operators.turns import with_segments


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary table ``(token, id, n)`` and what is known of its size."""

    table: DataFrame
    ids: SpecialIds
    size: int
    longest: int

    @property
    def small(self) -> bool:
        """Whether the whole table lies within the broadcast bound."""
        return self.size <= BROADCAST_TOKENS and self.longest <= BROADCAST_TOKEN_BYTES


def _special_ids(words_seen: int) -> SpecialIds:
    base = {t: i for i, t in enumerate(BASE_SPECIALS)}
    added = {t: len(BASE_SPECIALS) + words_seen + i for i, t in enumerate(ADDED_SPECIALS)}
    at = {**base, **added}
    return SpecialIds(sp1=at[SP1], sp2=at[SP2], bos=at[BOS], eos=at[EOS], hst=at[HST],
                      rsp=at[RSP], pad=at[PAD], unk=at[UNK], mask=at[MASK])


def words_of(rows: DataFrame) -> Column:
    """The words of each row: its column ``words``, or else those of ``text``."""
    return F.col("words") if "words" in rows.columns else words(F.col("text"))


def build_vocab(texts: DataFrame) -> Vocabulary:
    """Number the words of a ``text`` column, or those in ``words``.

    Base specials take the first ids, then the corpus words by falling count
    and rising spelling, then the added specials.
    """
    counted = (texts.select(F.explode(words_of(texts)).alias("token"))
               .where(~F.col("token").isin(*SPECIALS))
               .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    placed = range_placed(counted, [], [F.col("n").desc(), F.col("token")])
    known = placed.agg(F.count(F.lit(1)).alias("n"), F.max("_part").alias("part"),
                       F.max(F.octet_length("token")).alias("longest")).first()
    few = (known["part"] or 0) < BROADCAST_PARTS
    base, size = len(BASE_SPECIALS), known["n"]
    body = with_rank(placed, [], "rank", few).select(
        "token", (F.col("rank") + base).cast("int").alias("id"), "n")
    fixed = ([(t, i) for i, t in enumerate(BASE_SPECIALS)]
             + [(t, base + size + i) for i, t in enumerate(ADDED_SPECIALS)])
    specials = texts.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("token"), F.lit(i).alias("id"),
                 F.lit(0).cast("bigint").alias("n")) for t, i in fixed])))
    return Vocabulary(body.unionByName(specials), _special_ids(size),
                      size + len(SPECIALS), known["longest"] or 0)


def stored_vocab(table: DataFrame) -> Vocabulary:
    """A vocabulary whose table was written before."""
    known = table.agg(F.count(F.lit(1)).alias("n"),
                      F.max(F.octet_length("token")).alias("longest")).first()
    return Vocabulary(table, _special_ids(known["n"] - len(SPECIALS)),
                      known["n"], known["longest"])


def _frequent() -> Column:
    """The part of a vocabulary that may be broadcast: ids below a fixed bound
    and the specials, of bounded length. The bound is larger for the few that can
    have over a thousandth of all tokens, such as separator lines."""
    size = F.octet_length("token")
    return (((F.col("id") < BROADCAST_TOKENS) | (F.col("n") == 0))
            & ((size <= BROADCAST_TOKEN_BYTES)
               | ((F.col("id") < HOT_TOKENS) & (size <= HOT_TOKEN_BYTES))))


def _mapped(rows: DataFrame, vocab: Vocabulary, key: str, value: str) -> DataFrame:
    """Left join on one vocabulary column.

    Ids follow frequency. The frequent tokens, which hold the hot keys, are
    joined by broadcast; only what they leave unmatched is shuffled.
    """
    pairs = vocab.table.select(key, value)
    if vocab.small:
        return rows.join(F.broadcast(pairs), key, "left")
    head = F.broadcast(vocab.table.where(_frequent()).select(key, value))
    rest = vocab.table.where(~_frequent()).select(key, value)
    first = rows.join(head, key, "left")
    known = first.where(F.col(value).isNotNull() | F.col(key).isNull())
    tail = (first.where(F.col(value).isNull() & F.col(key).isNotNull())
            .drop(value).join(rest, key, "left"))
    return known.unionByName(tail)


def encode(rows: DataFrame, vocab: Vocabulary, keys: list[str]) -> DataFrame:
    """Replace ``text`` by ``ids``, the token ids of its words, per ``keys``."""
    return encode_words(rows.withColumn("words", words(F.col("text"))), vocab, keys)


def encode_words(rows: DataFrame, vocab: Vocabulary, keys: list[str]) -> DataFrame:
    """Replace the array ``words`` by ``ids``, per ``keys``. Two rows with the same
    keys fail the job instead of being mixed.

    If ``rows`` is already partitioned by some of ``keys`` and the vocabulary
    is small, this adds no shuffle.
    """
    tokens = rows.select(*keys, F.posexplode_outer("words").alias("pos", "token"))
    entry = F.when(F.col("token").isNotNull(), F.struct(
        "pos", F.coalesce("id", F.lit(vocab.ids.unk)).cast("int").alias("id")))
    one_row = F.col("_count") == F.coalesce(F.col("_last") + 1, F.lit(1))
    return (_mapped(tokens, vocab, "token", "id")
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(entry)).alias("_entries"),
                 F.count(F.lit(1)).alias("_count"), F.max("pos").alias("_last"))
            .select(*keys, F.when(one_row, F.col("_entries.id")).otherwise(F.raise_error(
                F.concat_ws(" ", F.lit("several rows to encode with"), *[
                    F.concat_ws("=", F.lit(k), F.col(k).cast("string")) for k in keys])))
                .alias("ids")))


def encoded_segments(turns: DataFrame, vocab: Vocabulary, reach: int,
                     max_len: int | None = None) -> DataFrame:
    """Encoded turns laid out by ``(conv_id, segment)`` for window work:
    ``(conv_id, segment, turn, n_ids, ids)``.

    Sequences show at most ``max_len`` ids of a turn; given it, only those are
    shuffled and looked up, while ``n_ids`` counts the whole turn.
    """
    rows = turns.select("conv_id", "turn", words_of(turns).alias("words")).withColumn(
        "n_ids", F.size("words"))
    if max_len is not None:
        rows = rows.withColumn("words", F.slice("words", 1, max_len))
    placed = with_segments(rows, reach).repartition("conv_id", "segment")
    return encode_words(placed, vocab, ["conv_id", "segment", "turn", "n_ids"])


def decode(rows: DataFrame, vocab: Vocabulary, keys: list[str], ids: str) -> DataFrame:
    """Replace the array ``ids`` by ``text``, its tokens joined by spaces."""
    tokens = rows.select(*keys, F.posexplode_outer(ids).alias("pos", "id"))
    entry = F.when(F.col("token").isNotNull(), F.struct("pos", "token"))
    return (_mapped(tokens, vocab, "id", "token")
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
            .select(*keys, F.array_join(F.col("_entries.token"), " ").alias("text")))


def without_specials(ids: Column, specials: SpecialIds) -> Column:
    """Drop special ids from an id array."""
    banned = F.array(*[F.lit(i).cast("int") for i in sorted(set(specials.all()))])
    return F.filter(ids, lambda i: ~F.array_contains(banned, i))
