"""Quality rules judged by host: failures by domain, shrunk rates, verdicts.

Every document is measured on its own by column expressions. The failures of
each rule are counted by host (the ``source`` column), each host's rate is drawn
towards the common rate by a beta prior fitted to all hosts, and a host whose
drawn rate of any rule is over ``max_rate`` is rejected with all its documents.
A small host needs more evidence than a large one, a host like the others none.
With ``joint`` the rate of documents that fail any rule counts as one more rule, so
that a host does not pass whose documents fail different rules.

Cases: a null text has no words and fails the base rules; a document without a
host is judged by the base rules alone; repeated rows count each; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import NOT_BLANK, let, small_side, text_of, words_of
from colloquy.session import staged

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MAX_RATE = 0.5
# The prior counts as much as this many documents at most.
MAX_STRENGTH = 1e6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
            "n_repeat_words")


def _covered(places: Column) -> Column:
    """Words covered by windows that begin at these ascending places."""
    gaps = F.zip_with(F.slice(places, F.lit(2), F.size(places) - 1),
                      F.slice(places, F.lit(1), F.size(places) - 1),
                      lambda later, earlier: F.least(later - earlier, F.lit(WINDOW)))
    return F.when(F.size(places) == 0, F.lit(0)).otherwise(
        F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap))


def _twins(hashes: Column) -> Column:
    """Ascending places of the values that are there twice or more."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(
        h.alias("h"), i.alias("i"))))
    twins = let(order, lambda rows: F.filter(rows, lambda row, k: F.coalesce(
        F.get(rows, k - 1)["h"] == row["h"], F.lit(False)) | F.coalesce(
        F.get(rows, k + 1)["h"] == row["h"], F.lit(False))))
    return F.array_sort(F.transform(twins, lambda row: row["i"]))


def measured(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The columns ``keep`` and the counts that the rules use, row by row.

    Windows of five words are compared by 64-bit hashes. Only a text in which
    two hashes agree is sorted to find the places.
    """
    kept = [c.alias(f"_keep{i}") for i, c in enumerate(keep)]
    names = [F.col(f"_keep{i}") for i in range(len(keep))]
    words, windows = F.col("_words"), F.col("_windows")
    rows = (docs.select(*kept, text_of(text).alias("_text"))
            .select(*names, "_text", words_of(F.col("_text")).alias("_words"))
            .select("*", F.filter(F.split("_text", "\n", -1),
                                  lambda line: line.rlike(NOT_BLANK)).alias("_lines"),
                    F.when(F.size(words) > WINDOW, F.transform(
                        F.sequence(F.lit(0), F.size(words) - WINDOW),
                        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))
                    .otherwise(F.array().cast("array<bigint>")).alias("_windows")))
    other = "[^" + SYMBOLS.replace("&", r"\&") + "]+"
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace("_text", other, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(
            F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0))
        .otherwise(let(_twins(windows), _covered)),
    }
    return rows.select(*names, *[c.cast("bigint").alias(n) for n, c in counts.items()])


def base_failed() -> Column:
    return ((F.col("n_words") < 10)
            | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rules() -> dict[str, Column]:
    """What a document fails, by rule, from its measures."""
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def failures(rows: DataFrame, joint: bool = False) -> DataFrame:
    """Rows ``(host, <rule> ...)`` from measured rows that name their host; with
    ``joint`` also ``any``."""
    failed = rules()
    if joint:
        failed["any"] = reduce(or_, failed.values())
    return rows.select("host", *[c.alias(n) for n, c in failed.items()])


def host_rates(failed: DataFrame) -> DataFrame:
    """Turn rows ``(host, <rule> boolean ...)`` into one row per host: its
    documents ``n`` and each rule's drawn rate.

    The prior's mean is the rate over all documents. Its strength follows from
    how much more the hosts' rates differ than chance would make them differ.
    """
    names = [c for c in failed.columns if c != "host"]
    # written once: the counts take a pass over all texts
    hosts = staged(failed.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in names]), "hosts")
    n = F.col("n").cast("double")
    stats = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"),
        F.sum(n * n).alias("squares"),
        *[F.sum(c).alias(c) for c in names],
        *[F.sum(F.col(c) * F.col(c) / n).alias(f"{c}_squares") for c in names]).first()
    drawn = []
    for c in names:
        mean, strength = _prior(stats, c)
        drawn.append(((F.col(c) + mean * strength) / (n + strength)).alias(c))
    return hosts.select("host", "n", *drawn)


def _prior(stats, name: str) -> tuple[float, float]:
    if not stats["n"]:
        return 0.0, 1.0
    total, mean = stats["n"], stats[name] / stats["n"]
    chance = mean * (1 - mean)
    spread = stats[f"{name}_squares"] - stats[name] ** 2 / total
    room = total - stats["squares"] / total
    between = (spread - (stats["hosts"] - 1) * chance) / room if room > 0 else 0.0
    if between <= 0:
        return mean, MAX_STRENGTH
    return mean, round(min(max(chance / between - 1, 1.0), MAX_STRENGTH), 6)


def rejected_hosts(failed: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Hosts of which the drawn rate of any rule is over ``max_rate``."""
    rates = host_rates(failed)
    worst = F.greatest(*[F.col(c) for c in rates.columns if c not in ("host", "n")])
    return rates.filter(worst > max_rate).select("host")


def quality(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the measures,
    ``base_failed`` and ``kept``. The measures are stored once for both uses."""
    rows = staged(measured(docs, F.col("text"), F.col("doc_id"), F.col("source"))
                  .withColumnsRenamed({"_keep0": "doc_id", "_keep1": "host"}), "quality")
    bad = small_side(rejected_hosts(failures(rows), max_rate)).withColumn(
        "_bad", F.lit(True))
    return (rows.join(bad, "host", "left")
            .select("doc_id", *[m for m in MEASURES if m != "n_lines"],
                    base_failed().alias("base_failed"),
                    (~base_failed() & F.col("_bad").isNull()).alias("kept"), "n_lines"))


def keep_good(docs: DataFrame, max_rate: float = MAX_RATE, joint: bool = False) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; ``joint`` as above.

    Texts are measured twice, once to count and once to filter, and are neither
    shuffled nor stored.
    """
    rows = measured(docs, F.col("text"), F.col("source")).withColumnRenamed("_keep0", "host")
    bad = small_side(rejected_hosts(failures(rows, joint), max_rate))
    # The row number keeps the filter above the projections: below them, the
    # optimizer would put the split into words inside the loop over windows.
    good = (measured(docs, F.col("text"), F.struct("*"))
            .withColumn("_row", F.monotonically_increasing_id())
            .filter(~base_failed() & (F.col("_row") >= 0))
            .select(F.col("_keep0").alias("_document")))
    return (good.join(bad, F.col("_document")["source"] == F.col("host"), "left_anti")
            .select("_document.*"))
