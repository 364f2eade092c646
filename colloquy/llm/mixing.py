"""Mixing sources to target weights by Pareto order sampling.

A source's share of the mix follows its weight, but is at most ``MOST`` times its
size; what is cut off goes to the others by weight until no share is above. The
target over the size says how often each document is to be expected. Its whole part
is allotted to every document for certain. For the fraction ``f`` that is left,
each document gets an inclusion probability: ``f`` leaning to longer documents,
with the right expected number of words over the source. Documents are ranked by
random odds divided by inclusion odds, and the first in rank are taken once more,
until the words that are left over for the source are filled as nearly as whole
documents can.

The random numbers are digests of the id (of the text where the id is null), so
reruns agree. The cut in the ranking is found by totals over bins of the rank
value, one small row per source and bin, and then within one bin; no source is
ever sorted as a whole. Applying it needs no shuffle of the texts.

Cases: a null text has size 0 and takes nothing; a null source is a source, last
in order; repeated rows are taken or left together; an empty source or table has
target 0; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.common import fits_broadcast, text_of, words_of
from colloquy.operators.ranking import ranked
from colloquy.session import staged

WEIGHTS = (5, 2, 1)
MOST = 3
# A document of this many words leans halfway to the most likely.
LEAN = 200
BINS = 1 << 12
MAX_ROUNDS = 1000


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def lean_of(size: Column) -> Column:
    """How far a size leans to the long ones, in thousandths."""
    return (1000 * size / (size + LEAN)).cast("bigint")


def draw_of(doc_id: Column, text: Column) -> Column:
    """A repeatable number strictly between 0 and 1."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null|"), text_of(text)))
    head = F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 13), 16, 10)
    return (head.cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def place_of(draw: Column, size: Column, fraction: Column, mean_lean: Column) -> Column:
    """The rank value: random odds over inclusion odds, drawn into (0, 1)."""
    lean = lean_of(size) / F.lit(1000.0) - mean_lean
    chance = fraction + fraction * (1 - fraction) * lean
    odds = (draw / (1 - draw)) / (chance / (1 - chance))
    return F.when(fraction > 0, odds / (1 + odds))


def _filled(sources: DataFrame, most: int) -> float:
    """The words per unit of weight at which the shares, none above its limit,
    sum up to all words. ``sources`` has ``weight`` and ``source_size``."""
    level = -1.0
    for _ in range(MAX_ROUNDS):
        free = F.col("weight") * F.lit(level) <= most * F.col("source_size")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.sum(F.when(~free, most * F.col("source_size"))).alias("cut")).first()
        if not row["weight"]:
            return level
        new = (row["total"] - (row["cut"] or 0)) / row["weight"]
        if new == level:
            return level
        level = new
    raise RuntimeError("the shares did not settle")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: int = MOST) -> DataFrame:
    """One row per source of ``rows (source, size)``: ``source, source_size,
    target, copies, fraction, mean_lean, left`` where ``left`` is the words to be
    filled by sampling. Sources take ``weights`` in turn by code point."""
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(lean_of(F.col("size")) * F.col("size")).alias("leaning"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = staged(ranked(sources, [], order, "place").withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                               (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    level = _filled(placed, most) if placed.take(1) else 0.0
    limit = most * F.col("source_size")
    share = F.col("weight") * F.lit(level)
    target = F.when(share > limit, limit.cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")
                  ).otherwise(F.lit(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("leaning") / F.col("source_size") / 1000.0
                  ).otherwise(F.lit(0.0))
    return staged(
        placed.withColumn("target", target).withColumn("rate", rate)
        .withColumn("copies", F.floor("rate"))
        .select("source", "source_size", "target", "copies",
                (F.col("rate") - F.col("copies")).alias("fraction"),
                mean.alias("mean_lean"),
                (F.col("target") - F.col("copies") * F.col("source_size")).alias("left")),
        "targets")


def _with_source(rows: DataFrame, sources: DataFrame, source: Column) -> DataFrame:
    """Join rows with the table of sources, null-safely."""
    named = sources.withColumnRenamed("source", "_source")
    if fits_broadcast(sources):
        named = F.broadcast(named)
    return rows.join(named, source.eqNullSafe(F.col("_source"))).drop("_source")


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``below`` and ``cut``: of a source's documents, those with a
    rank value below the one or up to the other are taken once more.

    ``rows`` are ``(source, size, draw)``. A document is within the cut if the
    words before it and half of its own do not exceed what is to be filled.
    """
    sampled = (_with_source(rows, targets.filter("fraction > 0"), F.col("source"))
               .select("source", "size", "left", place_of(
                   F.col("draw"), F.col("size"), F.col("fraction"),
                   F.col("mean_lean")).alias("place"))
               .withColumn("bin", F.least((F.col("place") * BINS).cast("int"),
                                          F.lit(BINS - 1))))
    sampled = staged(sampled, "places")
    source_key = [F.col("source").isNull().alias("none"), F.col("source")]
    before = Window.partitionBy(*source_key).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    bins = (sampled.groupBy("source", "bin").agg(F.sum("size").alias("words"),
                                                 F.max("left").alias("left"))
            .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))))
    edge = staged(bins.filter("start <= left and start + words > left")
                  .select(F.col("source").alias("_source"), F.col("bin").alias("_bin"),
                          "start"), "edges")
    near = (sampled.join(F.broadcast(edge) if fits_broadcast(edge) else edge,
                         F.col("source").eqNullSafe(F.col("_source"))
                         & (F.col("bin") == F.col("_bin")))
            .groupBy("source", "place").agg(F.sum("size").alias("size"),
                                            F.max("left").alias("left"),
                                            F.max("start").alias("start")))
    earlier = Window.partitionBy(*source_key).orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = (near.withColumn("before", F.col("start")
                              + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
              .filter(F.col("before") + F.col("size") / 2 <= F.col("left"))
              .groupBy("source").agg(F.max("place").alias("place")))
    known = edge.select(F.col("_source").alias("source"),
                        (F.col("_bin") / BINS).alias("below"))
    return staged(
        targets.alias("t")
        .join(known.alias("k"), F.expr("t.source <=> k.source"), "left")
        .join(inside.alias("i"), F.expr("t.source <=> i.source"), "left")
        # without an edge every document is within; with one, all earlier bins are
        .select("t.*", F.coalesce("k.below", F.lit(2.0)).alias("below"),
                F.coalesce("i.place", F.lit(-1.0)).alias("cut")), "cuts")


def _taken(draw: Column, size: Column) -> Column:
    """How often a document is in the mix."""
    place = place_of(draw, size, F.col("fraction"), F.col("mean_lean"))
    once_more = (F.col("fraction") > 0) & ((place < F.col("below"))
                                           | (place <= F.col("cut")))
    return (F.col("copies") + F.when(once_more, 1).otherwise(0)).cast("bigint")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What every source's documents need to know: targets and cuts."""
    return cuts(rows, source_targets(rows, weights, most))


def _rows(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                              draw_of(F.col("doc_id"), F.col("text")).alias("draw")), "sizes")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target``, and
    ``taken``, the words the mix takes of it, repeats counted."""
    rows = _rows(docs)
    found = _with_source(rows, plan(rows, weights, most), F.col("source"))
    return found.select("doc_id", "size", "source_size", "target", (
        F.col("size") * _taken(F.col("draw"), F.col("size"))).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns."""
    document = F.col("_document")
    inside = docs.select(F.struct("*").alias("_document")).select(
        "_document", size_of(document["text"]).alias("_size"),
        draw_of(document["doc_id"], document["text"]).alias("_draw"))
    found = _with_source(inside, plan(_rows(docs), weights, most), document["source"])
    times = _taken(F.col("_draw"), F.col("_size")).cast("int")
    return (found.select("_document", F.explode(F.array_repeat(F.lit(0), times)))
            .select("_document.*"))
