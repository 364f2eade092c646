"""Expressions over one row's array of logits; none of them shuffles.

A value used inside a lambda is bound first, or it would be computed again for
every element of the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_normalizer(logits: Column) -> Column:
    """log(sum(exp(x))), shifted by the maximum so that it cannot overflow."""
    return bind(F.array_max(logits), lambda top: top + F.log(F.aggregate(
        logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def log_softmax(logits: Column) -> Column:
    return bind(log_normalizer(logits),
                lambda norm: F.transform(logits, lambda x: x - norm))


def argmax(logits: Column) -> Column:
    """Index of the largest logit, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def ban(logits: Column, token: int, when: Column) -> Column:
    """Set one token's logit to minus infinity where ``when`` holds."""
    return F.when(when, F.transform(logits, lambda x, i: F.when(
        i == token, F.lit(float("-inf"))).otherwise(x))).otherwise(logits)


def candidates(logits: Column) -> Column:
    """``array<struct<logit, token_id>>``, best first, low ids first on ties."""
    pairs = F.transform(logits, lambda x, i: F.struct(
        x.alias("logit"), (-i).cast("int").alias("order")))
    return F.transform(F.sort_array(pairs, asc=False), lambda p: F.struct(
        p["logit"], (-p["order"]).alias("token_id")))


def keep_top_k(ranked: Column, k: int) -> Column:
    """The ``k`` best candidates and all that tie with the last of them.

    With fewer than ``k`` candidates all stay.
    """
    def above_edge(r: Column) -> Column:
        edge = F.element_at(r, F.least(F.lit(k), F.size(r)))["logit"]
        return bind(edge, lambda e: F.filter(r, lambda c: c["logit"] >= e))

    return bind(ranked, above_edge)


def weights(ranked: Column) -> Column:
    """Probability of each candidate among those given, best first."""
    def shares(r: Column) -> Column:
        top = F.element_at(r, 1)["logit"]
        return bind(top, lambda t: _normalized(
            F.transform(r, lambda c: F.exp(c["logit"] - t))))

    return bind(ranked, shares)


def _normalized(masses: Column) -> Column:
    total = lambda m: F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x)
    return bind(masses, lambda m: bind(
        total(m), lambda t: F.transform(m, lambda x: x / t)))


def _passed(probs: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """How many entries satisfy ``holds(mass before, own mass)``."""
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        more = F.when(holds(s["mass"], p), F.lit(1)).otherwise(F.lit(0))
        return F.struct((s["mass"] + p).alias("mass"), (s["n"] + more).alias("n"))

    return F.aggregate(probs, start, step, lambda s: s["n"])


def keep_nucleus(ranked: Column, p: float) -> Column:
    """Candidates whose better ones hold at most ``p`` of the mass together.

    The mass before a candidate grows along the ranking, so the kept ones are
    a prefix, the first always in it.
    """
    return bind(ranked, lambda r: F.slice(r, F.lit(1), _passed(
        weights(r), lambda before, _: before <= F.lit(p))))


def draw(ranked: Column, u: Column) -> Column:
    """The first candidate at which the probability mass reaches ``u``."""
    def pick(r: Column) -> Column:
        short = _passed(weights(r), lambda before, own: before + own < u)
        return F.element_at(r, F.least(short + 1, F.size(r)))["token_id"]

    return bind(ranked, pick)
