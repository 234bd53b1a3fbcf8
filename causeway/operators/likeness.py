"""Likeness joins of names by an inverted index of q-grams that loses no pair.

Two strings of ``a`` and ``b`` letters whose matching blocks cover the share ``least`` of both (2 M / (a + b), as
``difflib`` has it) have M >= least (a + b) / 2 letters in blocks. Between two blocks at least one letter is unmatched,
so there are at most a + b - 2 M + 1 blocks, and inside them at least 3 M - (a + b) - 1 pairs of neighbours that both
strings have. Where that is nothing to speak of, as in short strings, single letters are looked up instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, q: int) -> Column:
    """Runs of ``q`` letters in order."""
    n = F.length(text) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def _numbered(of: Column) -> Column:
    """Each gram with how often it came before, so that equal ones of two strings meet as often as both have them."""
    return F.transform(of, lambda g, i: F.concat(g, F.lit("\u0001"), F.size(F.filter(F.slice(of, 1, i), lambda x: x == g)).cast("string")))


def _letters(total: Column, least: float) -> Column:
    """Letters in blocks that strings of so many letters together must have; a little less, against rounding."""
    return F.ceil(total * F.lit(least / 2) - 1e-9)


def _pairs(total: Column, least: float) -> Column:
    """Pairs of neighbours that strings of so many letters together must have in common."""
    return 3 * _letters(total, least) - total - 1


def _rarest(rows: DataFrame, key: str, count: DataFrame, keep: Column) -> DataFrame:
    """Of each row's grams (``key``, g, keep columns) the ``keep`` rarest by ``count`` (g, n)."""
    known = rows.join(count, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = known.groupBy(key, *(c for c in rows.columns if c not in (key, "g"))).agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("gs"))
    return own.select(key, *(c for c in rows.columns if c not in (key, "g")), F.explode(F.slice("gs", 1, keep)).alias("x")).select(key, *(c for c in rows.columns if c not in (key, "g")), F.col("x.g").alias("g"))


def _counted(grams_: DataFrame) -> DataFrame:
    return grams_.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def alike_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (l, r) that may be alike from ``least`` on; every pair that is so is among them.

    ``left`` is (l) and ``right`` is (r), distinct strings. Of a left string only the rarest grams are looked up (one
    more than may be missing), and only in strings whose length lets the pair be as alike.
    """
    a, b = F.length("l"), F.length("r")
    fits = 2 * F.least("a", "b") >= (F.col("a") + F.col("b")) * F.lit(least) - 1e-9
    out = None
    for q in (2, 1):
        need = _pairs if q == 2 else _letters
        # the pair of lengths decides by which grams it is found: neighbours where at least one is certain
        by_pairs = _pairs(F.col("a") + F.col("b"), least) >= 1
        lengths = right.select(b.alias("b")).distinct().crossJoin(F.broadcast(left.select(a.alias("a")).distinct())).where(fits & (by_pairs if q == 2 else ~by_pairs))  # of lengths, which are few
        needed = lengths.groupBy("a").agg(F.min(need(F.col("a") + F.col("b"), least)).alias("need"))
        mine = left.select("l", a.alias("a")).join(F.broadcast(needed), "a").select("l", "a", "need", F.explode(_numbered(grams(F.col("l"), q))).alias("g"))
        theirs = right.select("r", b.alias("b"), F.explode(_numbered(grams(F.col("r"), q))).alias("g"))
        size = F.size("gs")
        few = _rarest(mine, "l", _counted(theirs), F.greatest(size - F.greatest(F.col("need"), F.lit(1)) + 1, F.lit(1)).cast("int"))
        met = few.join(theirs, "g").where(fits & (by_pairs if q == 2 else ~by_pairs)).select("l", "r")
        out = met if out is None else out.union(met)
    return out.distinct()


def contained(left: DataFrame, right: DataFrame, shortest: int = 2) -> DataFrame:
    """Pairs (l, r) of which one has the other inside, both of ``shortest`` (2 or more) letters; the shorter's rarest pair of letters is looked up."""
    ls = left.where(F.length("l") >= shortest).select("l", F.explode(F.array_distinct(grams(F.col("l"), 2))).alias("g"))
    rs = right.where(F.length("r") >= shortest).select("r", F.explode(F.array_distinct(grams(F.col("r"), 2))).alias("g"))
    inside = _rarest(ls, "l", _counted(rs), F.lit(1)).join(rs, "g").where(F.col("r").contains(F.col("l"))).select("l", "r")
    around = _rarest(rs, "r", _counted(ls), F.lit(1)).join(ls, "g").where(F.col("l").contains(F.col("r"))).select("l", "r")
    return inside.union(around).distinct()


def ratio(left: Column, right: Column) -> Column:
    """Share of both strings in matching blocks."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)

    return run(left, right)


def first_or_most_alike(names: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """(l, code): of each name the first entry that contains it or is contained, else the most alike from ``least`` on, the first of equals.

    ``names`` is (l), distinct; ``entries`` is (r, code, at), distinct in r, with ``at`` for the order.
    """
    right = entries.select("r")
    within = contained(names, right).join(entries, "r").groupBy("l").agg(F.min_by("code", "at").alias("code"))
    rest = names.join(within, "l", "left_anti")
    scored = alike_candidates(rest, right, least).withColumn("score", ratio(F.col("l"), F.col("r"))).where(F.col("score") >= least)
    best = scored.join(entries, "r").groupBy("l").agg(F.min_by("code", F.struct((-F.col("score")).alias("s"), "at")).alias("code"))
    return within.union(best)
