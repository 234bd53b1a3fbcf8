"""Order statistics without a sort in one task: ranges of a column, running sums over them, exact quantiles, ranks per draw.

What decides which range a row is in is a value, never the partition it happens to lie in, so that a task that is run
again after an executor was lost puts its rows where they were. The driver sees counts and borders of ranges, and of a
wanted rank's last range its SMALL values at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_RANGE = 200_000
MOST_RANGES = 10_000
BUCKETS = 1024  # by which a range is refined
SMALL = 4096  # values that a range may have to be sorted as a whole


def with_range(df: DataFrame, order: str, name: str = "_range", rows: int | None = None) -> DataFrame:
    """``df`` with ``name``, the number of the row's range of ``order`` (a double), as many rows in each as can be.

    There is a range for every ROWS_A_RANGE rows. Rows of equal ``order`` share one; a null is in the last.
    """
    n = df.count() if rows is None else rows
    parts = min(MOST_RANGES, -(-n // ROWS_A_RANGE))
    cuts = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=order, outputCol=name, handleInvalid="keep").transform(df)


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows of smaller ``order``, which is unique and not null.

    A range's own running sum and the totals of the ranges before it (a number a range) make the sum.
    """
    ranged = with_range(df, order)
    offset, starts = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.sum(value).alias("s")).collect()):
        starts.append((r["_range"], offset))
        offset += r["s"] or 0
    starts = df.sparkSession.createDataFrame(starts, f"_range double, _start {df.select(F.sum(value)).dtypes[0][1]}")
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn(name, F.coalesce(own, F.lit(0))).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


@dataclass
class _Target:
    """A rank (from 0) of a group's column, known to be among the ``n`` values from ``lo`` to ``hi``, ``before`` the rest."""

    group: tuple
    column: int
    rank: int
    lo: float
    hi: float
    n: int
    before: int
    value: float | None = None


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], by: list[str] = ()) -> dict[tuple, list[float | None]]:
    """{(*group, column): quantiles} for each column's shares, interpolated between neighbours as ``percentile`` does.

    Selection in several passes: the range that has a wanted rank is cut into BUCKETS, of which one has it, and so on
    until its values are equal or SMALL in number. No task holds a column's values, and the driver gets a count, a
    least and a largest value for each bucket and the few values of the last. Nulls and NaN are left out; a column without values gives nulls. Groups
    (``by``) should be few, as their ranges are broadcast.
    """
    columns, keys = list(wanted), [f"_g{k}" for k in range(len(by))]
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns))))
    long = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), cells.alias("_v")).select(*keys, F.col("_v.c").alias("_c"), F.col("_v.x").alias("_x")).where("_x is not null and not isnan(_x)")
    whole = {(*(r[k] for k in keys), r["_c"]): r for r in long.groupBy(*keys, "_c").agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect()}
    targets: dict[tuple, _Target] = {}
    for key, r in whole.items():
        for p in wanted[columns[key[-1]]]:
            at = p * (r["n"] - 1)
            for rank in {int(at), min(int(at) + 1, r["n"] - 1)}:
                targets[(*key, rank)] = _Target(key[:-1], key[-1], rank, r["lo"], r["hi"], r["n"], 0)
    kinds = {f.name: f.dataType.simpleString() for f in long.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_c int", "_lo double", "_hi double"])
    open_ = lambda: [t for t in targets.values() if t.value is None]
    while True:
        for t in open_():
            if t.lo == t.hi:
                t.value = t.lo
        small = all(t.n <= SMALL for t in open_())
        ranges = {(t.group, t.column, t.lo, t.hi) for t in open_() if small or t.n > SMALL}
        if not ranges:
            break
        of = F.broadcast(df.sparkSession.createDataFrame([(*g, c, lo, hi) for g, c, lo, hi in ranges], schema))
        on = [long[k].eqNullSafe(of[k]) for k in keys] + [long["_c"] == of["_c"], long["_x"].between(of["_lo"], of["_hi"])]
        inside = long.join(of, on).select(*(long[k] for k in keys), long["_c"], "_lo", "_hi", "_x")
        if small:
            found = {(tuple(r[k] for k in keys), r["_c"], r["_lo"], r["_hi"]): r["x"] for r in inside.groupBy(*keys, "_c", "_lo", "_hi").agg(F.sort_array(F.collect_list("_x")).alias("x")).collect()}
            for t in open_():
                t.value = found[t.group, t.column, t.lo, t.hi][t.rank - t.before]
            continue
        # halves, as a difference of two doubles may overflow; infinite values count as the largest ones
        clamp = lambda c: F.greatest(F.least(F.col(c), F.lit(1.7e308)), F.lit(-1.7e308)) / 2
        share = (clamp("_x") - clamp("_lo")) / (clamp("_hi") - clamp("_lo"))
        bucket = F.when(F.col("_x") == F.col("_hi"), BUCKETS - 1).when(F.col("_x") == F.col("_lo"), 0).otherwise(F.greatest(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)))
        counted = inside.groupBy(*keys, "_c", "_lo", "_hi", bucket.alias("b")).agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).collect()
        parts: dict[tuple, list] = {}
        for r in sorted(counted, key=lambda r: r["b"]):
            parts.setdefault((tuple(r[k] for k in keys), r["_c"], r["_lo"], r["_hi"]), []).append(r)
        for t in open_():
            if t.n > SMALL:
                for r in parts[t.group, t.column, t.lo, t.hi]:
                    if t.rank < t.before + r["n"]:
                        t.lo, t.hi, t.n = r["lo"], r["hi"], r["n"]
                        break
                    t.before += r["n"]
    out: dict[tuple, list[float | None]] = {} if by else {(c,): [None] * len(p) for c, p in wanted.items()}
    for key, r in whole.items():
        values = []
        for p in wanted[columns[key[-1]]]:
            at = p * (r["n"] - 1)
            low, high = (targets[(*key, k)].value for k in (int(at), min(int(at) + 1, r["n"] - 1)))
            values.append(low if low == high else (int(at) + 1 - at) * low + (at - int(at)) * high)
        out[(*key[:-1], columns[key[-1]])] = values
    return out


@dataclass(frozen=True)
class _Cut:
    """Of a draw's keys: the rank-th (from 1) is among the ``n`` from ``lo`` to ``hi``, with ``before`` less than those."""

    draw: int
    rank: int
    lo: int
    hi: int
    n: int
    before: int


CUT_SCHEMA = "draw int, _rank int, _lo long, _hi long, _before long"


def _within(pairs: DataFrame, cuts: list[_Cut]) -> DataFrame:
    table = pairs.sparkSession.createDataFrame([(c.draw, c.rank, c.lo, c.hi, c.before) for c in cuts], CUT_SCHEMA)
    return pairs.join(F.broadcast(table), "draw").where(F.col("key").between(F.col("_lo"), F.col("_hi")))


def _narrowed(pairs: DataFrame, cuts: list[_Cut]) -> list[_Cut]:
    """Each cut with the one of BUCKETS parts of its keys that has its rank."""
    step = F.floor(F.col("_hi") / BUCKETS - F.col("_lo") / BUCKETS) + 1
    counted = _within(pairs, cuts).groupBy("draw", "_rank", "_before", F.floor((F.col("key") - F.col("_lo")) / step).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    one = F.struct("b", "n", "lo", "hi")
    bins = counted.groupBy("draw", "_rank", "_before").agg(F.sort_array(F.collect_list(one)).alias("bins"))  # BUCKETS at most
    start = F.struct(F.col("_before").alias("before"), F.lit(None).cast("struct<b:bigint,n:bigint,lo:bigint,hi:bigint>").alias("bin"))

    def step_to(s: Column, x: Column) -> Column:
        there = s["before"] + x["n"] >= F.col("_rank")
        return F.when(s["bin"].isNotNull(), s).when(there, F.struct(s["before"].alias("before"), x.alias("bin"))).otherwise(F.struct((s["before"] + x["n"]).alias("before"), s["bin"].alias("bin")))

    found = bins.select("draw", "_rank", F.aggregate("bins", start, step_to).alias("f")).select("draw", "_rank", "f.before", "f.bin.*").where("n is not null").collect()
    return [_Cut(r["draw"], r["_rank"], r["lo"], r["hi"], r["n"], r["before"]) for r in found]


def kth_of_each_draw(pairs: DataFrame, draws: int, ranks: list[int], rows: int) -> dict[tuple[int, int], tuple]:
    """{(draw, rank): (key, id)}: the rank-th (from 1) of each draw's rows by (key, id).

    ``pairs`` has draw (1 to ``draws``), key (a long within 62 bits) and _e, with ``rows`` rows a draw. Counts over
    buckets of the key tell which bucket has the rank; that is cut again while it has more than SMALL rows of
    different keys, and what is left is sorted by draw. Neither draws nor keys are sorted as a whole. What reaches the
    driver is a row for each draw and rank; ranks that a draw doesn't have are left out.
    """
    cuts = [_Cut(d, k, -(1 << 62), 1 << 62, rows, 0) for d in range(1, draws + 1) for k in ranks]
    if rows > SMALL:
        span = pairs.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        cuts = [_Cut(c.draw, c.rank, span["lo"], span["hi"], rows, 0) for c in cuts]
    while wide := [c for c in cuts if c.n > SMALL and c.hi > c.lo]:
        cuts = [c for c in cuts if c not in wide] + _narrowed(pairs, wide)
    if not cuts:
        return {}
    last = _within(pairs, cuts).groupBy("draw", "_rank", "_before").agg(F.sort_array(F.collect_list(F.struct("key", "_e"))).alias("x"))
    found = last.select("draw", "_rank", F.get("x", (F.col("_rank") - F.col("_before") - 1).cast("int")).alias("x")).where("x is not null").collect()
    return {(r["draw"], r["_rank"]): (r["x"]["key"], r["x"]["_e"]) for r in found}


def not_after(key: Column, id_: Column, cut_key: Column, cut_id: Column) -> Column:
    """(key, id) is at or before the cut."""
    return (key < cut_key) | ((key == cut_key) & (id_ <= cut_id))
