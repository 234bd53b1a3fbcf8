"""Loading, naming, merging and filling of panel variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from causeway.functions.text import clean_name
from causeway.operators.likeness import first_or_most_alike
from causeway.sources.sinks import written
from causeway.spec import ENTITY_ALIASES, TIME_ALIASES, number, sniff


def load_variable(raw: DataFrame, variable: str, entity: str | None = None, time: str | None = None, value: str | None = None, order: Column | None = None) -> DataFrame:
    """(entity_id, year, ``variable``): columns found by alias, ids trimmed, numbers coerced, null keys dropped.

    Of rows with one key the first by ``order`` stays (by value where no order is given, nulls last).
    """
    e = entity if entity in raw.columns else sniff(raw.columns, ENTITY_ALIASES)
    t = time if time in raw.columns else sniff(raw.columns, TIME_ALIASES)
    rest = [c for c in raw.columns if c not in (e, t)]
    v = value if value in raw.columns else next((c for c in (variable, "value") if c in rest), rest[0] if len(rest) == 1 else None)
    if not (e and t and v):
        raise ValueError(f"no entity, time or value column among {', '.join(raw.columns)}")
    year = F.col(t).try_cast("double").cast("int")
    rows = raw.select(F.trim(F.col(e).cast("string")).alias("entity_id"), year.alias("year"), number(v).alias(variable), (order if order is not None else F.lit(0)).alias("_o"))
    rows = rows.where("entity_id is not null and entity_id <> '' and year is not null")
    first = Window.partitionBy("entity_id", "year").orderBy("_o", F.col(variable).asc_nulls_last())
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("entity_id", "year", variable)


def merge_panels(parts: dict[str, DataFrame], entity: str = "entity_id", time: str = "year") -> DataFrame:
    """Full outer merge of variables on (entity, time) with one shuffle: tagged rows are stacked and pivoted."""
    if not parts:
        raise ValueError("nothing to merge")
    tagged = [df.select(F.col(entity), F.col(time), F.lit(name).alias("_v"), F.col(name).cast("double").alias("_x")) for name, df in parts.items()]
    long = reduce(DataFrame.union, tagged)
    return long.groupBy(entity, time).agg(*(F.first(F.when(F.col("_v") == name, F.col("_x")), ignorenulls=True).alias(name) for name in parts))


def balance(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Entities, periods, rows, rows of a full panel, and the share missing in percent to one place."""
    a = df.agg(F.countDistinct(entity).alias("entities"), F.countDistinct(time).alias("periods"), F.count(F.lit(1)).alias("n_rows"))
    expected = F.col("entities") * F.col("periods")
    return a.select("*", expected.alias("expected"), (F.col("n_rows") == expected).alias("balanced"), F.round(100 * (1 - F.col("n_rows") / F.nullif(expected, F.lit(0))), 1).alias("missing_pct"))


def missing_runs(df: DataFrame, entity: str, time: str, variable: str) -> DataFrame:
    """(entity, start, stop, length, kind) of every run of nulls.

    systematic: the entity has no value at all; boundary: one period at an end; sporadic: one inside;
    gap_run: longer.
    """
    w = Window.partitionBy(entity).orderBy(time)
    null = F.col(variable).isNull()
    marked = df.select(entity, time, null.alias("_null"), F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(entity)).alias("_n"), F.count(variable).over(Window.partitionBy(entity)).alias("_k"))
    marked = marked.withColumn("_island", F.col("_i") - F.row_number().over(Window.partitionBy(entity, "_null").orderBy(time)))
    runs = marked.where("_null").groupBy(entity, "_island").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count(F.lit(1)).alias("length"), F.min("_i").alias("lo"), F.max("_i").alias("hi"), F.first("_n").alias("n"), F.first("_k").alias("k"))
    kind = F.when(F.col("k") == 0, "systematic").when(F.col("length") > 1, "gap_run").when((F.col("lo") == 1) | (F.col("hi") == F.col("n")), "boundary").otherwise("sporadic")
    return runs.select(entity, "start", "stop", "length", kind.alias("kind"))


def impute_sporadic(df: DataFrame, entity: str, time: str, variable: str, max_gap: int = 1, least: int = 3) -> DataFrame:
    """Fills nulls inside runs of at most ``max_gap`` with the mean of the values on either side.

    Runs at an end and entities of fewer than ``least`` rows stay; ``{variable}_imputed`` is 1 where a
    value was filled.
    """
    w = Window.partitionBy(entity).orderBy(time)
    prev = F.last(variable, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(entity).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1)
    next_ = F.last(variable, True).over(back)
    null = F.col(variable).isNull()
    x = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(entity)))
    seen = F.when(~null, F.col("_i"))
    before = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(seen, True).over(back)
    fill = null & prev.isNotNull() & next_.isNotNull() & (after - before - 1 <= max_gap) & (F.col("_n") >= least)
    x = x.withColumn("_fill", F.coalesce(fill, F.lit(False))).withColumn("_mid", (prev + next_) / 2)
    return x.select(*(F.when(F.col("_fill"), F.col("_mid")).otherwise(F.col(c)).alias(c) if c == variable else F.col(c) for c in df.columns), F.col("_fill").cast("int").alias(f"{variable}_imputed"))


def normalise_entities(df: DataFrame, entity: str, mapping: DataFrame, fuzzy: bool = True, least: float = 0.75) -> DataFrame:
    """Replaces names by codes: as written, then cleaned, then cleaned against cleaned, then by likeness.

    ``mapping`` is (alias, code, position) of a dictionary of any size. Likeness is tried on the distinct names left over: the first alias that contains or is contained (two letters at
    least), else the most alike by the share of matching blocks, from ``least`` on, the first of equals. Names
    without a match, blanks and the words nan, none and null stay.
    """
    m = mapping.select(F.col("alias").alias("_a"), F.col("code").alias("_code"), F.col("position").alias("_p"), clean_name(F.col("alias")).alias("_ca"))
    first = lambda key: m.groupBy(F.col(key).alias("_k")).agg(F.min_by("_code", "_p").alias("_c"))
    names = df.select(F.col(entity).alias("_name")).distinct().withColumn("_clean", clean_name(F.col("_name")))
    real = ~F.lower(F.trim("_name")).isin("", "nan", "none", "null")
    exact, cleaned = first("_a"), first("_ca")
    x = names.join(exact.select(F.col("_k").alias("_name"), F.col("_c").alias("_c1")), "_name", "left")
    x = x.join(exact.select(F.col("_k").alias("_clean"), F.col("_c").alias("_c2")), "_clean", "left").join(cleaned.select(F.col("_k").alias("_clean"), F.col("_c").alias("_c3")), "_clean", "left")
    x = x.withColumn("_hit", F.coalesce("_c1", "_c2", "_c3"))
    if fuzzy:
        left = x.where(F.col("_hit").isNull() & real & (F.length("_clean") > 0)).select(F.col("_clean").alias("l")).distinct()
        order = F.struct("_p", "_a")
        entries = m.where(F.col("_ca") != "").groupBy(F.col("_ca").alias("r")).agg(F.min_by("_code", order).alias("code"), F.min(order).alias("at"))
        found = first_or_most_alike(written(left, "names"), written(entries, "aliases"), least)
        x = x.join(found.select(F.col("l").alias("_clean"), F.col("code").alias("_c4")), "_clean", "left").withColumn("_hit", F.coalesce("_hit", "_c4"))
    known = x.where(F.col("_hit").isNotNull() & real).select("_name", "_hit")
    return df.join(known, F.col(entity) == F.col("_name"), "left").select(*(F.coalesce("_hit", F.col(c)).alias(c) if c == entity else F.col(c) for c in df.columns))


def map_from_pairs(df: DataFrame, name: str, code: str) -> DataFrame:
    """(alias, code): names that stand beside a six-digit code; the smallest code of a name counts."""
    return df.where(F.col(code).rlike(r"^\d{6}$") & ~F.col(name).rlike(r"^\d+$")).groupBy(F.trim(name).alias("alias")).agg(F.min(code).alias("code"))


def name_variants(table: DataFrame) -> DataFrame:
    """(alias, code, position) of (name, code): the code, the name, and the name without its ending; on conflict the
    shorter code, then the first in order, counts."""
    v = table.select("code", "position", F.explode(F.array_distinct(F.array("code", "name", clean_name(F.col("name"))))).alias("alias"))
    best = v.groupBy("alias").agg(F.min(F.struct(F.length("code"), "position", "code")).alias("b"))
    return best.select("alias", F.col("b.code").alias("code"), F.col("b.position").alias("position"))


def attach_treatment(panel: DataFrame, timing: DataFrame, entity: str = "entity_id", time: str = "year") -> DataFrame:
    """Adds first_treated, treated, post and treated_post from (entity, first_treated)."""
    x = panel.join(timing.select(entity, "first_treated"), entity, "left")
    treated = F.col("first_treated").isNotNull().cast("int")
    post = F.coalesce((F.col(time) >= F.col("first_treated")).cast("int"), F.lit(0))
    return x.withColumns({"treated": treated, "post": post, "treated_post": treated * post})


def missing_verdicts(df: DataFrame, entity: str, time: str, variables: list[str]) -> DataFrame:
    """(variable, missing, pct, entities, systematic, sporadic, boundary, gap_runs, verdict) of each variable.

    warn_systematic and warn_sporadic where those are over three tenths of the entities, has_gaps where runs are longer
    than a period, minor with any other null, else ok.
    """
    out = None
    units = df.agg(F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("_n"), *(F.sum(F.col(v).isNull().cast("long")).alias(f"_m{k}") for k, v in enumerate(variables)))
    for k, v in enumerate(variables):
        kind = lambda x: F.coalesce(F.sum((F.col("kind") == x).cast("long")), F.lit(0))
        runs = missing_runs(df, entity, time, v).agg(
            F.countDistinct(F.when(F.col("kind") == "systematic", F.col(entity))).alias("systematic"), kind("sporadic").alias("sporadic"), kind("boundary").alias("boundary"), kind("gap_run").alias("gap_runs")
        )
        many = F.col("entities") * 0.3
        verdict = F.when(F.col("systematic") > many, "warn_systematic").when(F.col("sporadic") > many, "warn_sporadic").when(F.col("gap_runs") > 0, "has_gaps").when(F.col("missing") > 0, "minor").otherwise("ok")
        one = units.crossJoin(F.broadcast(runs)).withColumn("missing", F.coalesce(f"_m{k}", F.lit(0)))  # one row each
        one = one.select(F.lit(v).alias("variable"), "missing", F.round(100 * F.col("missing") / F.nullif("_n", F.lit(0)), 4).alias("pct"), "entities", "systematic", "sporadic", "boundary", "gap_runs", verdict.alias("verdict"))
        out = one if out is None else out.union(one)
    return out


def forward_fill(df: DataFrame, by: str | None, order: str, columns: list[str]) -> DataFrame:
    """Nulls take the value before them within ``by`` (merged cells of a table, gaps of a series); leading ones stay.

    Without ``by`` the whole frame is one sequence, which suits a table's rows only.
    """
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ("entity_id", "year", "post", "treated_post")) -> list[str]:
    """Names of the columns that hold numbers, less those that are keys or made from others."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def first_treated_column(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``name`` as a column of first treated periods: a column, or a number that holds for all units."""
    if name in df.columns:
        return df, name
    try:
        year = float(name)
    except ValueError:
        raise ValueError(f"{name!r} is neither a column nor a number") from None
    return df.withColumn("_first_treated", F.lit(year)), "_first_treated"


def head_samples(df: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of each key; ``n`` is the feature, for reports."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def ordered_union(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames with each key once: that of the first frame that has it. Rows of one frame with equal keys
    are told apart by their columns' order."""
    tagged = [f.withColumn("_from", F.lit(k)) for k, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in every.columns if c not in (key, "_from")]
    w = Window.partitionBy(key).orderBy("_from", *rest)
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_from")
