"""Wide and long forms, series by keyword, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from causeway.functions.text import any_keyword, expand_query, has_chinese, infer_level, infer_place, text_match, tokens
from causeway.operators.likeness import grams
from causeway.operators.ranges import exact_quantiles


def wide_to_long(df: DataFrame, keep: list[str], labels: dict[str, str], name: str = "entity_id", value: str = "value") -> DataFrame:
    """Melts the columns of ``labels`` to rows; a column that isn't there is looked up by its first two letters or as a part."""
    found = {}
    for col, label in labels.items():
        hit = col if col in df.columns else next((c for c in df.columns if c not in keep and (col[:2] in c or col in c)), None)
        if hit:
            found[hit] = label
    if not found:
        return df
    long = df.select(*keep, *(F.col(c).try_cast("double").alias(label) for c, label in found.items()))
    return long.unpivot(keep, list(found.values()), name, value).where(F.col(value).isNotNull())


def first_column(df: DataFrame, candidates: list[str], entity: str, keep: list[str]) -> DataFrame:
    """A constant entity and the first candidate column as value; nulls go."""
    c = next((x for x in candidates if x in df.columns), None)
    if c is None:
        raise ValueError(f"none of {', '.join(candidates)} is a column")
    return df.select(F.lit(entity).alias("entity_id"), *keep, F.col(c).try_cast("double").alias("value")).where("value is not null")


def pivot_wide(df: DataFrame, time: str, entity: str, value: str) -> DataFrame:
    """A row per period and a column per entity; a repeated key is an error."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("an entity has two rows for one period"))).otherwise(F.first(value))
    return df.groupBy(time, entity).agg(one.cast("double").alias("_v")).groupBy(time).pivot(entity).agg(F.first("_v"))


def melt_dates(df: DataFrame, entity: str, contains: str | None = None) -> DataFrame:
    """(entity_id, date, value) of a table with a column per date, for entities whose name contains the words given."""
    dates = [c for c in df.columns if len(c) == 10 and c[4] == c[7] == "-" and c.replace("-", "").isdigit()]
    rows = df if contains is None else df.where(F.lower(entity).contains(contains.lower()))
    long = rows.select(F.col(entity).alias("entity_id"), *(F.col(c).try_cast("double").alias(c) for c in dates)).unpivot(["entity_id"], dates, "date", "value")
    return long.where("value is not null").select("entity_id", F.to_date("date").alias("date"), "value")


def aggregate_by_month(df: DataFrame, ts: str, entity: str, column: str | None, how: str = "sum") -> DataFrame:
    """(entity_id, year, month, value): sum, mean, median or count of a column, or rows where it is missing."""
    if how == "median" and column in df.columns:
        months = df.select(F.year(ts).alias("year"), F.month(ts).alias("month"), column)
        found = exact_quantiles(months, {column: [0.5]}, ["year", "month"])  # a number a month
        return df.sparkSession.createDataFrame([(entity, y, m, q[0]) for (y, m, _), q in found.items()], "entity_id string, year int, month int, value double")
    ways = {"sum": F.sum, "mean": F.avg, "median": F.count, "count": F.count}
    value = ways[how](column) if column in df.columns else F.count(F.lit(1))
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(value.cast("double").alias("value")).select(F.lit(entity).alias("entity_id"), "year", "month", "value")


MOST_ENTRIES = 100_000


def _bounded(catalogue: DataFrame) -> DataFrame:
    """The catalogue, to be broadcast, once its size is known; every query meets every entry, so a larger one is an error."""
    if catalogue.count() > MOST_ENTRIES:
        raise ValueError(f"a catalogue of over {MOST_ENTRIES} entries is too large to be searched by likeness")
    return F.broadcast(catalogue)


def search_catalogue(queries: DataFrame, catalogue: DataFrame, top: int = 5, least: float = 0.1) -> DataFrame:
    """(query, key, score, rank): .35 description + .35 key + .15 level, .15 more if key or description is the query.

    ``queries`` is (query, level); ``catalogue`` is (key, description, level) of MOST_ENTRIES rows at most.
    """
    q, c = queries.alias("q"), _bounded(catalogue).alias("c")
    desc, name = text_match(F.col("q.query"), F.col("c.description")), text_match(F.col("q.query"), F.col("c.key"))
    exact = (F.lower("q.query") == F.lower("c.key")) | (F.lower("q.query") == F.lower("c.description"))
    same = F.coalesce((F.col("q.level") == F.col("c.level")).cast("double"), F.lit(0.0))
    score = 0.35 * desc + 0.35 * name + 0.15 * same + F.when(exact, 0.15).otherwise(0.0)
    both = q.join(c, F.lit(True)).select("q.query", "c.key", F.round(score, 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search_requirements(requirements: DataFrame, catalogue: DataFrame, top: int = 3, least: float = 0.3) -> DataFrame:
    """(name, key, score, rank): for each requirement the entries that score ``least`` or more, ``top`` at most.

    ``requirements`` is (name, description, level, place), ``catalogue`` is (key, search_text, level). The score is .35
    of the description's match with the entry's text, .35 of the name's with its key, .15 of the levels' (half of it
    where neither is in the other), and .15 more for an equal name. The level comes from the hint or the description.
    Entries that share no word, pair of letters or character with name or description can't get there: only those that
    share a part are compared, of equal scores the first key counts first.
    """
    r = requirements.select("name", F.coalesce("description", "name").alias("_d"), "level").distinct()
    r = r.select("name", "_d", infer_level(F.col("_d"), F.col("level")).alias("_l"))
    c = catalogue.select("key", F.coalesce("search_text", F.lit("")).alias("_t"), F.coalesce("level", F.lit("")).alias("_cl"))
    asked = r.select("name", "_d", "_l", F.explode(F.array_distinct(F.concat(_parts("_d", "asked"), _parts("name", "asked")))).alias("g"))
    offered = c.select("key", "_t", "_cl", F.explode(F.array_distinct(F.concat(_parts("_t", "offered"), _parts("key", "offered")))).alias("g"))
    both = asked.join(offered, "g").drop("g").distinct()
    fit = F.when(F.col("_cl").contains(F.col("_l")) | F.col("_l").contains(F.col("_cl")), 1.0).otherwise(0.5)
    exact = F.when(F.lower("name") == F.lower("key"), 0.15).otherwise(0.0)
    score = 0.35 * text_match(F.col("_d"), F.col("_t")) + 0.35 * text_match(F.col("name"), F.col("key")) + 0.15 * fit + exact
    scored = both.select("name", "key", score.alias("s")).where(F.col("s") >= least)
    w = Window.partitionBy("name").orderBy(F.desc("score"), "key")
    return scored.select("name", "key", F.round("s", 3).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _parts(column: str, side: str) -> Column:
    """Words, characters and pairs of letters by which two texts that match at all can meet.

    A text of one letter is looked for among the letters of all texts of the other side, under a mark of its side.
    """
    low, none = F.lower(F.trim(column)), F.array().cast("array<string>")
    words = tokens(F.when(has_chinese(low), expand_query(low)).otherwise(low)) if side == "asked" else tokens(low)
    other = {"asked": "offered", "offered": "asked"}[side]
    alone = F.when(F.length(low) == 1, F.array(F.concat(F.lit(f"{side} "), low))).otherwise(none)
    letters = F.transform(grams(low, 1), lambda x: F.concat(F.lit(f"{other} "), x))
    return F.filter(F.concat(words, grams(low, 2), alone, letters), lambda x: x != "")


def match_concepts(concepts: DataFrame, catalogue: DataFrame, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """(concept, key, score): 100 for the key, 50 for a part of it, 40 in the description, 30 for a hint's word, 5 per shared word."""
    a, b = concepts.alias("a"), _bounded(catalogue).alias("b")
    k, desc = F.lower("b.key"), F.lower("b.description")
    x = F.lower("a.concept")
    shared = F.size(F.array_intersect(F.split(F.regexp_replace(x, "_", " "), " "), F.split(desc, " ")))
    hint = F.lit(0)
    for concept, words in (hints or {}).items():
        hint = F.when((F.col("a.concept") == concept) & any_keyword(F.col("b.description"), words), 30).otherwise(hint)
    score = F.when(k == x, 100).otherwise(0) + F.when((k != x) & k.contains(x), 50).otherwise(0) + F.when(desc.contains(F.regexp_replace(x, "_", " ")), 40).otherwise(0) + hint + 5 * shared
    return a.join(b, F.lit(True)).select("a.concept", "b.key", score.alias("score")).where("score > 0")


def requirements(matches: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, key, score, tier): the best key; A (found) from 50 points, B with some, C with none."""
    best = matches.groupBy("concept").agg(F.max(F.struct("score", F.col("key"))).alias("b"))
    tier = F.when(F.col("b.score") >= 50, "A").when(F.col("b.score").isNotNull(), "B").otherwise("C")
    return concepts.join(best, "concept", "left").select("concept", F.col("b.key").alias("key"), F.col("b.score").alias("score"), tier.alias("tier"))


def gap_report(requirements: DataFrame, found: DataFrame, fetched: DataFrame) -> DataFrame:
    """(name, section, key, score, alternatives, tier, suggestion): where each required variable stands.

    ``requirements`` is (name, description, level, place), ``found`` the ranked matches of search_catalogue() with the
    name as query, ``fetched`` (name, status). fetched: it is there; available: its best match scores half or more; needed:
    to be collected by hand, B from surveys and other sources, C from yearbooks and policy documents.
    """
    ranked = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("m"))
    ok = fetched.where(F.col("status").isin("success", "cached")).select(F.col("name").alias("_ok")).distinct()
    x = requirements.join(ranked, F.col("name") == F.col("query"), "left").join(ok, F.col("name") == F.col("_ok"), "left")
    best = F.get("m", F.lit(0))
    section = F.when(F.col("_ok").isNotNull(), "fetched").when(best["score"] >= 0.5, "available").otherwise("needed")
    desc = F.lower(F.coalesce("description", "name"))
    level, place = infer_level(desc, F.col("level")), infer_place(desc, F.col("place"))
    survey, yearbook, policy = desc.contains("micro") | desc.contains("survey"), level.isin("city", "province") & (place == "cn"), desc.contains("policy") | desc.contains("pilot")
    tier = F.when(section != "needed", "A").when(survey, "B").when(yearbook | policy, "C").otherwise("B")
    suggestion = F.when(section == "needed", F.when(survey, "survey data, after registration").when(yearbook, "statistical yearbooks, or by hand").when(policy, "policy documents, by hand").otherwise("not in public sources searched"))
    others = F.when(section == "available", F.array_join(F.transform(F.slice("m", 2, 2), lambda k: k["key"]), ", "))
    return x.select("name", section.alias("section"), F.when(section == "available", best["key"]).alias("key"), F.when(section == "available", best["score"]).alias("score"), others.alias("alternatives"), tier.alias("tier"), suggestion.alias("suggestion"))


def gap_summary(report: DataFrame) -> DataFrame:
    """(fetched, available, needed): how many variables each."""
    return report.agg(*(F.sum((F.col("section") == s).cast("long")).alias(s) for s in ("fetched", "available", "needed")))
