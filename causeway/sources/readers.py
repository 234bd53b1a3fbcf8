"""Tables from files, and the parsing half of web connectors: saved payloads to long frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from causeway.functions.text import iso_date
from causeway.sources.sinks import exists

LONG = "entity_id string, year int, value double"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: parquet, orc, csv, txt, json, dta, xlsx. Columns are text where csv has no schema given.

    Stata and Excel files are read on the driver, which suits their size.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path)
    if kind in ("csv", "txt"):
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True)
        df = (reader.schema(schema) if schema else reader).csv(path, sep="," if kind == "csv" else "\t")
        return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    if kind == "json":
        return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)
    if kind in ("dta", "xlsx", "xls"):
        import pandas as pd

        local = path.removeprefix("file://")
        return spark.createDataFrame(pd.read_stata(local) if kind == "dta" else pd.read_excel(local))
    raise ValueError(f"unknown kind of file: {path}")


def resolve(spark: SparkSession, path: str, merged: str) -> str:
    """``path``, or the file of that name in the folder ``merged`` where only that exists."""
    other = f"{merged.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}"
    return other if not exists(spark, path) and exists(spark, other) else path


def entity_map(spark: SparkSession, path: str) -> DataFrame:
    """(alias, code, position) of a JSON object {alias: code}, in its order; empty where there is no file."""
    schema = "alias string, code string, position int"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.posexplode(F.map_entries("m"))).select(F.col("col.key").alias("alias"), F.col("col.value").alias("code"), F.col("pos").alias("position"))


CATALOGUE_FIELDS = "struct<description:string,source:string,level:string,keywords:array<string>,notes:string>"


def variable_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, description, source, level, keywords, notes) of a JSON object; keys that start with _ are comments."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e")).where(~F.col("e.key").startswith("_"))
    return raw.select(F.col("e.key").alias("key"), F.from_json("e.value", CATALOGUE_FIELDS).alias("v")).select("key", "v.*")


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def date_range(df: DataFrame, start: str | None, stop: str | None, col: str = "date") -> DataFrame:
    """Rows between the dates, both included."""
    x = df if start is None else df.where(F.col(col) >= F.to_date(F.lit(start)))
    return x if stop is None else x.where(F.col(col) <= F.to_date(F.lit(stop)))


def world_bank(payload: DataFrame) -> DataFrame:
    """(economy, YR2000, YR2001, ...) to long rows."""
    years = [c for c in payload.columns if c.startswith("YR") and c[2:].isdigit()]
    long = payload.select("economy", *(F.col(c).try_cast("double").alias(c) for c in years)).unpivot(["economy"], years, "y", "value")
    return long.where("value is not null").select(F.col("economy").alias("entity_id"), F.substring("y", 3, 4).cast("int").alias("year"), "value")


def fred(payload: DataFrame, series: str) -> DataFrame:
    """Observations {date, value}; a point, blank or null isn't a value."""
    schema = "observations array<struct<date:string,value:string>>"
    o = payload.select(F.explode(F.from_json("json", schema)["observations"]).alias("o"))
    return o.where(~F.col("o.value").isin(".", "") & F.col("o.value").isNotNull()).select(F.lit(series).alias("entity_id"), F.to_date("o.date").alias("date"), F.col("o.value").try_cast("double").alias("value"))


def oecd(payload: DataFrame, entity: Column | None = None) -> DataFrame:
    """SDMX-JSON of one country a row (name, json): dataSets[].observations keyed by positions joined by colons.

    The dimension TIME_PERIOD says which part of the key is the period (the last where it doesn't); a part that is a
    position in the dimension's values is looked up there, and is the year itself where none are listed.
    Of a list of values the first counts; what isn't a number or a year is left out.
    """
    dimension = "struct<name:string,id:string,keyPosition:int,values:array<struct<id:string>>>"
    schema = f"dataSets array<struct<observations:map<string,string>>>, structure struct<dimensions:struct<observation:array<{dimension}>>>"
    p = payload.select((F.col("name") if entity is None else entity).alias("entity_id"), F.from_json("json", schema).alias("p"))
    time = F.get(F.filter("p.structure.dimensions.observation", lambda d: F.coalesce(d["name"], d["id"]) == "TIME_PERIOD"), F.lit(0))
    sets = p.select("entity_id", time.alias("time"), F.explode("p.dataSets").alias("s"))
    o = sets.select("entity_id", "time", F.explode("s.observations").alias("key", "value"))
    parts = F.split("key", ":")
    at = F.col("time.keyPosition")
    part = F.when((at >= 0) & (at < F.size(parts)), F.get(parts, at)).otherwise(F.element_at(parts, -1))
    year = F.coalesce(F.get("time.values", part.try_cast("int"))["id"], part)
    value = F.regexp_extract("value", r"^\[?\s*([^,\]]*)", 1)
    rows = o.select("entity_id", F.substring(year, 1, 4).try_cast("int").alias("year"), value.try_cast("double").alias("value"))
    return rows.where("year is not null and value is not null")


def eurostat(payload: DataFrame, entity: Column | None = None) -> DataFrame:
    """JSON-stat of one place a row (name, json): values by flat position; dimension.time.category.index names the periods.

    With ``id`` and ``size`` the period's part of the position is worked out, and a dimension geo names the place; without
    them the position is the period's, and the payload's name is the place.
    """
    index = "struct<category:struct<index:map<string,int>>>"
    schema = f"value map<string,double>, id array<string>, size array<int>, dimension struct<time:{index},geo:{index}>"
    p = payload.select((F.col("name") if entity is None else entity).alias("name"), F.from_json("json", schema).alias("p")).select("name", "p.*")
    flipped = lambda c: F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["value"], e["key"])))

    def place(dimension: str, at: Column) -> Column:
        where = F.array_position("id", dimension).cast("int")
        stride = F.aggregate(F.slice("size", where + 1, F.greatest(F.size("size") - where, F.lit(0))), F.lit(1), lambda x, y: x * y)
        own = F.floor(at / stride).cast("int") % F.get("size", where - 1)
        return F.when(where > 0, own)

    v = p.select("name", "id", "size", flipped(F.col("dimension.time.category.index")).alias("t"), flipped(F.col("dimension.geo.category.index")).alias("g"), F.explode("value").alias("at", "value"))
    at = F.col("at").cast("int")
    year = F.try_element_at("t", F.coalesce(place("time", at), at))
    place_name = F.coalesce(F.try_element_at("g", F.coalesce(place("geo", at), F.lit(0))), "name")
    return v.select(place_name.alias("entity_id"), F.substring(year, 1, 4).try_cast("int").alias("year"), "value").where("year is not null and value is not null")


def campaign_finance(payload: DataFrame, fields: str) -> DataFrame:
    """Rows of ``results`` with the ``fields`` given (a schema), of a page of answers."""
    r = payload.select(F.explode(F.from_json("json", f"results array<struct<{fields}>>")["results"]).alias("r"))
    return r.select("r.*", F.lit("fec").alias("entity_id"))


#: Headings of a city's daily air quality.
AIR_COLUMNS = {"日期": "date", "AQI": "aqi", "PM2.5": "pm25", "PM10": "pm10", "SO2": "so2", "NO2": "no2", "CO": "co", "O3": "o3"}


def city_air_quality(rows: DataFrame, city: str | Column) -> DataFrame:
    """(entity_id, date, measures that are there) of one city, or of many where ``city`` is a column."""
    have = {a: b for a, b in AIR_COLUMNS.items() if a in rows.columns}
    measures = [F.col(f"`{a}`").try_cast("double").alias(b) for a, b in have.items() if b != "date"]
    return rows.select((F.lit(city) if isinstance(city, str) else city).alias("entity_id"), F.to_date(iso_date(F.col("日期").cast("string"))).alias("date"), *measures).where("date is not null")


def stock_index(rows: DataFrame, index: str) -> DataFrame:
    """(entity_id, date, open, high, low, close, volume), those that are there; headings in any case."""
    named = {c.lower(): c for c in rows.columns}
    kept = [F.col(f"`{named[c]}`").cast("double").alias(c) for c in ("open", "high", "low", "close", "volume") if c in named]
    return rows.select(F.lit(index).alias("entity_id"), F.to_date(named["date"]).alias("date"), *kept)


#: Census indicators by key, and headings of places, tried in order.
CENSUS = {
    "total_population": "常住人口", "male_population": "男性人口", "female_population": "女性人口", "sex_ratio": "性别比", "age_0_14_pct": "0-14岁占比", "age_15_59_pct": "15-59岁占比",
    "age_60_plus_pct": "60岁以上占比", "age_65_plus_pct": "65岁以上占比", "urban_population": "城镇人口", "urbanization_rate": "城镇化率", "avg_household_size": "平均家庭户规模",
    "college_edu_pct": "大专及以上占比", "illiteracy_rate": "文盲率", "avg_education_years": "平均受教育年限", "birth_rate": "出生率", "death_rate": "死亡率", "natural_growth_rate": "自然增长率", "migrant_population": "流动人口",
}
CENSUS_PLACES = ("地区", "城市", "省份", "地区名称", "城市名称")


def census(rows: DataFrame, indicator: str, year: int) -> DataFrame:
    """Long rows of one indicator of a census table, positive values only.

    The value is the column of the indicator's name; else the first that has the key or the name's first two letters in it; else the
    first further column that is a number. The place is the first column where none of the usual headings is there.
    """
    label = CENSUS.get(indicator, indicator)
    area = next((c for c in CENSUS_PLACES if c in rows.columns), rows.columns[0])
    likely = [c for c in rows.columns if indicator.replace("_", "") in c.replace(" ", "") or label[:2] in c]
    numeric = [c for c, t in rows.dtypes[1:] if t.startswith(("int", "bigint", "double", "float", "decimal", "smallint"))]
    column = label if label in rows.columns else next(iter(likely or numeric), None)
    if column is None:
        raise ValueError(f"no column for {indicator} among {', '.join(rows.columns)}")
    return rows.select(F.col(f"`{area}`").cast("string").alias("entity_id"), F.lit(year).alias("year"), F.col(f"`{column}`").try_cast("double").alias("value")).where("value > 0")


def zipped_trips(spark: SparkSession, path: str, columns: list[str], entity: str, year: int, month: int) -> DataFrame:
    """Trips of zipped csv files (one task per file): the ``columns`` as text, with entity_id, year and month.

    A column that a file lacks is null. Files are unpacked in pieces of 50,000 rows.
    """

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv") and "__MACOSX" not in n):
                        with z.open(name) as f:
                            for part in pd.read_csv(f, dtype=str, chunksize=50_000, keep_default_na=False, na_values=[""]):
                                part = part.reindex(columns=columns).astype(object)
                                yield part.where(part.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    rows = files.mapInPandas(unpack, ", ".join(f"`{c}` string" for c in columns))
    return rows.select("*", F.lit(entity).alias("entity_id"), F.lit(year).alias("year"), F.lit(month).alias("month"))


def national_statistics(payload: DataFrame) -> DataFrame:
    """Data nodes with codes of region and period, and the nodes that name the regions."""
    schema = "returndata struct<datanodes:array<struct<data:struct<data:double,hasdata:boolean>,wds:array<struct<wdcode:string,valuecode:string>>>>,wdnodes:array<struct<wdcode:string,nodes:array<struct<code:string,cname:string>>>>>"
    r = payload.select(F.from_json("json", schema)["returndata"].alias("r"))
    names = r.select(F.explode("r.wdnodes").alias("w")).where("w.wdcode = 'reg'").select(F.explode("w.nodes").alias("n")).select(F.col("n.code").alias("code"), F.col("n.cname").alias("cname")).distinct()
    d = r.select(F.explode("r.datanodes").alias("d")).where("d.data.hasdata")
    code = lambda k: F.get(F.filter("d.wds", lambda x: x["wdcode"] == k), F.lit(0))["valuecode"]
    rows = d.select(code("reg").alias("code"), F.substring(code("sj"), 1, 4).cast("int").alias("year"), F.col("d.data.data").alias("value"))
    return rows.join(names, "code", "left").select(F.coalesce("cname", "code").alias("entity_id"), "year", "value").where("value is not null")


def bls(payload: DataFrame) -> DataFrame:
    schema = "Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,periodName:string,value:string>>>>>"
    s = payload.select(F.explode(F.from_json("json", schema)["Results"]["series"]).alias("s")).select("s.seriesID", F.explode("s.data").alias("d"))
    return s.select(F.col("seriesID").alias("entity_id"), F.col("d.year").cast("int").alias("year"), F.col("d.period").alias("period"), F.col("d.periodName").alias("period_name"), F.col("d.value").try_cast("double").alias("value"))


def air_quality(rows: DataFrame) -> DataFrame:
    """Monitors: state-county-site as the entity, the mean or else the single sample as value."""
    key = F.concat_ws("-", F.lpad("state_code", 2, "0"), F.lpad("county_code", 3, "0"), F.lpad("site_number", 4, "0"))
    return rows.select(key.alias("entity_id"), F.to_date("date_local").alias("date"), F.coalesce(F.col("arithmetic_mean"), F.col("sample_measurement")).cast("double").alias("value"), "parameter")


def weather(rows: DataFrame) -> DataFrame:
    """Daily summaries in tenths; a missing measure counts as 0."""
    tenth = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) / 10
    return rows.select(F.col("station").alias("entity_id"), F.to_date("date").alias("date"), *(tenth(c).alias(c) for c in ("temp", "max", "min", "prcp", "wdsp")))


def open_records(rows: DataFrame, created: str, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Service requests or incidents: the day of creation is its first ten letters; order, condition and limit are pushed."""
    x = rows if where is None else rows.where(where)
    x = x.withColumn("date", F.to_date(F.substring(created, 1, 10)))
    return x if limit is None else x.orderBy(F.desc(created)).limit(limit)


def positive_only(rows: DataFrame) -> DataFrame:
    return rows.where("value > 0")


def reproducible_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that depend on the key and the seed alone."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


class SavedPayloads(DataSource):
    """``spark.read.format("payloads").option("path", ...)``: (name, json) of saved responses, one task per file."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "name string, json string"

    def reader(self, schema) -> DataSourceReader:
        return _PayloadReader(self.options["path"])


class _PayloadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileSystem

        fs, base = FileSystem.from_uri(self.path)
        return [InputPartition(f.path) for f in sorted(fs.get_file_info(FileSelector(base)), key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.value) as f:
            yield partition.value.rsplit("/", 1)[-1].removesuffix(".json"), f.read().decode()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedPayloads)
