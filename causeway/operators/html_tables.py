"""Statistical tables in HTML: rows of cells, multi-level headings, the value column, and units."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import parse_amount


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[str, int]]]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
            span = dict(attrs).get("colspan") or "1"
            self.span = int(span) if span.isdigit() else 1

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), self.span))
            self.cell = None


def table_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table, row, col, text, span): every cell of every table; pages without a table have no row."""

    def run(batches):
        for batch in batches:
            out = []
            for id_, html in batch.itertuples(index=False, name=None):
                if not isinstance(html, str) or "<table" not in html.lower():
                    continue
                p = _Tables()
                p.feed(html)
                for t, rows in enumerate(p.tables):
                    for r, cells in enumerate(rows):
                        at = 0
                        for text, span in cells:
                            out.append((id_, t, r, at, text, span))
                            at += span
            yield pd.DataFrame(out, columns=["_id", "table", "row", "col", "text", "span"])

    kind = pages.schema[id_col].dataType.simpleString()
    cells = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_h")).mapInPandas(run, f"_id {kind}, table int, row int, col int, text string, span int")
    return cells.withColumnRenamed("_id", id_col)


def statistical_values(cells: DataFrame, id_col: str, indicator: str, year: int) -> DataFrame:
    """(id, entity_id, year, value) from the table that names the indicator most often.

    Headings are the texts above a column. The value column is the first that names indicator and year,
    else the indicator, else the year, else the second. Rows without a positive number are left out,
    which drops titles, units and footnotes.
    """
    hit = F.col("text").contains(indicator)
    score = cells.groupBy(id_col, "table").agg(F.sum(hit.cast("int")).alias("s"), F.max("col").alias("width")).where("s > 0 and width > 0")
    best = score.groupBy(id_col).agg(F.max_by("table", F.struct("s", -F.col("table"))).alias("table"))
    mine = cells.join(best, [id_col, "table"])
    number = parse_amount(F.col("text"))
    data_from = mine.where((F.col("col") > 0) & number.isNotNull() & (F.col("text") != str(year))).groupBy(id_col).agg(F.min("row").alias("_first"))
    x = mine.join(data_from, id_col)
    spread = x.where("row < _first").withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("span") - 1)))
    heads = spread.where("span <= 1 or col > 0 or row > 0").groupBy(id_col, F.col("c").alias("col")).agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("head")).where("col > 0")
    i, y = F.col("head").contains(indicator), F.col("head").contains(str(year))
    rank = F.when(i & y, 0).when(i, 1).when(y, 2).otherwise(3)
    value_col = heads.groupBy(id_col).agg(F.min_by("col", F.struct(rank, "col")).alias("_v"))
    body = x.where("row >= _first").join(value_col, id_col)
    by_row = body.groupBy(id_col, "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("entity_id"), F.max(F.when(F.col("col") == F.col("_v"), number)).alias("value"))
    return by_row.where("value > 0 and entity_id is not null and entity_id <> ''").select(id_col, "entity_id", F.lit(year).alias("year"), "value")
