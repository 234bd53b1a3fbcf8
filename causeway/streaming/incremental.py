"""A two-way fixed-effects estimate kept up to date from a stream, batch by batch.

The estimate needs sums over entities only, and a batch changes the sums of the entities it has rows of. So a batch
writes its cells (sums by entity and period), works out what its entities added to the totals before and add now, and
writes the new totals. Rows may come late and in any order: a cell is never closed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.stats import solve
from causeway.sources.sinks import exists

CELLS = "batch long, e {}, t long, n long, s double"
TOTALS = "kind string, a long, b long, v double"


def sums(panel: DataFrame) -> DataFrame:
    """(kind, a, b, v) of a panel (e, t, y, d), one row a cell: sums over entities of products less the entity's means.

    Kinds: n rows, e entities, dd, dy and yy, dt and yt with a period, tt with two. Added up, those of disjoint sets of
    entities are those of all.
    """
    own = panel.groupBy("e").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("d").alias("sd"), F.sum("y").alias("sy"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("y")).alias("dy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.collect_list(F.struct("t", "y", "d")).alias("at"))
    none = F.lit(0).cast("long")
    one = lambda kind, v, a=none, b=none: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), v.alias("v"))
    n, sd, sy = F.col("n"), F.col("sd"), F.col("sy")
    whole = F.array(one("n", n), one("e", F.lit(1.0)), one("dd", F.col("dd") - sd * sd / n), one("dy", F.col("dy") - sd * sy / n), one("yy", F.col("yy") - sy * sy / n))
    each = F.flatten(F.transform("at", lambda x: F.array(one("dt", x["d"] - sd / n, x["t"]), one("yt", x["y"] - sy / n, x["t"]))))
    pairs = F.flatten(F.transform("at", lambda x: F.transform(F.filter("at", lambda z: z["t"] >= x["t"]), lambda z: one("tt", F.when(z["t"] == x["t"], 1 - 1 / n).otherwise(-1 / n), x["t"], z["t"]))))
    return own.select(F.explode(F.concat(whole, each, pairs)).alias("r")).groupBy("r.kind", "r.a", "r.b").agg(F.sum("r.v").alias("v"))


class IncrementalDid:
    """``treated`` is a condition on e, ``post`` one on t; state lies under ``folder``, which all executors reach.

    A batch that comes again (same number) overwrites what it wrote, from the totals of the batch before it, so the
    result is that of coming once. Batches are numbered upwards, as Structured Streaming does.
    """

    def __init__(self, spark: SparkSession, folder: str, treated: Column, post: Column, kind: str = "long"):
        self.spark, self.folder, self.treated, self.post, self.kind = spark, folder, treated, post, kind

    def _before(self, name: str, schema: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}"
        there = self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)
        return there.where(F.col("batch") < batch)

    def _panel(self, cells: DataFrame) -> DataFrame:
        mean = cells.groupBy("e", "t").agg((F.sum("s") / F.sum("n")).alias("y"))
        return mean.select("e", "t", "y", (self.treated & self.post).cast("double").alias("d"))

    def update(self, rows: DataFrame, batch: int) -> None:
        """Takes up rows (e, t, y); those with a null in any of them are left out."""
        cells = rows.dropna(subset=["e", "t", "y"]).groupBy("e", F.col("t").cast("long").alias("t")).agg(F.count("y").alias("n"), F.sum(F.col("y").cast("double")).alias("s"))
        path = f"{self.folder}/cells/batch={batch}"
        cells.write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path)
        old = self._before("cells", CELLS.format(self.kind), batch).join(new.select("e").distinct(), "e", "left_semi").select("e", "t", "n", "s")
        gone = sums(self._panel(old)).select("kind", "a", "b", (-F.col("v")).alias("v"))
        come = sums(self._panel(old.unionByName(new.select("e", "t", "n", "s"))))
        totals = self._before("totals", f"batch long, {TOTALS}", batch)
        last = totals.agg(F.max("batch")).first()[0]
        kept = totals.where(F.col("batch") == F.lit(-1 if last is None else last)).select("kind", "a", "b", "v")
        summed = kept.unionByName(gone).unionByName(come).groupBy("kind", "a", "b").agg(F.sum("v").alias("v"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")  # a row a pair of periods

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes up all that is there of a stream of rows (e, t, y)."""
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.update).trigger(availableNow=True).start().awaitTermination()

    def estimate(self) -> DataFrame:
        """(coef, n, entities) from the newest totals; null before the first batch, or where treatment doesn't vary."""
        totals = self._before("totals", f"batch long, {TOTALS}", 1 << 62)
        last = totals.agg(F.max("batch")).first()[0]
        v = {(r["kind"], r["a"], r["b"]): r["v"] for r in totals.where(F.col("batch") == F.lit(-1 if last is None else last)).collect()}
        periods = sorted(a for kind, a, b in v if kind == "tt" and a == b)[1:]
        k = len(periods) + 1
        xx, xy = np.zeros((k, k)), np.zeros(k)
        xx[0, 0], xy[0] = v.get(("dd", 0, 0), 0.0), v.get(("dy", 0, 0), 0.0)
        for i, a in enumerate(periods, 1):
            xx[0, i] = xx[i, 0] = v.get(("dt", a, 0), 0.0)
            xy[i] = v.get(("yt", a, 0), 0.0)
            for j, b in enumerate(periods[i - 1 :], i):
                xx[i, j] = xx[j, i] = v.get(("tt", a, b), 0.0)
        coef = float(solve(xx, xy)[0]) if xx[0, 0] > 1e-12 else None
        return self.spark.createDataFrame([(coef, round(v.get(("n", 0, 0), 0)), round(v.get(("e", 0, 0), 0)))], "coef double, n long, entities long")
