"""Estimates kept batch by batch against the estimate from all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.plans import did
from causeway.spec import PanelSpec
from causeway.streaming import incremental, panel_stream


def _rows(seed, n):
    r = np.random.default_rng(seed)
    return [(int(r.integers(0, 12)) if i % 19 else None, int(r.integers(0, 5)), float(r.normal()) if i % 23 else None) for i in range(n)]


def _whole(spark, rows):
    panel = spark.createDataFrame(rows, "e long, t long, y double").dropna().groupBy("e", "t").agg(F.avg("y").alias("y"))
    panel = panel.withColumn("treated", (F.col("e") % 2 == 0).cast("double")).withColumn("post", (F.col("t") >= 3).cast("double"))
    r = did.twfe(panel, PanelSpec(entity="e", time="t", outcome="y"), clustered=False).first()
    return r["coef"], r["n"], r["entities"]


def test_batches_late_rows_and_repeats(spark, tmp_path):
    kept = incremental.IncrementalDid(spark, f"file://{tmp_path}/state", F.col("e") % 2 == 0, F.col("t") >= 3)
    assert tuple(kept.estimate().first()) == (None, 0, 0)
    batches = [_rows(1, 60), [x for x in _rows(2, 80) if x[1] < 3], _rows(3, 5), []]  # the second has earlier periods than the first
    seen = []
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "e long, t long, y double")
        kept.update(df, k)
        seen += batch
        got = kept.estimate().first()
        assert (got["coef"], got["n"], got["entities"]) == (pytest.approx(_whole(spark, seen)[0], abs=1e-9), *_whole(spark, seen)[1:])
        if k in (1, 2):  # a batch that failed after it wrote, and comes again
            kept.update(df, k)
            assert kept.estimate().first() == got


def test_finished_windows_are_kept_by_batch(spark, tmp_path):
    """The append path: windows that the watermark has passed, each batch in a folder of its own; run again, nothing is added."""
    rows = [(1, f"2024-01-{d:02d} 10:00:00", 1, "a", float(d), "x") for d in range(1, 10)]
    for k, part in enumerate((rows[:5], rows[5:])):
        df = spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    for _ in range(2):
        panel_stream.keep_panel(panel_stream.entity_windows(panel_stream.event_stream(spark, f"file://{tmp_path}")), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
        got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("start").collect()
        assert [(r["start"].day, r["n"], r["total"]) for r in got] == [(d, 1, float(d)) for d in range(1, len(got) + 1)] and 5 <= len(got) < 9
