"""Writing panels, results and their status."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, meta: dict[str, str] | None = None, force: bool = False) -> str:
    """Parquet with a small JSON table beside it; an existing table stays unless forced. Gives success or cached."""
    spark = df.sparkSession
    if not force and exists(spark, path):
        return "cached"
    df.write.mode("overwrite").parquet(path)
    rows = [(k, str(v)) for k, v in {"saved_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **(meta or {})}.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}.meta")
    return "success"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset on one machine, one temporary folder for all calls, removed at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        folder = tempfile.mkdtemp(prefix="causeway-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local.append(f"file://{folder}")
    return _local[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: what several plans read is worked out once, and a lost executor costs none of it."""
    path = f"{shared_dir(df.sparkSession)}/causeway/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def age_hours(spark: SparkSession, path: str) -> float | None:
    """Hours since the table was written; null if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return (time.time() * 1000 - fs.getFileStatus(p).getModificationTime()) / 3.6e6 if fs.exists(p) else None


def fresh(spark: SparkSession, path: str, max_age: float | None = None) -> bool:
    age = age_hours(spark, path)
    return age is not None and (max_age is None or age <= max_age)


def write_panel(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, csv or json by Spark; dta for panels that fit the driver."""
    if kind == "dta":
        df.toPandas().to_stata(path.removeprefix("file://"), write_index=False, version=118)
    else:
        getattr(df.write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))


def status_table(spark: SparkSession, results: dict[str, DataFrame | Exception | None]) -> DataFrame:
    """(variable, status, n): success, empty or error, by looking for a first row only."""
    rows = []
    for name, x in results.items():
        rows.append((name, "error" if isinstance(x, Exception) or x is None else "empty" if x.isEmpty() else "success", str(x) if isinstance(x, Exception) else None))
    return spark.createDataFrame(rows, "variable string, status string, detail string")


def retry(call: Callable, times: int = 3, base: float = 1.0, factor: float = 2.0, most: float = 30.0, wait: Callable[[float], None] = time.sleep):
    """Calls again after min(base x factor^k, most) seconds; the last error is raised."""
    for k in range(times + 1):
        try:
            return call()
        except Exception:
            if k == times:
                raise
            wait(min(base * factor**k, most))


def confidence_bands(effects: DataFrame) -> DataFrame:
    """What an event-study plot shows."""
    return effects.select("rel_time", "coef", (F.col("coef") - 1.96 * F.col("se")).alias("lo"), (F.col("coef") + 1.96 * F.col("se")).alias("hi"))


def _stored(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()["value"] if exists(spark, path) else None


def load_state(spark: SparkSession, path: str) -> dict:
    """The state of a pipeline's stages as written, or that of a new one."""
    text = _stored(spark, path)
    return json.loads(text) if text else {"pipeline": {"started": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "current_stage": 0, "completed_stages": []}, "stages": {}}


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """Writes the document through Hadoop's file system: first beside, then in place of the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state, ensure_ascii=False, indent=2, default=str).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def mark_stage_complete(spark: SparkSession, state: dict, stage: int, result: dict, path: str) -> dict:
    """The state with a stage's result, written as well; a stage done again replaces its result and counts once."""
    done = sorted({*state["pipeline"].get("completed_stages", []), stage})
    pipeline = {**state["pipeline"], "current_stage": stage, "completed_stages": done, "last_updated": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    new = {**state, "pipeline": pipeline, "stages": {**state["stages"], f"stage{stage}": result}}
    save_state(spark, new, path)
    return new
