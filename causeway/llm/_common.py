"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine (tests) is a temporary folder used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="causeway-"))
        atexit.register(_remove, spark, _local[0])
    return _local[0]


def _remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder through Hadoop's file system; a session that has ended already has nothing to do."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, deleted together by ``drop()`` once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_dir(spark, name), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Cuts the lineage: writes ``df`` as Parquet and reads it again."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        _remove(self.spark, self.root)


def id_crc(col: str) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def _unit(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 62))


def sampled(col: str, share: Column | float, seed: str) -> Column:
    """True for about ``share`` of the ids, the same ones on every run; for tables with one row for each id."""
    return _unit(F.col(col), F.lit(seed)) / F.lit(float(1 << 62)) < share


def drawn(share: Column | float, seed: str, *cols: str) -> Column:
    """True for about ``share`` of the rows, by a hash of the columns and the row's place in the table."""
    return _unit(*map(F.col, cols), F.monotonically_increasing_id(), F.lit(seed)) / F.lit(float(1 << 62)) < share


def bounded_sample(df: DataFrame, id_col: str, text_col: str, max_docs: int, max_bytes: int, seed: str) -> DataFrame:
    """All rows of ``df``, or where there are more than ``max_docs`` or ``max_bytes`` of text: rows drawn at random within both bounds.

    Rows are drawn by a hash of id, text and place in the table, so that rows without an id, or with equal
    ones, don't share one fate. About the wanted share of all rows come as (hash, bytes) to the driver,
    ``max_docs`` at most, and the least hashes that keep within both bounds are taken.
    """
    rows = df.withColumn("_draw", _unit(F.col(id_col), F.col(text_col), F.monotonically_increasing_id(), F.lit(seed)))
    bytes_ = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    n, size = df.agg(F.count(F.lit(1)), F.sum(bytes_)).first()
    if n <= max_docs and (size or 0) <= max_bytes:
        return df
    # a fifth more than expected and some, so that chance alone hardly leaves the bounds unused
    share = min(1.0, 1.2 * min(max_docs / n, max_bytes / max(size, 1)) + 50 / n)
    few = rows.where(F.col("_draw") < F.lit(int(share * (1 << 62)))).select("_draw", bytes_.alias("_bytes")).orderBy("_draw").limit(max_docs).collect()
    last, total = -1, 0
    for r in few:
        total += r["_bytes"]
        if total > max_bytes:
            break
        last = r["_draw"]
    return rows.where(F.col("_draw") <= F.lit(last)).drop("_draw")


def in_order(sample: DataFrame) -> Iterator[tuple]:
    """The rows of a bounded sample on the driver, in order of their columns (nulls last), made one at a time.

    They come as one Arrow table, which takes about the bytes of its texts, and not as a row object each.
    """
    rows = sample.toArrow()
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names])
    columns = rows.columns
    for k in order.to_pylist():
        yield tuple(c[k].as_py() for c in columns)


def tidied(run: Callable[[Iterator], Iterator], clear: Callable[[], object]) -> Callable[[Iterator], Iterator]:
    """``run`` with its caches cleared at the end of each task, and what is free given back to the system.

    Spark's Python workers live on from one stage to the next, so that caches of all stages would add up.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            clear()
            release()

    return wrapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
