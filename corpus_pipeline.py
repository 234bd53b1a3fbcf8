"""From documents to packed training windows, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontam, minhash, packing, quality, toxicity
from causeway.llm._common import Scratch, materialise, table


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with further underscores if ``docs`` has such a column."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart by id and text, and the column's name.

    Rows without an id, and rows of one id with different texts, so have keys of their own; null and empty text count as one.
    """
    name, text = _free(docs, "_row_key"), F.coalesce("text", F.lit(""))
    return docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64(text), F.xxhash64(F.lit(1), text))), name


def _without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``docs`` but for rows whose ``key`` is in ``keys``. The written keys are broadcast if Spark's limit lets them."""
    gone = _free(docs, "_gone")
    keys = materialise(keys.select(F.col(key).alias(gone)).where(F.col(gone).isNotNull()).distinct(), "pipeline-keys")
    return docs.join(keys, F.col(key) == F.col(gone), "left_anti")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the toxicity classifier rejects (score of 0.5 or more); it learns from ``labels``.

    Every row is judged by its own text, whether or not it has an id or shares it. Null and empty texts are
    scored as empty. Without labels of both kinds nothing is dropped; an empty table stays empty.
    """
    net = toxicity.fit_toxicity(toxicity.with_labels(docs, table(spark, sf_dir, "labels"), "toxic"))
    keyed, key = _keyed(docs)
    return _without(keyed, toxicity.score_toxicity(keyed, net, id_col=key).where("predicted = 1"), key).drop(key)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects (score under 0.5).

    Every row is judged by its own text, whether or not it has an id or shares it; an empty table stays empty.
    """
    scorer, _ = quality.fit_quality(docs)
    keyed, key = _keyed(docs)
    return _without(keyed, quality.score_quality(keyed, scorer, id_col=key).where("not good"), key).drop(key)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Rows of one id are one document and stay or go together. Rows without an id are in no group and stay, as do texts without a word.
    """
    return _without(docs, minhash.near_duplicates(docs, k=5, percent=80).where("not kept"), "doc_id")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text overlaps with an item of the benchmark, whether or not they have an id or share it."""
    keyed, key = _keyed(docs)
    return _without(keyed, decontam.overlaps(keyed, table(spark, sf_dir, "benchmark"), id_col=key), key).drop(key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens, of every row. Null and empty texts have the closing id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("near duplicates", one_of_near_copies),
    ("decontamination", not_in_benchmark),
    ("packing", packed),
]

#: The classifiers and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder as Parquet and read again; then what it read is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch(spark, "pipeline")
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        before = scratch
    return docs
