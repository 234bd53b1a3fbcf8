"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words that a mask selects from a run of words; the words at its other places
may differ. Seeds of the benchmark are joined to those of the documents, and around every hit the two
texts are compared word by word: a document overlaps an item if a window of ``WINDOW`` aligned words
agrees in four fifths of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import materialise

WINDOW = 15
LEAST_WORDS = 1
SEGMENT = 4096  # words of a document that are handled together
BLOCK_SEEDS = 200_000  # benchmark seeds broadcast at once, of 0.5 KB at most
#: Masks by an item's number of words, the last ones for WINDOW words and more. However a fifth of the words, rounded
#: down, is substituted, one of the masks fits somewhere between them (a test goes through all patterns).
FAMILIES = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "10111", "11011", "11101"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("1111",),
    9: ("110111",),
    10: ("1111", "10111"),
    11: ("10111",),
    12: ("1111",),
    13: ("11001011",),
    14: ("101111",),
    WINDOW: ("110111", "110001011"),
}
_SPAN = max(len(m) for masks in FAMILIES.values() for m in masks)
#: Words before and after a seed's first word that a window around it can reach.
_BEFORE, _AFTER = WINDOW, WINDOW + _SPAN


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits in the lower-case text."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def _seeds(words: Column, first: Column, last: Column, masks: dict[str, Column]) -> Column:
    """(pos, seed) for every mask and start between ``first`` and ``last`` (from 0) at which the mask fits, where the mask's condition holds."""

    def of(mask: str) -> Column:
        picked = [k for k, c in enumerate(mask) if c == "1"]
        end = F.least(last, F.size(words) - len(mask))
        made = F.transform(F.sequence(first, end), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(mask), *(F.get(words, i + k) for k in picked)).alias("seed")))
        return F.when(masks[mask] & (end >= first), made).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))

    return F.concat(*map(of, masks))


def _benchmark_seeds(items: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """(seed, item_id, lead, near, window): ``near`` has the item's words around the seed, which starts at its place ``lead``.

    ``lengths`` has the keys of FAMILIES whose items a mask is for.
    """
    n = F.size("_words")
    masks = {m: F.least(n, F.lit(WINDOW)).isin(of) for m, of in lengths.items()}
    seeded = items.select("item_id", "_words", F.explode_outer(_seeds(F.col("_words"), F.lit(0), n, masks)).alias("s"))
    start = F.greatest(F.col("s.pos") - _BEFORE, F.lit(0))
    near = F.slice("_words", start + 1, F.col("s.pos") - start + _AFTER)
    return seeded.select(F.col("s.seed").alias("seed"), "item_id", (F.col("s.pos") - start).alias("lead"), near.alias("near"), F.least(n, F.lit(WINDOW)).alias("window"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, matched_words, window_words) for every document and item that overlap.

    ``matched_words`` is the most words that agree in an aligned window of ``window_words`` (15, or the
    item's words if fewer). Null and empty texts and items overlap with nothing. Items of under five words
    are met whole and exactly. Nothing is missed: an item's masks (FAMILIES) hit every window
    with four fifths of its words. Rows of equal ids count as one document or item (null ids as well). Empty tables give an empty result; further
    columns are not read. The benchmark is broadcast in blocks of about BLOCK_SEEDS seeds, so its size
    isn't limited; the documents are never shuffled.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("_words")).where(F.size("_words") >= LEAST_WORDS)
    items = materialise(items, "decontam-items")
    n = F.size("_words")
    found = {r["length"]: r["words"] for r in items.groupBy(F.least(n, F.lit(WINDOW)).alias("length")).agg(F.sum(n).alias("words")).collect()} or {WINDOW: 0}
    lengths = {m: [k for k in sorted(found) if m in FAMILIES[k]] for k in sorted(found) for m in FAMILIES[k]}
    blocks = max(1, -(-sum(words * len(FAMILIES[k]) for k, words in found.items()) // BLOCK_SEEDS))
    seeds = _benchmark_seeds(items, lengths)
    masks = {m: F.lit(True) for m in lengths}

    # outer explodes, and conditions on what they give: Spark would else copy the expressions below into filters of
    # their own and work them out once more for each word
    words = docs.select(F.col(id_col).alias("_id"), word_hashes(F.col(text_col)).alias("_all"))
    starts = F.when(F.size("_all") >= LEAST_WORDS, F.sequence(F.lit(0), F.size("_all") - 1, F.lit(SEGMENT)))
    parts = words.select("_id", "_all", F.explode_outer(starts).alias("_start")).where("_start is not null")
    begin = F.greatest(F.col("_start") - _BEFORE, F.lit(0))
    parts = parts.select("_id", (F.col("_start") - begin).alias("_first"), F.slice("_all", begin + 1, F.col("_start") - begin + SEGMENT + _AFTER).alias("_words"))
    parts = parts.select("_id", "_words", _seeds(F.col("_words"), F.col("_first"), F.col("_first") + SEGMENT - 1, masks).alias("_seeds"))
    hits = parts.select("_id", "_words", F.explode_outer("_seeds").alias("_s")).select("_id", "_words", F.col("_s.pos").alias("_pos"), F.col("_s.seed").alias("seed"))

    out = None
    for b in range(blocks):
        block = seeds if blocks == 1 else seeds.where(F.pmod(F.col("seed"), F.lit(blocks)) == b)
        # of a hit's document only the words beside the item's go on
        begin = F.col("_pos") - F.col("lead")
        near = hits.join(F.broadcast(block), "seed").select(
            "_id", "item_id", "near", "window", F.greatest(-begin, F.lit(0)).alias("_skip"), F.slice("_words", F.greatest(begin, F.lit(0)) + 1, F.size("near")).alias("_here")
        )
        aligned = F.transform(F.sequence(F.lit(0), F.size("near") - 1), lambda j: F.when((j >= F.col("_skip")) & (F.get("_here", j - F.col("_skip")) == F.get("near", j)), 1).otherwise(0))
        near = near.select("_id", "item_id", "window", aligned.alias("_same"))
        window = F.transform(F.sequence(F.lit(1), F.size("_same") - F.col("window") + 1), lambda i: F.aggregate(F.slice("_same", i, F.col("window")), F.lit(0), lambda x, y: x + y))
        near = near.select("_id", "item_id", "window", F.array_max(window).alias("matched"))
        passed = F.expr("5 * matched >= 4 * window")
        best = near.groupBy("_id", "item_id").agg(F.max(F.when(passed, F.col("matched"))).cast("long").alias("matched_words"), F.max(F.when(passed, F.col("window"))).cast("long").alias("window_words"))
        best = best.where("matched_words is not null")
        out = best if out is None else out.union(best)
    if blocks > 1:
        out = out.groupBy("_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("window_words").alias("window_words"))
    return out.withColumnRenamed("_id", id_col)
