"""License scans by an exact set-similarity join, in DataFrame functions only.

The templates are license notices and short phrases. For a template of m words a document's blocks are 2 m words long
and start at every m-th word, so that any m words that follow each other lie whole in one of them. A block meets a
template if it holds a given share of the template's distinct words.

Distinct words are ordered by the number of documents that have them, rarest first. Then a block that meets a template
has a word of the template's prefix (prefix filter), enough words that any template has (length filter), and enough of
those from its first common word on (positional filter). Words of no template are in no overlap and need no place in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
PERCENT = 80  # of a notice's distinct words that a block must hold


@dataclass(frozen=True)
class Template:
    """A phrase counts where its words follow each other; a notice counts where a block holds PERCENT of its words."""

    label: str
    words: tuple[str, ...]
    phrase: bool

    @property
    def need(self) -> int:
        n = len(set(self.words))
        return n if self.phrase else -(-n * PERCENT // 100)


def notice(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), False)


def phrase(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), True)


#: Lower-case words of notices that the licenses ask for. Labels of notices name a family where versions share most words.
TEMPLATES = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    notice("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    notice("gnu", "this work is licensed under the gnu general public license version 3"),
    notice("gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    notice("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    notice("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license"),
)

INDEX_SCHEMA = "token string, rank int, label string, phrase boolean, template array<string>, set_ranks array<int>, need int, length int, rarer array<string>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(1))


def _ordered(worded: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The templates' words by number of documents, rarest first; of equal ones in alphabetic order.

    What comes to the driver is a row for each word of the templates.
    """
    known = sorted({w for t in templates for w in t.words})
    own = F.array_distinct(F.filter("_words", lambda w: w.isin(known)))
    count = {r["w"]: r["n"] for r in worded.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def _index(df: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """A row for each template and word of its prefix: the words that a block can't all lack and still meet the template."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for t in templates:
        own = sorted({rank[w] for w in t.words})
        for p, r in enumerate(own[: len(own) - t.need + 1]):
            rows.append((order[r], r, t.label, t.phrase, list(t.words), own, t.need, len(t.words), [order[x] for x in own[:p]]))
    return df.sparkSession.createDataFrame(rows, INDEX_SCHEMA)


def matched_blocks(worded: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The join: ``worded`` has ``_words``; one row for each block and template that it meets, and one for each row that meets none.

    Columns: ``keep``, label, phrase, first (place of the block's first word, from 0), words (in the block), overlap,
    set_size, and places (starts of a phrase in the block's first half, so that no place is in two blocks).
    A block comes up once for a template: at the first place of the rarest of the template's words that it has.
    """
    order = _ordered(worded, templates)
    index = _index(worded, templates, order)  # as large as the templates, which are Python values
    vocabulary = F.lit(order)
    prefix = sorted({r["token"] for r in index.select("token").collect()})
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(prefix), F.struct(i.alias("pos"), w.alias("token")))), lambda s: s.isNotNull())
    # outer explodes keep the rows without a hit, and keep Spark from working out the expressions once more in a filter
    hit = worded.select(*keep, "_words", F.explode_outer(hits).alias("_hit")).select(*keep, "_words", F.col("_hit.pos").alias("_pos"), F.col("_hit.token").alias("token"))
    pairs = hit.join(F.broadcast(index), "token", "left")
    at = F.floor(F.col("_pos") / F.col("length")).cast("int")
    blocks = F.when(at > 0, F.array(at - 1, at)).otherwise(F.array(at))
    pairs = pairs.withColumn("_block", F.explode_outer(blocks)).withColumn("start", F.col("_block") * F.col("length"))
    pairs = pairs.withColumn("_in", F.slice("_words", F.col("start") + 1, 2 * F.col("length")))
    first = (F.array_position("_in", F.col("token")) == F.col("_pos") - F.col("start") + 1) & ~F.arrays_overlap("_in", "rarer")
    ranks = F.array_sort(F.transform(F.array_intersect("_in", vocabulary), lambda w: F.array_position(vocabulary, w).cast("int") - 1))
    pairs = pairs.withColumn("_ranks", F.when(first, ranks))
    known, q = F.size("_ranks"), F.array_position("_ranks", F.col("rank")).cast("int") - 1
    p = F.array_position("set_ranks", F.col("rank")).cast("int") - 1
    enough = (known >= F.col("need")) & (F.least(F.size("set_ranks") - p, known - q) >= F.col("need"))
    pairs = pairs.withColumn("overlap", F.when(enough, F.size(F.array_intersect("_ranks", "set_ranks"))))
    pairs = pairs.withColumn("_met", F.coalesce(F.col("overlap") >= F.col("need"), F.lit(False)))
    offsets = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda o: F.slice("_in", o + 1, F.col("length")) == F.col("template"))
    # made before the columns below take the names of those it reads
    pairs = pairs.withColumn("places", F.when(F.col("_met") & F.col("phrase"), F.transform(offsets, lambda o: (o + F.col("start")).cast("long"))))
    of = lambda c, name: F.when(F.col("_met"), c).alias(name)
    return pairs.select(
        *keep,
        of(F.col("label"), "label"),
        of(F.col("phrase"), "phrase"),
        of(F.col("start"), "first"),
        of(F.size("_in"), "words"),
        of(F.col("overlap"), "overlap"),
        of(F.size("set_ranks"), "set_size"),
        "places",
    )


def license_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, label, phrase, first, words, overlap, set_size, places) of every block that meets a template.

    Null and empty texts have no block; repeated rows have their blocks each; an empty table gives an empty result.
    """
    worded = df.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words"))
    return matched_blocks(worded, templates, ("_id",)).where("label is not null").withColumnRenamed("_id", id_col)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``df``.

    ``n_base`` counts the places of phrases; ``labels`` has the phrases' labels and those of the notices met. ``score``
    is 1 where a phrase stands, else the largest share of a notice's words in a block that meets it, else 0. Null texts
    count as empty and have no word; null or repeated ids don't join rows (a row's number in its partition tells them
    apart); ties of equal places in two phrases count twice. Texts aren't shuffled: blocks are found in the row that
    has the text, what is shuffled is a row of sums for each text.
    """
    worded = df.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words_of(F.col(text_col)).alias("_words"))
    worded = worded.select("_id", "_row", "_words", F.size("_words").cast("long").alias("n_words"))
    found = matched_blocks(worded, templates, ("_id", "_row", "n_words"))
    n = F.when(F.col("places").isNotNull(), F.size("places")).otherwise(0)
    of_phrase = F.col("phrase") & (n > 0)
    share = F.when(of_phrase, 1.0).when(~F.col("phrase"), F.col("overlap") / F.col("set_size"))
    summed = found.groupBy("_row", "_id", "n_words").agg(
        F.sum(n).cast("long").alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"),
        F.max(F.array_max("places")).alias("last_word"),
        F.collect_set(F.when(of_phrase, F.col("label"))).alias("_base"),
        F.collect_set(F.when(of_phrase | ~F.col("phrase"), F.col("label"))).alias("_all"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return summed.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined("_base").alias("base_labels"), joined("_all").alias("labels"), "score")
