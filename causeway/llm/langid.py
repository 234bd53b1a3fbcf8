"""Language identification by multilingual mixtures: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm._common import drawn

BINS = 1 << 16
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters become spaces; all other bytes stay.
_TABLE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def trigram_bins(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-case text's UTF-8 bytes and their counts; runs of other characters count as one space."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    if len(codes) < 8192:
        bins, counts = np.unique(codes.astype(np.uint16), return_counts=True)
    else:
        every = np.bincount(codes, minlength=BINS)
        bins = np.flatnonzero(every)
        counts = every[bins]
    return bins.astype(np.int64), counts.astype(np.float64)


class LanguageModel:
    """Smoothed log-probabilities of trigram bins, (BINS, languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.05):
        self.languages = languages
        p = counts.T + smoothing
        self.probs = (p / p.sum(axis=0)).astype(np.float32) if languages else np.zeros((BINS, 0), np.float32)

    def mixture(self, text: str, rounds: int = 12, penalty: float = 1.0) -> dict[str, float]:
        """Language proportions of one text; {} without a letter or without a language.

        Expectation-maximisation gives the proportions over all languages. Then languages are dropped
        in order of their proportion, and the set with the best log-likelihood less ``penalty`` x
        (languages - 1) x log(trigrams) / 2 is kept. Ties go to the smaller set.
        """
        if not self.languages or not LETTER.search(text):
            return {}
        bins, counts = trigram_bins(text)
        p, total = self.probs[bins].astype(np.float64), counts.sum()

        def fit(p: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
            for _ in range(rounds):
                share = share * (p.T @ (counts / (p @ share))) / total
            return share, float(counts @ np.log(p @ share))

        k = p.shape[1]
        share, _ = fit(p, np.full(k, 1 / k), rounds)
        order = np.argsort(-share, kind="stable")
        best, best_value = order[:1], float(counts @ np.log(p[:, order[0]]))
        best_share = np.ones(1)
        for m in range(2, k + 1):
            kept = order[:m]
            s, value = fit(p[:, kept], share[kept] / share[kept].sum(), 4)
            value -= penalty * (m - 1) * np.log(max(total, 2.0)) / 2
            if value > best_value:
                best, best_share, best_value = kept, s, value
        return {self.languages[i]: float(x) for i, x in zip(best, best_share)}


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 6000) -> LanguageModel:
    """Learns from about ``max_docs`` rows with a language, shared evenly among the languages.

    Which rows is decided by a hash of id, text and place in the table, so that rows without an id, or with equal ones,
    don't share one fate. Rows without text or language are left out. Each task counts its rows' trigrams and the counts are summed by language and bin, so the driver
    gets BINS numbers for each language at most and a model takes 256 KB for each.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, BINS)))
    each = max(1, max_docs // len(sizes))
    shares = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["_lang"], batch["_text"]):
                bins, n = trigram_bins(text)
                found.setdefault(lang, np.zeros(BINS, np.int64))[bins] += n.astype(np.int64)
        for lang, every in found.items():
            bins = np.flatnonzero(every)
            yield pd.DataFrame({"_lang": lang, "bin": bins.astype(np.int32), "n": every[bins]})

    sample = rows.where(drawn(F.element_at(shares, F.col("_lang")), "langid", "_id", "_text"))
    parts = sample.mapInPandas(count, "_lang string, bin int, n long").groupBy("_lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BINS))
    at = {lang: k for k, lang in enumerate(languages)}
    counts[parts["_lang"].map(at).to_numpy(np.int64), parts["bin"].to_numpy(np.int64)] = parts["n"].to_numpy(float)
    return LanguageModel(languages, counts)


def predict_language(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages, shares) for every row of ``df``.

    ``lang_pred`` is the language with the largest share and ``score`` its share; ``und`` with score 0
    for null texts and texts without a letter. Ids pass through, repeated rows stay, an empty table
    gives an empty result, and only the two columns named are read.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BINS x languages numbers, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                found = m.mixture(text) if isinstance(text, str) else {}
                top = max(found, key=found.get) if found else "und"
                rows.append((top, min(1.0, found.get(top, 0.0)), list(found), list(found.values())))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "shares"])
            out.insert(0, id_col, batch["_id"].array)
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double, languages array<string>, shares array<double>"
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, schema)
