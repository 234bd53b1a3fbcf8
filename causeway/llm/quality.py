"""Quality: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or abstain on every document. The votes are counted by pattern
(3^labellers at most), expectation-maximisation over the counts estimates each labeller's accuracy and
a posterior for each pattern, and the posteriors train a logistic scorer on hashed features.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import bounded_sample, in_order, release, tidied
from causeway.llm.toxicity import FUNCTION_WORDS

BINS = 1 << 14
MOST_WORDS = 200_000  # that a cache holds
FUNCTION_SET = frozenset(" ".join(FUNCTION_WORDS.values()).split())

#: Kinds of characters that are counted; ends of sentences are MARK and SHOUT.
ODD, UPPER, LOWER, SHOUT, MARK, SPACE, FAR_SPACE = range(1, 8)
KINDS = 8
BLANKS = " \t\n\v\f\r"
_BMP = 1 << 16


def _kind(c: str) -> int:
    for kind, those in ((ODD, "#$%&*|~^=<>{}[]_\\@+"), (SHOUT, "!"), (MARK, ".?:;"), (SPACE, BLANKS)):
        if c in those:
            return kind
    return FAR_SPACE if c.isspace() else {"Lu": UPPER, "Ll": LOWER}.get(unicodedata.category(c), 0)


@cache
def _kinds() -> np.ndarray:
    """The kinds of the characters of the first plane, made once a process."""
    return np.array([_kind(chr(k)) for k in range(_BMP)], np.uint8)


def _counted(text: str) -> np.ndarray:
    """How many characters of each kind the text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = codes >= _BMP
    if not far.any():
        return np.bincount(_kinds()[codes], minlength=KINDS)
    return np.bincount(np.append(_kinds()[codes[~far]], [_kind(chr(c)) for c in codes[far]]), minlength=KINDS)


_CLOSING = frozenset(".,;:?!)\"")
_INK = re.compile(r"\S+", re.ASCII)
_traits: dict[str, tuple[int, int]] = {}


def _plain(c: str) -> bool:
    return c in "'’(\"-" or unicodedata.category(c)[0] in "LN"


def _trait(word: str) -> tuple[int, int]:
    """The function words in a word, and 1 if it is letters, digits, quotes and hyphens with one closing mark at most."""
    found = _traits.get(word)
    if found is None:
        if len(_traits) > MOST_WORDS:
            _traits.clear()
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in word.lower()).split()
        body = word[:-1] if len(word) > 1 and word[-1] in _CLOSING else word
        found = _traits[word] = sum(w in FUNCTION_SET for w in letters), int(all(map(_plain, body)))
    return found


def _common_and_plain(words: list[str]) -> tuple[int, int]:
    """Sums of the words' traits. Most words are letters, with or without a closing mark, and tell theirs at once."""
    others = [w for w in words if not w.isalpha()]
    common, plain = sum(map(FUNCTION_SET.__contains__, map(str.lower, words))), len(words) - len(others)
    for w in others:
        if w[-1] in _CLOSING and w[:-1].isalpha():
            common, plain = common + (w[:-1].lower() in FUNCTION_SET), plain + 1
        else:
            c, p = _trait(w)
            common, plain = common + c, plain + p
    return common, plain


def measures(texts: list[str]) -> dict[str, np.ndarray]:
    """What the heuristics look at, an entry a text: its characters and words (1 at least), shares of the characters or a number a word.

    Words lie between ASCII blanks. Blanks other than spaces at either end of a text count as an empty word there.
    """
    kinds, sizes = np.zeros((len(texts), KINDS)), np.zeros((len(texts), 6))
    for k, text in enumerate(texts):
        kinds[k] = _counted(text)
        words = _INK.findall(text) if kinds[k, FAR_SPACE] else text.split()
        inner = text.strip(" ")
        empty = (inner[0] in BLANKS) + (inner[-1] in BLANKS) if inner else 1
        # a capital dotted I becomes two characters, of which one is no letter
        common, plain = _common_and_plain(words) if "\u0130" not in text else map(sum, zip(*map(_trait, words)))
        sizes[k] = len(text), len(words) + empty, common, plain, sum(map(eq, words, words[1:])), len(set(words)) + (empty > 0)
    n, words = np.maximum(sizes[:, 0], 1), np.maximum(sizes[:, 1], 1)
    return {
        "n": n, "words": words, "odd": kinds[:, ODD] / n, "upper": kinds[:, UPPER] / n, "lower": kinds[:, LOWER] / n, "bare": kinds[:, SPACE] / n,
        "shouts": kinds[:, SHOUT] / words, "ends": (kinds[:, MARK] + kinds[:, SHOUT]) / words,
        "common": sizes[:, 2] / words, "plain": sizes[:, 3] / words, "again": sizes[:, 4] / words, "variety": sizes[:, 5] / words,
    }


def labellers(m: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The heuristics: where each calls texts of these ``measures`` bad, and where, if not bad, good.

    Each looks at one trait; their limits leave room between good and bad for abstaining.
    """
    n, words, cased = m["n"], m["words"], m["upper"] + m["lower"]
    return {
        "odd_marks": (m["odd"] > 0.06, m["odd"] < 0.01),
        "capitals": (m["upper"] > 0.4 * cased + 0.02, m["upper"] < 0.12 * cased + 0.01),
        "shouting": (m["shouts"] > 0.25, m["shouts"] < 0.02),
        "function_words": ((m["common"] < 0.06) & (words >= 30), m["common"] > 0.15),
        "sentence_ends": ((m["ends"] < 0.01) & (words >= 40), (m["ends"] > 0.02) & (m["ends"] < 0.5)),
        "plain_words": (m["plain"] < 0.6, m["plain"] > 0.85),
        "repetition": (m["again"] > 0.2, m["again"] < 0.03),
        "variety": ((m["variety"] < 0.05) | ((m["variety"] < 0.3) & (words >= 20) & (words <= 1500)), m["variety"] > 0.4),
        "spacing": ((m["bare"] > 0.35) | ((m["bare"] < 0.05) & (n > 200)), (m["bare"] >= 0.1) & (m["bare"] <= 0.25)),
    }


def patterns_of(texts: list[str]) -> list[str]:
    """Each text's votes as one string, a character per labeller: 1 good, 0 bad, - abstains."""
    cast = [np.where(bad, "0", np.where(good, "1", "-")) for bad, good in labellers(measures(texts)).values()]
    return ["".join(v) for v in zip(*cast)]


def votes(text: Column) -> Column:
    """The votes on each text as ``patterns_of`` gives them, in one pass over it. Null texts count as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(patterns_of([t if isinstance(t, str) else "" for t in batch]), dtype=object)

    told = tidied(run, clear_cache)

    @F.pandas_udf("string")
    def pattern(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from told(batches)

    return pattern(text)


@dataclass
class LabelModel:
    """``rates``: (labellers, 2): how often a labeller that votes calls a bad, and a good, text good."""

    share_good: float
    rates: np.ndarray
    #: how often each labeller is right where it votes
    accuracy: list[float]

    def of(self, pattern: str) -> float:
        """Posterior probability of good. An abstention tells nothing."""
        return float(_posterior(np.array([["01-".index(c) for c in pattern]]), self.rates, self.share_good)[0])


def _posterior(v: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    odds = np.where(v == 1, np.log(rates[:, 1] / rates[:, 0]), np.where(v == 0, np.log((1 - rates[:, 1]) / (1 - rates[:, 0])), 0))
    return 1 / (1 + np.exp(-np.clip(odds.sum(axis=1) + np.log(share / (1 - share)), -50, 50)))


def fit_label_model(patterns: dict[str, int], rounds: int = 60, false_alarms: float = 0.01, prior_weight: float = 0.2) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from the share of bad votes in a pattern. Each labeller's rate of calling good texts bad
    has a prior of mean ``false_alarms`` that weighs ``prior_weight`` x its votes, which fixes which of
    the two classes is the good one; how many bad texts it misses is free.
    """
    names = sorted(patterns)
    k = len(names[0]) if names else 0
    if not names:
        return LabelModel(0.5, np.full((0, 2), 0.5), [])
    v = np.array([["01-".index(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    q = 1 - np.minimum((v == 0).sum(axis=1) / 2, 0.95)
    rates, share = np.full((k, 2), 0.5), 0.5
    for _ in range(rounds):
        share = float(np.clip((n * q).sum() / n.sum(), 0.01, 0.99))
        for j in range(k):
            cast, yes = v[:, j] != 2, v[:, j] == 1
            bad, good, prior = n * (1 - q), n * q, prior_weight * n[cast].sum() + 1
            rates[j, 0] = (bad[yes].sum() + 1) / (bad[cast].sum() + 2)
            rates[j, 1] = (good[yes].sum() + prior * (1 - false_alarms)) / (good[cast].sum() + prior)
        q = _posterior(v, rates, share)
    accuracy = []
    for j in range(k):
        cast, yes = v[:, j] != 2, v[:, j] == 1
        right = (n * q)[yes].sum() + (n * (1 - q))[cast & ~yes].sum()
        accuracy.append(float(right / n[cast].sum()) if cast.any() else 0.5)
    return LabelModel(share, rates, accuracy)


_SHAPE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_WORD = re.compile(r"\S+")
_SAME = 1  # bin of a word that repeats the one before
_shapes: dict[str, int] = {}


def clear_cache() -> None:
    """A function of the module, so that it empties the worker's own caches."""
    _shapes.clear()
    _traits.clear()


def _shape_bin(word: str) -> int:
    """Hash of a word's shape: letters by case, digits as one, marks as they are, each run once."""
    found = _shapes.get(word)
    if found is None:
        if len(_shapes) > MOST_WORDS:
            _shapes.clear()
        parts = []
        for run in _SHAPE.findall(word):
            if run[0].isalpha():
                parts.append("X" if run.isupper() and len(run) > 1 else "Xx" if run[0].isupper() else "x" + str(min(len(run) // 4, 4)))
            else:
                parts.append("9" if run[0].isdigit() else run[0] + ("+" if len(run) > 1 else ""))
        found = _shapes[word] = zlib.crc32("".join(parts).encode("utf-8", "surrogatepass")) % BINS
    return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and square roots of the shares of word shapes and of pairs of shapes that follow one another."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    s = np.array([_SAME if w == before else _shape_bin(w) for before, w in zip([None, *words], words)], np.int64)
    pairs = (s[:-1] * 31 + s[1:] * 17 + 7) % BINS
    bins, counts = np.unique(np.concatenate([s, pairs]), return_counts=True)
    return bins, np.sqrt(counts / len(s))


class HashedScorer:
    """Logistic regression on hashed features; trained by Adagrad towards the posterior labels."""

    def __init__(self):
        self.weights, self.bias = np.zeros(BINS), 0.0

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> None:
        r, speed, speed0 = np.random.default_rng(seed), np.full(BINS, 1e-2), 1e-2
        for _ in range(epochs):
            for i in r.permutation(len(rows)):
                bins, x = rows[i]
                err = self.score(bins, x) - targets[i]
                g = err * x + decay * self.weights[bins]
                speed[bins] += g * g
                self.weights[bins] -= rate * g / np.sqrt(speed[bins])
                speed0 += err * err
                self.bias -= rate * err / np.sqrt(speed0)

    def score(self, bins: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[bins] @ x + self.bias, -50, 50))))


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 6000, max_bytes: int = 48 << 20) -> tuple[HashedScorer, LabelModel]:
    """Fits the label model on the votes of all ``docs`` and the scorer on a sample of ``max_docs`` rows
    and ``max_bytes`` of text at most. No given label is used."""
    patterns = {r["v"]: r["count"] for r in docs.select(votes(F.col(text_col)).alias("v")).groupBy("v").count().collect()}
    model, scorer = fit_label_model(patterns), HashedScorer()
    usable = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sample = bounded_sample(usable, "_id", "_text", max_docs, max_bytes, "quality")
    rows, targets = [], []
    for _, text, v in in_order(sample.select("_id", "_text", votes(F.col("_text")).alias("v"))):
        rows.append(features(text))
        targets.append(model.of(v))
    if rows:
        scorer.train(rows, np.array(targets))
    del rows
    _shapes.clear()
    release()
    return scorer, model


def score_quality(df: DataFrame, scorer: HashedScorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, quality_score, good) for every row: good where the score is 0.5 or more.

    Null texts count as empty. Ids pass through, repeated rows stay, an empty table gives an empty
    result, further columns are not read; whole texts are scored.
    """
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            score = np.array([model.score(*features(t if isinstance(t, str) else "")) for t in batch["_text"]], float)
            yield pd.DataFrame({id_col: batch["_id"].array, "quality_score": score, "good": score >= 0.5})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(tidied(run, clear_cache), f"`{id_col}` {kind}, quality_score double, good boolean")
