"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed rows, one for the whole word and one for each of its character n-grams within
its bounds, so that new forms and compounds of a known stem are met. Filters of several widths slide over the
embeddings, each filter's MOST largest values over the text (k-max pooling) feed a logistic output, and a threshold for each language is taken
from rows that weren't trained on.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import bounded_sample, in_order, release, sampled, tidied

ROWS, DIM, FILTERS, WIDTHS = 1 << 20, 8, 12, (1, 2, 3)
NGRAMS = (3, 4, 5, 6)  # lengths, with the signs for a word's start and end
SHARE = 0.25  # of the sum of a word's rows
PAD = max(WIDTHS) - 1
MOST = 3  # values of a filter that are pooled: its largest ones in the text, PAD + 1 at most
RARE = 3
DEVIATIONS = 2.0  # by which a row's log-odds are drawn towards 0
WORD = re.compile(r"\w+")
CACHE_WORDS = 300_000
WORDS_AT_ONCE = 1 << 16
WORDS_HASHED = 1 << 14
MARGIN = 0.25  # where between the logits on either side of the best split a threshold lies
#: Frequent function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as on be at by this are from",
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au avec par",
    "de": "der die und das den von mit ist des im dem nicht ein eine als auch auf für sich zu",
    "es": "el los las y que del se por con una para su al lo como más pero sus no",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_LANGUAGE_OF: dict[str, int] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values(), 1):
    for _w in _words.split():
        # a word of several languages tells nothing
        _LANGUAGE_OF[_w] = 0 if _w in _LANGUAGE_OF else _k

def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): rows of the embedding table for all words, (characters, lengths of n-grams and the whole word).

    A word has a line for each of its characters and for the signs < and > around it, from ``starts`` on. Row 0 is the
    empty row; it stands where an n-gram would go beyond the word.
    """
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    rows = np.zeros((int(sizes.sum()), len(NGRAMS) + 1), np.int32)
    for lo in range(0, len(words), WORDS_HASHED):  # in parts, as hashes and their steps take many times the rows
        part = _hashed(words[lo : lo + WORDS_HASHED])
        rows[starts[lo] : starts[lo] + len(part)] = part
    return rows, starts


def _hashed(words: list[str]) -> np.ndarray:
    """The lines of some words one after another, see ``subwords``."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters to the word's end
    rows = np.zeros((len(codes), len(NGRAMS) + 1), np.int32)
    mixed = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(ROWS - 1) + np.uint64(1)
    base = np.uint64(0x100000001B3)
    for k, n in enumerate(NGRAMS):
        h = np.full(len(codes), n, np.uint64)
        for j in range(n):
            h = h * base + np.concatenate([codes[j:], np.zeros(min(j, len(codes)), np.uint64)])
        rows[:, k] = np.where(left >= n, mixed(h), 0)
    power = np.cumprod(np.full(int(sizes.max()), base))
    whole = np.add.reduceat(codes * power[np.arange(len(codes)) - np.repeat(starts, sizes)], starts)
    rows[starts, -1] = mixed(whole)
    return rows


class Vocabulary(dict):
    """Numbers of words in order of arrival. Number 0 is the empty word, which pads texts and has no rows."""

    def __init__(self):
        self[""] = 0
        self.language = array("b", [0])
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        self.language.append(_LANGUAGE_OF.get(word, 0))
        return n

    def taken(self) -> list[str]:
        """The words that came since the last call."""
        fresh, self.fresh = self.fresh, []
        return fresh


def encode(texts: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' words one after another; where each text starts; each text's language.

    Every text ends with PAD empty words, and one without words has one empty word.
    """
    found: list[str] = []
    starts = []
    for text in texts:
        starts.append(len(found))
        found += WORD.findall(text.lower()) or [""]
        found += [""] * PAD
    numbers, at = np.fromiter(map(words.__getitem__, found), np.int32, len(found)), np.array(starts, np.int64)
    if not len(at):
        return numbers, at, at
    speaks = np.frombuffer(words.language, np.int8)[numbers]
    told = np.stack([np.add.reduceat((speaks == k).astype(np.int32), at) for k in range(1, len(LANGUAGES))], axis=1)
    return numbers, at, np.where(told.max(axis=1) > 0, told.argmax(axis=1) + 1, 0)


class ConvNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = np.empty((ROWS, DIM), np.float32)
        for lo in range(0, ROWS, WORDS_AT_ONCE):  # in parts, as doubles take twice the table
            part = self.table[lo : lo + WORDS_AT_ONCE]
            part[:] = r.standard_normal(part.shape) * 0.05
        self.known = np.zeros(ROWS, bool)
        self.place: np.ndarray | None = None
        self.filters = {w: (r.standard_normal((w * DIM, FILTERS)) * 0.3 / w).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[::DIM] += 0.4 / len(f[::DIM])  # the first entry of an embedding starts as evidence for the label
        self.shift = {w: np.full(FILTERS, 0.0, np.float32) for w in WIDTHS}
        self.out = np.full(FILTERS * MOST * len(WIDTHS), 0.05, np.float32)
        self.bias = np.float32(-2)
        self.thresholds = np.zeros(len(LANGUAGES))

    def start_from(self, texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, lines: np.ndarray) -> None:
        """First entry of each embedding: the log-odds of the label in texts with the row, less DEVIATIONS of their error.

        Rows that fewer than RARE texts have stay empty, so that no text is learnt by heart.
        """
        seen = [np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float32)]
        for t, y in zip(texts, labels):
            seen[int(y)][np.unique(rows[_lines_of(np.unique(t), lines)])] += 1
        n1, n0 = max(labels.sum(), 1), max((1 - labels).sum(), 1)
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        error = DEVIATIONS * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
        self.table[:, 0] = np.clip(np.sign(odds) * np.maximum(np.abs(odds) - error, 0), -3, 6)
        self.known = seen[0] + seen[1] >= RARE
        self.known[0] = False
        self.table[~self.known] = 0

    def compact(self) -> ConvNet:
        """The same net for scoring alone, with a table of the rows that aren't empty and each row's place there."""
        out, full = copy(self), np.flatnonzero(self.table.any(axis=1))
        out.table, out.known, out.place = np.zeros((len(full) + 1, DIM), np.float32), None, np.zeros(ROWS, np.int32)
        out.table[1:], out.place[full] = self.table[full], np.arange(1, len(full) + 1)
        return out

    def _rows(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows if self.place is None else self.place[rows]]

    def embedded(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Embeddings of words of which ``subwords`` gave rows and starts."""
        out = np.zeros((len(starts), DIM), np.float32)
        for lo in range(0, len(starts), WORDS_HASHED):
            hi = min(lo + WORDS_HASHED, len(starts))
            first, last = starts[lo], starts[hi] if hi < len(starts) else len(rows)
            lines = self._rows(rows[first:last, 0])
            for k in range(1, rows.shape[1]):
                lines += self._rows(rows[first:last, k])
            out[lo:hi] = np.add.reduceat(lines, starts[lo:hi] - first)
        return out * np.float32(SHARE)

    def _pooled(self, x: np.ndarray, starts: np.ndarray):
        n = len(x)
        pad = np.zeros(n, bool)
        ends = np.append(starts[1:], n)
        for k in range(1, PAD + 1):
            pad[ends - k] = True
        padded = np.concatenate([x, np.zeros((PAD, DIM), np.float32)])
        for w in WIDTHS:
            windows = np.lib.stride_tricks.sliding_window_view(padded.reshape(-1), w * DIM)[: n * DIM : DIM]
            y = windows @ self.filters[w] + self.shift[w]
            y[pad] = -np.inf
            yield w, padded, y, np.stack([np.sort(np.partition(y[s:e], -MOST, axis=0)[-MOST:], axis=0)[::-1].reshape(-1) for s, e in zip(starts, ends)])

    def logits(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts that start at ``starts`` in ``x``, the embeddings of their words."""
        if not len(starts):
            return np.zeros(0)
        pooled = np.concatenate([np.maximum(top, 0) for *_, top in self._pooled(x, starts)], axis=1)
        return (pooled @ self.out + self.bias).astype(np.float64)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, lines: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.05, seed: int = 11) -> None:
        """Back-propagation through the pooled values with Adagrad; labels are weighted to equal halves."""
        r = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).clip(0, 10)
        speed = {"table": np.full(ROWS, 0.1, np.float32), "out": np.full(self.out.shape, 0.1, np.float32), "bias": np.float32(0.1)}
        speed |= {("f", w): np.full(self.filters[w].shape, 0.1, np.float32) for w in WIDTHS} | {("s", w): np.full(FILTERS, 0.1, np.float32) for w in WIDTHS}

        def step(key, value, grad):
            speed[key] += grad * grad
            value -= rate * grad / np.sqrt(speed[key])

        for _ in range(epochs):
            order = r.permutation(len(labels))
            for k in range(0, len(order), batch):
                ids = order[k : k + batch]
                words = np.concatenate([texts[i] for i in ids])
                starts = np.cumsum([0] + [len(texts[i]) for i in ids[:-1]])
                own, place = np.unique(words, return_inverse=True)
                spans, begins = _lines_of(own, lines), np.cumsum(lines[own + 1] - lines[own]) - (lines[own + 1] - lines[own])
                x = np.zeros((len(own), DIM), np.float32)
                full = np.flatnonzero(lines[own + 1] > lines[own])  # all but the empty word
                x[full] = self.embedded(rows[spans], begins[full])
                parts = list(self._pooled(x[place], starts))
                pooled = np.concatenate([np.maximum(top, 0) for *_, top in parts], axis=1)
                z = pooled @ self.out + self.bias
                err = ((1 / (1 + np.exp(-z.clip(-30, 30))) - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
                back = err[:, None] * self.out * (pooled > 0)
                ends = np.append(starts[1:], len(words))
                moved = np.zeros((len(own), DIM), np.float32)
                for j, (w, padded, y, _top) in enumerate(parts):
                    g = back[:, j * FILTERS * MOST : (j + 1) * FILTERS * MOST]
                    at = np.stack([_largest(y[s:e]).reshape(-1) + s for s, e in zip(starts, ends)])
                    flat = padded.reshape(-1)
                    window = flat[(at * DIM)[:, :, None] + np.arange(w * DIM)]
                    towards = (g[:, :, None] * np.tile(self.filters[w].T, (MOST, 1))).reshape(-1, w, DIM)
                    live = np.flatnonzero(g.reshape(-1))
                    for o in range(w):
                        pos = at.reshape(-1)[live] + o
                        ok = pos < len(words)
                        np.add.at(moved, place[pos[ok]], towards[live[ok], o])
                    step(("f", w), self.filters[w], np.einsum("bf,bfd->df", g, window).reshape(-1, MOST, FILTERS).sum(axis=1))
                    step(("s", w), self.shift[w], g.sum(axis=0).reshape(MOST, FILTERS).sum(axis=0))
                step("out", self.out, pooled.T @ err)
                speed["bias"] += err.sum() ** 2
                self.bias -= np.float32(rate * err.sum() / np.sqrt(speed["bias"]))
                full = np.flatnonzero(moved.any(axis=1))
                if not len(full):
                    continue
                touched = rows[_lines_of(own[full], lines)]
                sizes = (lines[own[full] + 1] - lines[own[full]]) * touched.shape[1]
                where, inverse = np.unique(touched.reshape(-1), return_inverse=True)
                of = np.repeat(np.arange(len(full)), sizes)
                grad = np.stack([np.bincount(inverse, moved[full, d][of], len(where)) for d in range(DIM)], axis=1).astype(np.float32) * np.float32(SHARE)
                grad[~self.known[where]] = 0
                speed["table"][where] += (grad**2).sum(axis=1)
                self.table[where] -= rate * grad / np.sqrt(speed["table"][where])[:, None]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, language: np.ndarray, least: int = 8) -> None:
        """For each language the logit that splits the labels best (F1).

        With fewer than ``least`` rows of a label it is all languages' one, but where the language has ``least`` rows
        without the label: then no further than MARGIN of the way from the largest of their logits to that one.
        """
        overall = _best_split(logits, labels)
        for k in range(len(LANGUAGES)):
            own = language == k
            yes, no = logits[own & (labels == 1)], logits[own & (labels == 0)]
            if min(len(yes), len(no)) >= least:
                self.thresholds[k] = _best_split(logits[own], labels[own])
            else:
                self.thresholds[k] = min(overall, no.max() + (overall - no.max()) * MARGIN) if len(no) >= least else overall

    def scores(self, x: np.ndarray, starts: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = self.logits(x, starts) - self.thresholds[language]
        return 1 / (1 + np.exp(-z.clip(-50, 50)))


def _largest(y: np.ndarray) -> np.ndarray:
    """Rows of the MOST largest values of each column, largest first."""
    at = np.argpartition(y, -MOST, axis=0)[-MOST:]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(y, at, axis=0), axis=0, kind="stable"), axis=0)


def _lines_of(words: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Places in ``rows`` of all lines of ``words``, whose own are from lines[word] to lines[word + 1]."""
    sizes = lines[words + 1] - lines[words]
    return np.repeat(lines[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _best_split(logits: np.ndarray, labels: np.ndarray) -> float:
    if not len(logits) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    z, hit = logits[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + labels.sum())
    f1[:-1][z[1:] == z[:-1]] = -1  # no split between ties
    k = int(np.argmax(f1))
    # nearer to the rows without the label: there are more of them, so that their largest logit is better known
    return float(z[k + 1] + (z[k] - z[k + 1]) * MARGIN) if k + 1 < len(z) else float(z[k] - 1)


def fit_toxicity(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 6000, max_bytes: int = 24 << 20) -> ConvNet:
    """Trains on ``max_docs`` labelled rows and ``max_bytes`` of text at most, all of it where there is less.

    Rows with a null label aren't used; null texts count as empty. Of the sample every fifth row (by
    id order) is kept from training for the thresholds. Without labels of both kinds the model
    answers below 0.5 everywhere.
    """
    usable = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(label_col).cast("int").alias("_label"))
    net, words = ConvNet(), Vocabulary()
    texts, kinds, languages = [], [], []
    for _, text, y in in_order(bounded_sample(usable, "_id", "_text", max_docs, max_bytes, "toxicity")):
        numbers, _, lang = encode([text], words)
        texts.append(numbers)
        kinds.append(int(y > 0))
        languages.append(int(lang[0]))
    labels, language = np.array(kinds, np.int64), np.array(languages, np.int64)
    if not len(labels) or labels.min() == labels.max():
        net.thresholds[:] = 60
        return net
    rows, starts = subwords(words.taken())
    del words  # texts are numbers from here on
    release()
    lines = np.concatenate([[0], starts, [len(rows)]])  # the empty word has none
    held = np.zeros(len(labels), bool)
    for y in (0, 1):  # a fifth of either label
        held[np.flatnonzero(labels == y)[4::5]] = True
    fit = np.flatnonzero(~held)
    net.start_from([texts[i] for i in fit], labels[fit], rows, lines)
    net.train([texts[i] for i in fit], labels[fit], rows, lines)
    check = np.flatnonzero(held) if 0 < labels[held].sum() < held.sum() else fit
    vectors = np.concatenate([np.zeros((1, DIM), np.float32), net.embedded(rows, starts)])
    logits = np.concatenate([net.logits(vectors[texts[i]], np.zeros(1, np.int64)) for i in check])
    net.calibrate(logits, labels[check], language[check])
    del texts, rows, vectors
    release()
    return net


def score_toxicity(df: DataFrame, net: ConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, language) for every row of ``df``; a text's score depends on the text alone.

    Null texts count as empty. Ids pass through, repeated rows stay, an empty table gives an empty
    result, further columns are not read. Whole texts are scored; groups of texts are formed by size,
    so memory is bounded by an Arrow batch and the longest text.
    """
    shared = df.sparkSession.sparkContext.broadcast(net.compact())  # ROWS places and the rows that training filled, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, words, vectors = shared.value, Vocabulary(), np.zeros((1, DIM), np.float32)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["_text"]]
            group = np.cumsum([len(t) // 5 + 8 for t in texts]) // WORDS_AT_ONCE
            score, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for k in np.unique(group):
                own = np.flatnonzero(group == k)
                if len(words) > CACHE_WORDS:
                    words, vectors = Vocabulary(), vectors[:1]
                numbers, starts, lang = encode([texts[i] for i in own], words)
                vectors = np.concatenate([vectors, model.embedded(*subwords(words.taken()))])
                score[own], language[own] = model.scores(vectors[numbers], starts, lang), lang
            yield pd.DataFrame({id_col: batch["_id"].array, "score": score, "predicted": (score >= 0.5).astype(np.int32), "language": [LANGUAGES[k] for k in language]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(tidied(run, release), f"`{id_col}` {kind}, score double, predicted int, language string")


def with_labels(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 6000) -> DataFrame:
    """(id, text, label) of about ``max_docs`` documents that ``labels`` has, chosen by a hash of the id.

    Of several labels for one id the largest counts. The labels are drawn first, so that those broadcast
    are bounded by ``max_docs`` and the texts need no shuffle.
    """
    one = labels.groupBy(id_col).agg(F.max(label_col).alias(label_col)).where(F.col(label_col).isNotNull())
    drawn = one.where(sampled(id_col, min(1.0, max_docs / max(one.count(), 1)), "labels"))
    return docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)
