"""Order-preserving packing of documents into token windows by dynamic programming.

Documents follow one another in table order. A window ends at a document's or a sentence's end; only a
sentence longer than a window is cut inside. The cuts that minimise padding plus a penalty for truncating
a document are found with a monotone queue over the places that a window of full size can start from.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import release, tidied

WINDOW = 1024
#: Penalties in tokens for a window that ends at: a document's end, a sentence's end, a place inside a sentence.
DOCUMENT_CUT, SENTENCE_CUT, INNER_CUT = 0, 2, 4
GRID = 16  # tokens between two possible cuts inside a sentence longer than a window
END = 0  # the id that ends each document
COMMIT = 1 << 18  # tokens between two looks for cuts that are certain; it doesn't change the plan
TEXT_AT_ONCE = 1 << 19  # characters that are encoded at once

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_TERMINATED, _CLOSES, _SPACED, _NEWLINE = 1, 2, 4, 8
_ENDS = re.compile("[.!?…。！？][\"'”’»)\\]]*$")
_CLOSERS = re.compile("[\"'”’»)\\]]+$")


class TextTokenizer:
    """Byte-level BPE of the vocabulary file, and where sentences end among the ids.

    Special tokens in a text have their own ids. What lies between them is encoded in parts of about
    TEXT_AT_ONCE characters, split before a single space between two characters that aren't white space:
    the vocabulary's pattern joins nothing over such a place, so the ids are those of the whole text.
    """

    def __init__(self, path: str):
        data = json.load(open(path, encoding="utf-8"))
        vocabulary = data["model"]["vocab"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        stored = {k: bytes(shown[c] for c in token) for token, k in vocabulary.items() if all(c in shown for c in token)}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.between = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.encoders = self._ranked(path, data["model"], stored)
        kinds = np.zeros(1 + max([*stored, *self.special.values()]), np.uint8)
        for k, raw in stored.items():
            s = raw.decode("utf-8", "ignore")
            kinds[k] = _TERMINATED * bool(_ENDS.search(s)) | _CLOSES * bool(_CLOSERS.match(s)) | _SPACED * s[:1].isspace() | _NEWLINE * ("\n" in s)
        self.kinds = kinds

    @staticmethod
    def _ranked(path: str, model: dict, stored: dict[int, bytes]) -> tuple[Callable[[str], list[int]], ...]:
        """The vocabulary for tiktoken, which is faster; merges must be in order of their ids for that.

        The first encoder takes any text. The second, faster again, has a pattern without the look at
        what follows white space, which matters only where white space is longer than a character.
        """
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            from tokenizers import Tokenizer

            full = Tokenizer.from_file(path)
            return (lambda text: full.encode(text, add_special_tokens=False).ids,) * 2
        import tiktoken

        ranks = {raw: k for k, raw in stored.items() if k < 256 + len(pairs)}
        word = r"'(?:[sdmt]|ll|ve|re)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)"
        return tuple(tiktoken.Encoding("plain", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (rf"{word}|\s+(?!\S)|\s+", rf"{word}|\s+"))

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            cut = _BETWEEN.search(text, at + TEXT_AT_ONCE) if len(text) - at > TEXT_AT_ONCE else None
            stop = cut.start() if cut else len(text)
            part = text[at:stop] if at or cut else text
            flat = part.replace("\n", " ")
            encode = self.encoders[flat.isprintable() and "  " not in flat]
            yield np.frombuffer(array("I", encode(part)), np.uint32)
            at = stop

    def ids(self, text: str) -> np.ndarray:
        found = self.between.finditer(text) if self.between else ()
        parts, at = [], 0
        for m in found:
            parts += [*self._plain(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        parts += self._plain(text[at:] if at else text)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])

    def cut_places(self, ids: np.ndarray, doc_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Places (numbers of ids before them) where a window may end, in order, and their penalties.

        ``ids`` are whole documents one after another, each closed by END, and ``doc_ends`` the places where
        they end. Sentences end after an id that holds a line's end, and after . ! ? or their like, with the
        marks that close a quotation or bracket, where white space follows. What is longer than a window
        has places every GRID ids inside.
        """
        kind = self.kinds[ids]
        kind[doc_ends - 1] = 0
        ended, closes = (kind & _TERMINATED) > 0, (kind & _CLOSES) > 0
        for _ in range(2):  # closing marks may be ids of their own
            ended[1:] |= closes[1:] & ended[:-1]
        ended[:-1] &= (kind[1:] & _SPACED) > 0
        ended |= (kind & _NEWLINE) > 0
        ended[np.maximum(doc_ends - 2, 0)] = False  # END stays with its document
        ended[doc_ends - 1] = True
        place = np.flatnonzero(ended) + 1
        penalty = np.full(len(place), SENTENCE_CUT)
        penalty[np.searchsorted(place, doc_ends)] = DOCUMENT_CUT
        gap = np.diff(place, prepend=0)
        long = np.flatnonzero(gap > window)
        if len(long):
            inner = np.concatenate([np.arange(p - g + GRID, p, GRID) for p, g in zip(place[long], gap[long])])
            place, penalty = np.concatenate([place, inner]), np.concatenate([penalty, np.full(len(inner), INNER_CUT)])
            order = np.argsort(place)
            place, penalty = place[order], penalty[order]
        return place, penalty


class Planner:
    """The cuts that minimise padding plus penalties, over places that arrive in order.

    best[j] = penalty[j] + window - place[j] + min(best[i] + place[i]) over places i at most ``window``
    before j; the minimum slides along, so a queue of rising values holds its candidates. Every later cut
    comes from one of the queue, so the last place that the best ways to all of them share is certain,
    and what lies before it is given out and forgotten.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.at, self.origin = array("q", [0]), array("q", [0])  # 16 bytes a place
        #: The queue: best + place, of which only differences matter, and numbers of places; it starts at ``head``.
        self.value, self.number, self.head = [0], [0], 0

    def add(self, places: list[int], penalties: list[int]) -> None:
        at, origin, value, number, head, window = self.at, self.origin, self.value, self.number, self.head, self.window
        j = len(at)
        for here, extra in zip(places, penalties):
            start = here - window
            while at[number[head]] < start:
                head += 1
            origin.append(number[head])
            at.append(here)
            new = extra + window + value[head]  # more than the head's, which so stays
            while value[-1] >= new:
                value.pop()
                number.pop()
            value.append(new)
            number.append(j)
            j += 1
        self.value, self.number, self.head = value[head:], number[head:], 0

    def _path(self, j: int) -> list[int]:
        cuts = []
        while j:
            cuts.append(self.at[j])
            j = self.origin[j]
        return cuts[::-1]

    def certain(self) -> list[int]:
        """New cuts on which all best ways agree, in order."""
        live = set(self.number)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.origin[last])
        (c,) = live
        cuts = self._path(c)
        if c:
            back = np.frombuffer(self.origin, np.int64)[c:] - c
            back[0] = 0
            self.at, self.origin = self.at[c:], array("q", back.tobytes())
            self.number = [k - c for k in self.number]
        return cuts

    def rest(self) -> list[int]:
        """All cuts up to the last place, which is one."""
        return self._path(len(self.at) - 1)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_LAST = np.array([END], np.uint32)


class _Packer:
    """Takes documents and gives the pieces of windows that are certain."""

    def __init__(self, tokenizer: TextTokenizer, first_sequence: int):
        self.tokenizer, self.sequence = tokenizer, first_sequence
        self.planner = Planner()
        self.names: list = []
        self.first: list[int] = []  # place of each document's first id
        self.length: list[int] = []
        self.ids: list[np.ndarray] = []
        self.total = self.done = 0  # ids that came, and those in pieces given out

    def add(self, texts: list[str | None], ids: list) -> None:
        """Further documents; those of one call are looked at together."""
        coded = [self.tokenizer.ids(t if isinstance(t, str) else "") for t in texts]
        length = np.array([len(x) + 1 for x in coded])
        ends = np.cumsum(length)
        flat = np.concatenate([y for x in coded for y in (x, _LAST)])
        places, penalties = self.tokenizer.cut_places(flat, ends)
        self.planner.add((places + self.total).tolist(), penalties.tolist())
        self.names += ids
        self.first += (ends - length + self.total).tolist()
        self.length += length.tolist()
        self.ids.append(flat)
        self.total += len(flat)

    def flush(self, last: bool) -> list[tuple]:
        cuts = self.planner.rest() if last else self.planner.certain()
        if not cuts:
            return []
        ids = np.concatenate(self.ids)
        first, length = np.array(self.first), np.array(self.length)
        ends = first + length
        cuts = np.array([self.done, *cuts])
        done = int(cuts[-1])
        bounds = np.unique(np.concatenate([cuts, ends[ends < done]]))
        lo, hi = bounds[:-1], bounds[1:]
        doc = np.searchsorted(ends, lo, "right")
        window = np.searchsorted(cuts, lo, "right") - 1
        raw = memoryview(ids.astype("<u4", copy=False).tobytes())
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(((lo - self.done) * 4).tolist(), ((hi - self.done) * 4).tolist())]
        names = [self.names[d] for d in doc.tolist()]
        numbers = ((lo - first[doc]), hi - lo, length[doc], self.sequence + window, lo - cuts[window])
        start, size, tokens, sequence, offset = (x.tolist() for x in numbers)
        rows = list(zip(names, start, size, crc, tokens, sequence, offset))
        self.sequence += len(cuts) - 1
        keep = int(np.searchsorted(ends, done, "right"))
        self.names, self.first, self.length = self.names[keep:], self.first[keep:], self.length[keep:]
        self.ids, self.done = [ids[done - self.done :].copy()], done
        return rows


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every row of ``df`` is one document: the ids of its text by the tokenizer file ``vocabulary``, then
    END. Null and empty texts have END alone; null ids pass through; repeated rows are documents of
    their own; an empty table gives an empty result; further columns are not read. Sequences hold up to
    WINDOW ids of consecutive documents of one input partition, so each partition can leave one short
    sequence, and no shuffle is needed. The plan is the best one for the whole partition. Windows are
    given out once no later document can change them, which for ordinary sentences is a few windows
    back; memory is bounded by that, an Arrow batch, COMMIT ids and the longest text. Where equally good
    ways never meet (lines all of one length, say), windows wait for the partition's end, and memory is
    that of the partition's ids and places. ``sequence_id`` is the partition's
    number times 2^33 plus the window's number in it.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer = _Packer(_tokenizer(vocabulary), TaskContext.get().partitionId() << 33)
        looked = 0
        for batch in batches:
            texts, ids = batch["_text"].tolist(), batch["_id"].tolist()
            group = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts]) // TEXT_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if texts else []
            for lo, hi in zip(cuts, cuts[1:]):
                packer.add(texts[lo:hi], ids[lo:hi])
                if packer.total - looked >= COMMIT:
                    looked = packer.total
                    yield pd.DataFrame(packer.flush(False), columns=names)
        yield pd.DataFrame(packer.flush(True), columns=names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(tidied(run, release), f"`{id_col}` {kind}, {PIECES}")


_made: dict[str, TextTokenizer] = {}


def _tokenizer(path: str) -> TextTokenizer:
    if path not in _made:
        _made[path] = TextTokenizer(path)
    return _made[path]
