"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix at unit ends and dealt out between sentinels.

Arrow-batched pandas UDFs: the ends of all units go into one compact array, two lookups in it slice the text,
and hashlib gives the cuts' seeds and the digests.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
CUT_PERCENT, SPM_PERCENT = 50, 80  # of the texts, those that are cut; of those, the ones in suffix-prefix-middle order
CUT_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """Offset after each unit, in code points, four bytes each."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def cut(id_: str, text: str, seed: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    ends = unit_ends(text)
    n, drawn = len(ends), hashlib.sha256(f"{seed}:{id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or h3 % 100 >= CUT_PERCENT or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, stop = (ends[k - 1] if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", start, stop - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, stop - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def joined_again(output: str, form: str) -> str:
    """The text that ``output`` was made from. No sentinel has a border, so that none can arise where text and sentinel meet."""
    if form == "plain":
        return output
    inner = {"psm": SUFFIX, "spm": PREFIX}[form]
    first, _, rest = output[len(PREFIX) :].partition(inner)
    second, _, middle = rest.partition(MIDDLE)
    return first + middle + second if form == "psm" else second + middle + first


def _cut_udf(seed: str):
    @F.pandas_udf(CUT_SCHEMA)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [cut(i, t, seed) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
        out["output_sha256"] = [digest(r[4]) for r in rows]
        return out

    return run


def restored(output: Column, form: Column) -> Column:
    """Struct (text, sha256) of the text that ``output`` was made from."""

    @F.pandas_udf("text string, sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [joined_again(o, f) for o, f in zip(outputs, forms)]
        return pd.DataFrame({"text": texts, "sha256": [digest(t) for t in texts]})

    return run(output, form)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "42") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256) for every row of ``df``.

    Cuts and form depend on seed, id and text only, so that a task that is run again gives the same rows. Null
    texts count as empty and stay plain; a null id is drawn as empty text; rows of equal id and text are equal.
    A text with a sentinel stays plain, as it couldn't be restored. An empty table gives an empty result,
    further columns are not read. Memory is that of an Arrow batch and four bytes a unit of one text.
    """
    made = _cut_udf(seed)(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col), made.alias("_made")).select(id_col, "_made.*")
