"""The q-gram index against a loop over all pairs."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import clean, likeness


def _strings(r, n, letters, longest):
    return sorted({"".join(r.choice(list(letters), int(k))) for k in r.integers(1, longest, n)})


@pytest.mark.parametrize("letters, longest, least", [("ab", 14, 0.75), ("abcdefgh", 12, 0.75), ("市北京南上海x", 7, 0.75), ("abcd", 16, 0.6), ("abcde", 20, 0.9)])
def test_no_pair_is_lost(spark, letters, longest, least):
    r = np.random.default_rng(len(letters) + longest)
    left, right = _strings(r, 120, letters, longest), _strings(r, 120, letters, longest)
    left += [x[: len(x) // 2] + "q" + x[len(x) // 2 + 1 :] for x in right[::3]] + ["", "a"]
    left, right = sorted(set(left)), sorted(set(right))
    ls, rs = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    got = {tuple(x) for x in likeness.alike_candidates(ls, rs, least).collect()}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= least}
    assert want <= got and want
    inside = {(a, b) for a in left for b in right if min(len(a), len(b)) >= 2 and (a in b or b in a)}
    assert {tuple(x) for x in likeness.contained(ls, rs).collect()} == inside and inside


def test_names_as_by_a_double_loop(spark):
    r = np.random.default_rng(7)
    aliases = _strings(r, 150, "海南北京上州", 6) + _strings(r, 150, "abcdef", 11)
    r.shuffle(aliases)
    names = sorted({*aliases[:10], *(a[:-1] + "z" for a in aliases[::2] if len(a) > 3), *(a + "海a" for a in aliases[::9]), *_strings(r, 60, "abcdef", 10), "none", "NaN", " ", "zzzz"})
    entries = [(a, f"c{k}", k) for k, a in enumerate(aliases)]
    mapping = spark.createDataFrame(entries, "alias string, code string, position int")
    cleaned = {x[0]: x[1] for x in spark.createDataFrame([(x,) for x in {*aliases, *names}], "x string").select("x", clean.clean_name(F.col("x"))).collect()}

    def by_hand(name):
        own, codes = cleaned[name], {a: c for a, c, _ in entries}
        if not name.strip() or name.strip().lower() in ("nan", "none", "null"):
            return name
        for key, table in ((name, codes), (own, codes), (own, {cleaned[a]: c for a, c, _ in reversed(entries)})):
            if key in table:
                return table[key]
        best, found = 0.0, None
        for a, c, _ in entries:
            if len(own) >= 2 and len(cleaned[a]) >= 2 and (own in cleaned[a] or cleaned[a] in own):
                return c
        for a, c, _ in entries:
            score = SequenceMatcher(None, own, cleaned[a]).ratio()
            if score > best:
                best, found = score, c
        return found if best >= 0.75 else name

    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "entity_id string, k int")
    got = {x["k"]: x["entity_id"] for x in clean.normalise_entities(df, "entity_id", mapping).collect()}
    want = {k: by_hand(n) for k, n in enumerate(names)}
    assert got == want
    plain = {x["k"]: x["entity_id"] for x in clean.normalise_entities(df, "entity_id", mapping, fuzzy=False).collect()}
    assert sum(plain[k] != want[k] for k in want) > 30  # the likeness step had something to do
    assert clean.normalise_entities(df, "entity_id", mapping.where("false")).count() == len(names)
