"""Fill-in-the-middle, vector codes and license scans against brute force, and on odd tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import codebooks, fim, licenses
from causeway.llm.entries import QUERIES

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
TEXTS = [None, "", "   ", "a", " lead and trail \n", "one two", "The same text here.", "The same text here.", "été größe niño 中文  x 😀y " * 5, "has <P> inside", "ends <", "<S", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS * 3)] + [(None, "no id here", None), (3, "a", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit(1).alias(c) for c in ("_id", "_text", "n", "form", "output", "_words", "_row", "token", "label", "rank")))


def _cut_by_hand(i, text):
    text = text or ""
    units, at = [], 0
    pattern = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
    while at < len(text):
        m = pattern.match(text, at)
        units.append(m[0])
        at = m.end()
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cut_by_hand_and_back(docs):
    back = fim.restored(F.col("output"), F.col("form"))
    got = fim.fill_in_middle(docs).select("*", back.alias("back")).collect()
    assert len(got) == docs.count()
    want = {(r["doc_id"], r["text"] or ""): _cut_by_hand(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in got:
        n, form, p, m, out = want[r["doc_id"], r["back"]["text"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, p, m, out)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["back"]["sha256"] == hashlib.sha256(r["back"]["text"].encode()).hexdigest()
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_no_sentinel_arises_where_parts_meet():
    for p in ("", "<", "<S", "a<P", "<M", ">"):
        for m in ("", "<", "S>", "x"):
            for s in ("", "M>", "<P", ">"):
                if not any(x in p + m + s for x in fim.SENTINELS):
                    assert fim.joined_again(f"<P>{p}<S>{s}<M>{m}", "psm") == p + m + s == fim.joined_again(f"<S>{s}<P>{p}<M>{m}", "spm")


def test_tree_finds_the_lowest_index_of_equal_entries():
    r = np.random.default_rng(3)
    for n, spread in ((1, 5), (7, 1), (64, 2), (64, 300), (300, 4)):
        points = r.integers(-spread, spread + 1, (n, 4))
        x = r.integers(-spread - 2, spread + 3, (500, 4))
        d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        k, best = codebooks.nearest(codebooks.kd_tree(points), x)
        assert np.array_equal(best, d.min(axis=1)) and np.array_equal(k, d.argmin(axis=1))
    same = np.ones((20, 3), np.int64)
    assert not codebooks.nearest(codebooks.kd_tree(same), same)[0].any()


def _codes_by_hand(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(256 * v) for v in r[1]] for r in rows]
    m = len(x[0]) // parts
    cut = [[tuple(v[p * m : (p + 1) * m]) for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(near(p, v[p])[1], []).append(v[p])
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])])
        books = new
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    return [(r[0], r[2], [k for _, k in f], sum(d for d, _ in f)) for r, f in zip(rows, found)], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_codebooks_by_hand(spark):
    r = np.random.default_rng(5)
    rows = [(int(i) if i % 9 else None, [float(np.float32(v)) for v in np.round(r.normal(0, 0.2, 32), 2)], None if i % 5 == 0 else int(i % 3)) for i in range(300)]
    rows += [rows[4], rows[4], (4, rows[7][1], 2)]
    bad = [(-9, None, 1), (-8, [1.0, None] * 16, 1), (-7, [float("nan")] * 32, 1), (-6, [float("inf")] + [0.0] * 31, 1), (-5, [], 1), (999, [0.5] * 48, 1)]
    df = spark.createDataFrame([(a, b, c, 0, 0) for a, b, c in rows + bad], "vec_id long, embedding array<float>, label int, _v int, codes int").repartition(7)
    want, sha = _codes_by_hand(rows, 16, 64, 2)
    got = codebooks.compress(df).collect()
    key = lambda t: tuple((v is None, v or 0) for v in t[:2]) + tuple(t[2:])
    assert sorted([(g["vec_id"], g["label"], list(g["codes"]), g["error"]) for g in got], key=key) == sorted(want, key=key)
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert all(g["label_error"] == sums[g["label"]] and g["codebooks_sha256"] == sha for g in got)
    assert codebooks.compress(df.where("false")).count() == 0 and codebooks.compress(df.where("vec_id < 0")).count() == 0
    few = codebooks.compress(df.where("vec_id in (10, 11)")).collect()
    assert [sorted(g["codes"])[0] for g in few] in ([0, 1], [1, 0]) and all(g["error"] == 0 for g in few)
    with pytest.raises(ValueError):
        codebooks.fit_codebooks(df.where("vec_id = 10").select("vec_id", F.slice("embedding", 1, 5).alias("embedding")))


NOTICE = " ".join(licenses.TEMPLATES[3].words)
LICENSED = [
    None,
    "",
    "...!?",
    "Released under the MIT License.",
    "under the mit under the MIT license, under-the-mit-license",
    "cc by nc by nc cc BY-nc",
    "Licensed under the Apache License, Version 2.0.",
    "apache license versión 2",
    "x " * 13 + NOTICE.upper() + " y" * 9,
    " ".join(w for k, w in enumerate(NOTICE.split()) if k % 7),  # six of seven words
    " ".join(w for k, w in enumerate(NOTICE.split()) if k % 3),  # two of three words
    " ".join(reversed(NOTICE.split())),
    "the license " * 3000 + "under the mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "é中 under the mit license Éa",
]


def _scan_by_hand(text, templates):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", text)
    places, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        m = len(t.words)
        if t.phrase:
            own = [k for k in range(len(words) - m + 1) if tuple(words[k : k + m]) == t.words]
            places += own
            if own:
                base.add(t.label)
                score = 1.0
        else:
            for k in range(0, len(words), m):
                share = len(set(words[k : k + 2 * m]) & set(t.words)) / len(set(t.words))
                if 100 * share >= licenses.PERCENT:
                    labels.add(t.label)
                    score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), pytest.approx(score)


def test_licenses_by_hand(spark, docs):
    r = np.random.default_rng(8)
    pool = [*NOTICE.split(), *"under the mit license apache version 2 cc by nc of a".split()]
    texts = LICENSED + [" ".join(r.choice(pool, 90)) for _ in range(40)]
    df = spark.createDataFrame([(i if i % 4 else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1)], "doc_id long, text string, label string, _row int")
    got = sorted(map(tuple, licenses.license_scan(df).collect()), key=str)
    want = [(i if i % 4 else None, *_scan_by_hand(t, licenses.TEMPLATES)) for i, t in enumerate(texts)] + [(5, *_scan_by_hand(texts[5], licenses.TEMPLATES))]
    assert len(got) == len(want)
    for w in want:
        hit = next((g for g in got if g == w), None)
        assert hit, w
        got.remove(hit)
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(docs.where("false")).count() == 0


def test_license_blocks_lose_nothing(spark):
    """Other templates: every block that meets one, once, whatever words are frequent."""
    r = np.random.default_rng(9)
    pool = list("abcdefghijklm")
    templates = (licenses.notice("n", "a b c d e a b"), licenses.notice("m", "f g h i j k l m"), licenses.phrase("p", "a a b"))
    texts = [" ".join(r.choice(pool, n)) for n in (0, 1, 6, 30, 200, 400, 4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((g["doc_id"], g["label"], g["first"], g["overlap"], tuple(g["places"] or ())) for g in licenses.license_blocks(df, templates=templates).collect())
    want = []
    for i, text in enumerate(texts):
        words = text.split()
        for t in templates:
            m, own = len(t.words), set(t.words)
            for k in range(0, len(words), m):
                o = len(set(words[k : k + 2 * m]) & own)
                if o >= t.need:
                    places = tuple(s for s in range(k, k + m) if tuple(words[s : s + m]) == t.words) if t.phrase else ()
                    want.append((i, t.label, k, o, places))
    assert got == sorted(want) and {g[1] for g in got} == {"n", "m", "p"}


def test_license_join_is_native(spark, sf):
    plan = QUERIES["op13_license_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
