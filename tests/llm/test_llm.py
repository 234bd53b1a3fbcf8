"""Brute-force checks and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import time
import wave
import tracemalloc
import zlib
from io import BytesIO
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.llm import components, decontam, html_extract, langid, media, minhash, packing, quality, sharding, toxicity, warc
from causeway.llm._common import bounded_sample, fresh_dir
from causeway.llm.entries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
TEXTS = [None, "", "   ", "a", "one two", "The same text here, twice.", "The same text here, twice.", "été größe niño 中文 " * 5, LONG, "x" * 3000, "tab\tand\nlines  two"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a null id, a repeated row, and further columns whose names operators use inside."""
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "a", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").select(
        "*", *(F.lit(1).alias(c) for c in ("_id", "_text", "n", "keys", "size", "slot", "shard", "score", "rep", "seed", "_words", "media"))
    )


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_media_round_trip(docs, none):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_columns(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i, len(raw)]
        with wave.open(BytesIO(r["media"])) as w:
            assert w.readframes(w.getnframes()) == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["fp_time"]) == len(r["fp_hash"]) > 0
    assert media.with_feature(media.media_columns(none)).count() == 0


def test_fingerprints_by_brute_force():
    """Discrete Fourier transforms by their sum, peaks and pairs frame by frame."""
    r = np.random.default_rng(12)
    for text in ("Some words, again and again. " * 70, *("".join(map(chr, r.integers(32, 126, n))) for n in (570, 2500))):
        x = np.frombuffer(media.padded(text)[0], np.uint8).astype(float) - 128
        frames = [x[k : k + 576] * np.hanning(576) for k in range(0, len(x) - 575, 288)]
        angle = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
        power = [np.abs(angle @ f) ** 2 for f in frames]
        top = [[lo + int(np.argmax(p[lo:hi])) for lo, hi in media.BANDS] for p in power]
        height = [[p[b] for b in t] for p, t in zip(power, top)]
        n = len(frames)
        peak = [[(t == 0 or height[t][b] > height[t - 1][b]) and (t == n - 1 or height[t][b] >= height[t + 1][b]) for b in range(4)] for t in range(n)]
        want = sorted((t, top[t][b] << 12 | top[t + dt][c] << 3 | dt) for t in range(n) for dt in range(min(media.FAN_OUT, n - 1 - t) + 1) for b in range(4) for c in (b, b + 1) if c < 4 and (dt or c > b) and peak[t][b] and peak[t + dt][c])
        ((time, code),) = media.fingerprints([media.padded(text)[0]])
        assert list(zip(time.tolist(), code.tolist())) == want and want


def test_fingerprints_do_not_depend_on_neighbours():
    payloads = [media.padded(t)[0] for t in TEXTS]
    for (t, h), p in zip(media.fingerprints(payloads), payloads):
        (t1, h1) = media.fingerprints([p])[0]
        assert np.array_equal(t, t1) and np.array_equal(h, h1)


def test_ring_is_balanced_and_moves_little(spark, docs, none):
    out = sharding.assign_shards(docs, 5).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min([len(by.get(s, [])) for s in range(5)]) <= 1
    assert sharding.assign_shards(none, 5).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(many, n).collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 0.15 * 5000  # a new shard takes 1 in 11
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(many, n).collect()} for n in (24, 25))
    assert sum(a[i] != b[i] for i in a) < 0.1 * 5000  # 1 in 25


def test_ring_splits_a_slot_of_one_id(spark):
    """A third of the rows have one id, and some have none: parts of a slot are ranked apart, without gaps."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.assign_shards(rows, 5, most=20).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 900 and all(sorted(s) == list(range(180)) for s in by.values())


def test_bounded_sample_of_rows_without_ids(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 == 0, F.col("id")).alias("k"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 11).cast("int"))).alias("t"), F.lit(1).alias("_bytes"))
    for docs, size in ((300, 1 << 20), (300, 500), (5000, 1 << 20), (6000, 1000)):
        found = bounded_sample(rows, "k", "t", docs, size, "s").collect()
        total = sum(len(r["t"] or "") for r in found)
        assert len(found) <= docs and total <= size and (len(found) > 0.9 * docs or total > 0.9 * size) and found[0].asDict().keys() == {"k", "t", "_bytes"}
        assert sum(r["k"] is None for r in found) == pytest.approx(0.8 * len(found), abs=0.1 * len(found))
    same = rows.select(F.lit(1).alias("k"), F.lit("one text").alias("t"))
    assert 270 <= bounded_sample(same, "k", "t", 300, 1 << 20, "s").count() <= 300
    assert bounded_sample(rows.where("false"), "k", "t", 10, 10, "s").count() == 0


def test_ring_plan_by_brute_force():
    r = np.random.default_rng(1)
    owners = sharding.ring_owners(4, 8)
    counts = {int(s): int(r.integers(1, 50)) for s in r.integers(0, sharding.RING_SLOTS, 60)}
    limits = sharding.quotas(sum(counts.values()), 4)
    room, want = list(limits), {}
    for s in sorted(counts):
        for k in range(1, counts[s] + 1):
            if room[owners[s]]:
                room[owners[s]] -= 1
                want[s, k] = owners[s]
    waiting = []
    for step in range(2 * len(owners)):
        s = step % len(owners)
        if step < len(owners) and s in counts:
            waiting += [(s, k) for k in range(1, counts[s] + 1) if (s, k) not in want]
        while waiting and room[owners[s]]:
            room[owners[s]] -= 1
            want[waiting.pop(0)] = owners[s]
    got = {(s, k): shard for s, lo, hi, shard, _ in sharding.plan_ring(counts, owners, limits) for k in range(lo, hi + 1)}
    assert got == want


def test_warc_reaches_the_stores_that_spark_names(monkeypatch):
    asked = []

    class Own:
        from_uri = staticmethod(lambda u: asked.append(("own", u)) or (None, u))

    class Hadoop:
        from_uri = staticmethod(lambda u: asked.append(("hadoop", u)))

    monkeypatch.setattr(warc, "FileSystem", Own)
    monkeypatch.setattr(warc, "HadoopFileSystem", Hadoop)
    paths = [warc.file_system(u)[1] for u in ("s3a://b/x/y", "s3n://b/x", "gs://b/x", "file:///tmp/x", "/tmp/x", "hdfs://name:8020/x/y", "viewfs://far/z")]
    assert [u for _, u in asked] == ["s3://b/x/y", "s3://b/x", "gs://b/x", "file:///tmp/x", "/tmp/x", "hdfs://name:8020/x/y", "viewfs://far/z"]
    assert [k for k, _ in asked] == ["own"] * 5 + ["hadoop"] * 2 and paths[-2:] == ["/x/y", "/z"]


def test_warc(spark):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/ b", same), (2, None, same), (2, "u", same), (3, "u", "short"), (4, "u", "short"), (None, "u", same), (6, "u", None), (7, "u\n", ""), (8, "é", "é" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_id", F.lit(1)).withColumn("file", F.lit(1))
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages).collect()))
    n = len(same)
    assert got == sorted([(5, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 5, "response", None), (4, 5, "response", None), (-1, n, "revisit", 2), (6, 0, "response", None), (7, 0, "response", None), (8, 100_000, "response", None)])
    assert warc.archive_round_trip(pages.where("false")).count() == 0
    folder = fresh_dir(spark, "warc")
    index = warc.write_archives(pages, folder)
    one = warc.read_records(index.where("id = '8'"), folder, payloads=True).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]).decode() == "é" * 50_000 and one[0]["url"] == "é"


def test_language(spark, docs, none):
    en, fr = "the house and the garden of the king with other things ", "la maison et le jardin du roi avec les autres choses "
    train = spark.createDataFrame([(i, (en, fr)[i % 2] * 5, ("en", "fr")[i % 2]) for i in range(40)] + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit_language_model(train)
    assert model.languages == ["en", "fr"]
    mixed = model.mixture(en * 3 + fr * 3)
    assert set(mixed) == {"en", "fr"} and mixed["en"] == pytest.approx(0.5, abs=0.15) and list(model.mixture(en * 3)) == ["en"]
    got = {r["doc_id"]: r for r in langid.predict_language(docs, model).collect() if r["doc_id"] is not None}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert langid.predict_language(none, model).count() == 0
    # rows without an id are drawn one by one
    many = train.where("lang is not null").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")
    assert set(langid.fit_language_model(many, max_docs=20).mixture(en * 3 + fr * 3)) == {"en", "fr"}
    empty = langid.fit_language_model(train.where("false"))
    assert {r["lang_pred"] for r in langid.predict_language(docs, empty).collect()} == {"und"}


def test_language_shares_by_grid():
    """Expectation-maximisation comes to the shares of greatest likelihood, and the penalty picks the set, as a grid over all shares does."""
    r = np.random.default_rng(9)
    model = langid.LanguageModel(["a", "b", "c"], r.integers(0, 50, (3, langid.BINS)).astype(float))
    for text in ("the quick brown fox jumps over it " * 3, "abc def ghi", "x"):
        bins, counts = langid.trigram_bins(text)
        p = model.probs[bins].astype(float)
        grid = [(i / 50, j / 50, 1 - i / 50 - j / 50) for i in range(51) for j in range(51 - i)]
        value = lambda s: counts @ np.log(p @ np.array(s)) - (sum(x > 0 for x in s) - 1) * np.log(max(counts.sum(), 2)) / 2
        best = max(grid, key=value)
        found = model.mixture(text, rounds=400)
        own = [found.get(k, 0.0) for k in "abc"]
        assert value(own) >= value(best) - 0.05 and sum(own) == pytest.approx(1)


def test_language_of_a_short_passage_in_a_long_text(spark):
    en, fr = "the house and the garden of the king with other things ", "la maison et le jardin du roi avec les autres choses "
    train = spark.createDataFrame([(i, (en, fr)[i % 2] * 5, ("en", "fr")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(train)
    found = model.mixture(en * 1800 + fr * 14)  # about 150 words in 20,000
    assert set(found) == {"en", "fr"} and 0.002 < found["fr"] < 0.01 and list(model.mixture(en * 1800)) == ["en"]


def test_toxicity(spark, sf, docs, none):
    r = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(400)]
    rows = []
    for i in range(300):
        w = [str(x) for x in r.choice(words, 40)]
        if i % 4 == 0:
            w[int(r.integers(0, 40))] = "vilest"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit_toxicity(df.where("doc_id < 240"))
    got = toxicity.score_toxicity(df.where("doc_id >= 240"), net).collect()
    assert sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in got) >= 0.97 * len(got)
    odd = toxicity.score_toxicity(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= x["score"] <= 1 for x in odd)
    assert toxicity.score_toxicity(none, net).count() == 0
    blank = toxicity.fit_toxicity(df.where("toxic = 0"))
    assert {x["predicted"] for x in toxicity.score_toxicity(df, blank).collect()} == {0}


def _encoded(texts):
    """Word numbers of each text, and rows and lines of the vocabulary, as training takes them."""
    words = toxicity.Vocabulary()
    numbers = [toxicity.encode([t], words)[0] for t in texts]
    rows, starts = toxicity.subwords(words.taken())
    return numbers, rows, np.concatenate([[0], starts, [len(rows)]])


def _vectors(net, rows, lines):
    return np.concatenate([np.zeros((1, toxicity.DIM), np.float32), net.embedded(rows, lines[1:-1])])


def test_what_scores_toxicity_is_of_the_size_of_what_was_learnt():
    texts = ["a foul word", "a kind word", "foul and kinder", "kind"] * 5
    words = toxicity.Vocabulary()
    numbers = [toxicity.encode([t], words)[0] for t in texts]
    rows, starts = toxicity.subwords(words.taken())
    net = toxicity.ConvNet()
    net.start_from(numbers, np.array([1, 0] * 10), rows, np.concatenate([[0], starts, [len(rows)]]))
    small = net.compact()
    assert len(small.table) == net.table.any(axis=1).sum() + 1 < 1000 and net.place is None
    more, at = toxicity.subwords([*words, "foul", "neverseen"][1:])
    assert np.array_equal(small.embedded(more, at), net.embedded(more, at)) and small.embedded(more, at).any()
    assert len(__import__("pickle").dumps(small)) < len(__import__("pickle").dumps(net)) / 4


def test_toxicity_scores_do_not_depend_on_neighbours():
    net = toxicity.ConvNet()
    net.table += np.random.default_rng(0).standard_normal(net.table.shape).astype(np.float32)
    net.table[0] = 0
    texts = [t or "" for t in TEXTS]

    def logits(some):
        words = toxicity.Vocabulary()
        numbers, starts, _ = toxicity.encode(some, words)
        rows, lines = toxicity.subwords(words.taken())
        return net.logits(_vectors(net, rows, np.concatenate([[0], lines, [len(rows)]]))[numbers], starts)

    assert logits(texts) == pytest.approx([logits([t])[0] for t in texts], rel=1e-4, abs=1e-3)


def test_subwords_by_hand(spark):
    """Equal n-grams have equal rows, whatever words they are in; different ones hardly ever."""
    words = ["réeuxpa", "a", "中文", "pareux", "réeux", "aa"]
    rows, starts = toxicity.subwords(words)
    seen, wanted = {}, 0
    for w, at in zip(words, starts):
        marked = f"<{w}>"
        for i in range(len(marked)):
            for k, n in enumerate(toxicity.NGRAMS):
                gram = marked[i : i + n] if i + n <= len(marked) else None
                got = rows[at + i, k]
                assert (got == 0) == (gram is None)
                if gram:
                    wanted += 1
                    assert seen.setdefault((n, gram), got) == got
        assert rows[at, -1] > 0 and not rows[at + 1 : at + len(marked), -1].any()
    assert len(set(seen.values())) == len(seen) < wanted and len(set(rows[starts, -1])) == len(words)
    alone = [toxicity.subwords([w])[0] for w in words]
    assert np.array_equal(np.concatenate(alone), rows)


def test_toxicity_meets_new_forms_of_a_stem(spark):
    """Held-out forms are in no training text; they share a stem of four letters with those that are. Clean texts are of the same syllables."""
    r = np.random.default_rng(2)
    syllables = ["ba", "ño", "rr", "ti", "men", "so", "que", "ía", "lo", "cu", "per", "dan"]
    word = lambda: "".join(r.choice(syllables, int(r.integers(1, 4))))
    rows = []
    for i in range(600):
        w = [word() for _ in range(40)]
        if i % 5 == 0:
            for k in r.integers(0, 40, 4):
                w[k] = "zorb" + str(r.choice(["ba", "ño", "rr", "ti", "men", "so"] if i < 450 else ["que", "ía", "lo", "cu", "per", "dan"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit_toxicity(df.where("doc_id < 450"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(df.where("doc_id >= 450"), net).collect()}
    assert sum(got[i] for i in got if i % 5 == 0) >= 29 and sum(got[i] for i in got if i % 5) <= 3


def test_gradients_by_finite_differences():
    """One step of Adagrad tells the gradient: the step is rate x g / sqrt(0.1 + g^2)."""
    r = np.random.default_rng(4)
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(9)) for _ in range(6)]
    (numbers, rows, lines), labels = _encoded(texts), np.array([1, 0, 1, 1, 0, 0])
    starts = np.cumsum([0] + [len(t) for t in numbers[:-1]])
    every = np.concatenate(numbers)

    def fresh():
        net = toxicity.ConvNet(seed=3)
        net.table *= 10
        net.table[0] = 0
        net.known[:] = True
        for f in net.shift.values():
            f += 0.4
        return net

    def loss(net):
        z = net.logits(_vectors(net, rows, lines)[every], starts)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))  # labels of either kind weigh alike here

    before, net, rate = fresh(), fresh(), 0.05
    net.train(numbers, labels, rows, lines, epochs=1, batch=6, rate=rate)
    where = [(lambda n, w=w: n.filters[w], tuple(int(r.integers(0, k)) for k in before.filters[w].shape)) for w in toxicity.WIDTHS for _ in range(6)]
    where += [(lambda n, w=w: n.shift[w], (int(r.integers(0, toxicity.FILTERS)),)) for w in toxicity.WIDTHS for _ in range(3)]
    where += [(lambda n: n.out, (k,)) for k in (0, 13, 30, 50, 90)]
    checked = 0
    for of, at in where:
        moved = float(of(before)[at] - of(net)[at]) / rate
        got = moved * np.sqrt(0.1) / np.sqrt(max(1 - moved**2, 1e-12))
        up, down = fresh(), fresh()
        of(up)[at] += 1e-3
        of(down)[at] -= 1e-3
        forward, backward = (loss(up) - loss(before)) / 1e-3, (loss(before) - loss(down)) / 1e-3
        if abs(forward - backward) < 2e-3:  # else another word becomes the maximum in between
            assert got == pytest.approx((forward + backward) / 2, abs=2e-3)
            checked += abs(got) > 5e-3
    assert checked > 15


def test_training_improves_on_the_start():
    """The label is told by the order of two words, which no word's log-odds tells."""
    r = np.random.default_rng(6)
    filler = ["".join(chr(97 + c) for c in r.integers(0, 26, 4)) for _ in range(60)]
    texts, labels = [], []
    for i in range(600):
        w = [str(x) for x in r.choice(filler, 12)]
        at = int(r.integers(0, 11))
        w[at : at + 2] = ["veryx", "badly"] if i % 2 else ["badly", "veryx"]
        texts.append(" ".join(w))
        labels.append(i % 2)
    labels, (numbers, rows, lines) = np.array(labels), _encoded(texts)
    net = toxicity.ConvNet()
    net.start_from(numbers[:450], labels[:450], rows, lines)

    def right():
        vectors = _vectors(net, rows, lines)
        z = np.array([net.logits(vectors[t], np.zeros(1, np.int64))[0] for t in numbers[450:]])
        return np.mean((z > np.median(z)) == labels[450:])

    start = right()
    net.train(numbers[:450], labels[:450], rows, lines, epochs=12)
    assert start < 0.6 and right() > 0.8


def test_label_model_by_rows():
    """Counted patterns give what expectation-maximisation over every row, written out, gives."""
    r = np.random.default_rng(7)
    rows = ["".join(r.choice(list("01-"), p=(0.2, 0.6, 0.2)) for _ in range(4)) for _ in range(400)]
    counts = {p: rows.count(p) for p in rows}
    got = quality.fit_label_model(counts, rounds=8)
    q = [1 - min(p.count("0") / 2, 0.95) for p in rows]
    for _ in range(8):
        share, rates = min(max(sum(q) / len(q), 0.01), 0.99), []
        for j in range(4):
            cast = [k for k, p in enumerate(rows) if p[j] != "-"]
            yes = [k for k in cast if rows[k][j] == "1"]
            prior = 0.2 * len(cast) + 1
            rates.append(((sum(1 - q[k] for k in yes) + 1) / (sum(1 - q[k] for k in cast) + 2), (sum(q[k] for k in yes) + prior * 0.99) / (sum(q[k] for k in cast) + prior)))
        q = []
        for p in rows:
            good, bad = share, 1 - share
            for j, c in enumerate(p):
                if c != "-":
                    good *= rates[j][1] if c == "1" else 1 - rates[j][1]
                    bad *= rates[j][0] if c == "1" else 1 - rates[j][0]
            q.append(good / (good + bad))
    assert got.rates == pytest.approx(np.array(rates), abs=1e-9) and [got.of(p) for p in rows[:50]] == pytest.approx(q[:50], abs=1e-9)


def test_label_model_finds_accuracies():
    r = np.random.default_rng(2)
    truth = r.random(20_000) < 0.8
    hit = (0.97, 0.95, 0.9)  # chance of calling bad texts bad
    patterns: dict = {}
    for y in truth:
        p = "".join(("1" if r.random() > 0.01 else "0") if y else ("0" if r.random() < h else "1") for h in hit)
        p = p[:2] + ("-" if r.random() < 0.3 else p[2])
        patterns[p] = patterns.get(p, 0) + 1
    m = quality.fit_label_model(patterns)
    assert m.share_good == pytest.approx(0.8, abs=0.02) and 1 - m.rates[:, 0] == pytest.approx(hit, abs=0.03)
    assert m.of("111") > 0.95 and m.of("00-") < 0.01 and m.of("---") == pytest.approx(m.share_good)


def test_quality(spark, sf, docs, none):
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer, _ = quality.fit_quality(all_docs)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(all_docs, scorer).join(labels, "doc_id").collect()
    good, bad = [r["good"] for r in rows if r["quality"] == 1], [r["good"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3
    assert quality.score_quality(docs, scorer).count() == docs.count() and quality.score_quality(none, scorer).count() == 0
    quality.fit_quality(none)


def test_measures_of_texts_by_regular_expressions(spark):
    """One pass over a text counts what a search a trait counts; votes on rows are those on texts."""
    r = np.random.default_rng(4)
    parts = ["the", "The", "dem", "MÁS", "y", "x²", "a", "a.", "¡no!", "l’eau", "(so)", 'of"', '"it".', "~~", "#", "😀", "𝐀", "ß", "\u0130y", "字", "\u00a0", "\x1c", "\n", "\t", " ", ""]
    texts = ["", " ", "\n", "\n\n", " \n ", "\na a", "a  a a\t"] + [" ".join(r.choice(parts, r.integers(1, 30))) for _ in range(500)]
    m = quality.measures(texts)
    kind = lambda t, *k: sum(__import__("unicodedata").category(c).startswith(k) for c in t)
    for k, t in enumerate(texts):
        split, inked = re.split(r"(?a:\s+)", t.strip(" ")), re.findall(r"(?a:\S+)", t)
        n, words = max(len(t), 1), len(split)
        common = sum(w in quality.FUNCTION_SET for w in "".join(c if kind(c, "L") else " " for c in t.lower()).split())
        body = [w[:-1] if len(w) > 1 and w[-1] in '.,;:?!)"' else w for w in inked]
        plain = sum(all(kind(c, "L", "N") or c in "'’(\"-" for c in w) for w in body)
        again = sum(a == b for a, b in zip(inked, inked[1:]))
        want = {
            "n": n, "words": words, "odd": len(re.findall(r"[#$%&*|~^=<>{}\[\]_\\@+]", t)) / n, "upper": kind(t, "Lu") / n, "lower": kind(t, "Ll") / n, "bare": len(re.findall(r"(?a:\s)", t)) / n,
            "shouts": t.count("!") / words, "ends": len(re.findall("[.?!:;]", t)) / words, "common": common / words, "plain": plain / words, "again": again / words, "variety": len(set(split)) / words,
        }
        assert {c: v[k] for c, v in m.items()} == pytest.approx(want), t
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k long, text string").repartition(3)
    got = {x["k"]: x["v"] for x in df.select("k", quality.votes(F.col("text")).alias("v")).collect()}
    assert got == {-1: quality.patterns_of([""])[0], **dict(enumerate(quality.patterns_of(texts)))}


def brute_overlaps(doc, item):
    d, b = (__import__("re").findall(r"[^\W_]+", x.lower()) for x in (doc, item))
    if not b:
        return 0
    w, best = min(15, len(b)), 0
    for i in range(-w, len(d)):
        for j in range(len(b) - w + 1):
            best = max(best, sum(0 <= i + k < len(d) and d[i + k] == b[j + k] for k in range(w)))
    return best


def test_decontamination(spark, docs):
    r = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, 5))
    items = [[word() for _ in range(n)] for n in (40, 15, 25, 6, 3)]
    noise = lambda n: [word() for _ in range(n)]
    sub = list(items[0])
    sub[5], sub[17], sub[30] = "zzz", "yyy", "xxx"
    texts = {1: noise(50) + items[0] + noise(9), 2: noise(5000) + sub + noise(10), 3: items[1], 4: noise(9) + items[2][:20], 5: noise(60), 6: noise(4) + items[3] + noise(4), 7: items[4] + noise(20), 8: items[2][:6] + noise(30), 9: items[0][:13]}
    table = spark.createDataFrame([(k, " ".join(v).upper() if k == 1 else ", ".join(v)) for k, v in texts.items()] + [(10, None), (11, "")], "doc_id long, text string").withColumn("seed", F.lit(1)).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)] + [(9, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = {(d, i) for d, x in texts.items() for i, y in enumerate(items) if 5 * brute_overlaps(" ".join(x), " ".join(y)) >= 4 * min(15, len(y))}
    rows = decontam.overlaps(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert {d for d, _ in want} == {1, 2, 3, 4, 6, 7, 9}
    assert all(r["matched_words"] == brute_overlaps(" ".join(texts[r["doc_id"]]), " ".join(items[r["item_id"]])) for r in rows)
    blocks = decontam.BLOCK_SEEDS
    decontam.BLOCK_SEEDS = 50
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(table, bench).collect()} == want
    finally:
        decontam.BLOCK_SEEDS = blocks
    assert decontam.overlaps(docs, bench).count() == 0 and decontam.overlaps(table, bench.where("false")).count() == 0 and decontam.overlaps(table.where("false"), bench).count() == 0


def test_short_items_are_met_whole(spark):
    """Items of one to four words: every place where all of them stand, and no other."""
    items = {1: "solo", 2: "two words", 3: "three short words", 4: "here are four words", 5: "Solo"}
    texts = ["", "solo", "so lo", "x two words y", "two x words", "three short words here are four", "here are four words", "here are our words", None, "words two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched_words"], r["window_words"]) for r in decontam.overlaps(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {(d, i, len(x.split()), len(x.split())) for d, t in enumerate(texts) for i, x in items.items() if t and f" {x.lower()} " in f" {t} "}
    assert got == want and {i for _, i, *_ in want} == set(items)


def test_masks_hit_every_pattern_of_substitutions():
    for n in range(decontam.LEAST_WORDS, 26):
        w = min(n, decontam.WINDOW)
        places = [{i + k for k, c in enumerate(m) if c == "1"} for m in decontam.FAMILIES[w] for i in range(w - len(m) + 1)]
        assert all(any(p.isdisjoint(s) for p in places) for s in combinations(range(w), w // 5))


def test_decontamination_at_four_fifths(spark):
    """All patterns of the most substitutions for items of 5 to 15 words, random ones for longer items, and one substitution too many."""
    r = np.random.default_rng(5)
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in [*range(5, 16), 20, 25]}
    texts = []
    for n, item in items.items():
        some = [tuple(r.choice(n, n // 5 + e, replace=False)) for e in (0, 1) for _ in range(40)]
        for gone in some + (list(combinations(range(n), n // 5)) if n <= 15 else []):
            texts.append(f"before it {' '.join('other' if k in gone else x for k, x in enumerate(item))} after")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    want = {(d, n): brute_overlaps(t, " ".join(items[n])) for d, t in enumerate(texts) for n in items if f"w{n}x" in t}
    want = {k: v for k, v in want.items() if 5 * v >= 4 * min(15, k[1])}
    assert {(x["doc_id"], x["item_id"]): x["matched_words"] for x in decontam.overlaps(table, bench).collect()} == want
    for n in (5, 9, 15):  # whatever other items there are
        alone = decontam.overlaps(table, bench.where(f"item_id = {n}")).collect()
        assert {(x["doc_id"], x["item_id"]): x["matched_words"] for x in alone} == {k: v for k, v in want.items() if k[1] == n}


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_by_brute_force(spark):
    """A group of variants around one text, most pairs of which lie near the limit, and chains."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(r.choice(vocabulary, 120))
    texts = {i: " ".join(r.choice(vocabulary, int(r.integers(1, 80)))) for i in range(1000, 1060)}
    for i in range(70):
        v = list(base)
        for at in r.integers(0, 120, int(r.integers(0, 9))):
            v[at] = str(r.choice(vocabulary))
        texts[i] = " ".join(v)
    texts |= {2000: texts[3], 2001: texts[3], 2002: "a b", 2003: "a b", 2004: "a b c", 2005: "", 2006: "a"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sizes = brute_components(texts, 3, 85)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(df, k=3, percent=85).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert {i: x["n_shingles"] for i, x in got.items()} == sizes
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got.values())
    wide, _ = brute_components(texts, 5, 80)
    assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df).collect()} == wide


def test_near_duplicates_with_more_blocks_than_documents(spark, monkeypatch):
    r = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, texts = list(r.choice(vocabulary, 120)), {}
    for i in range(24):
        v = list(base)
        for at in r.integers(0, 120, int(r.integers(2, 9))):
            v[at] = str(r.choice(vocabulary))
        texts[i] = " ".join(v)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    calls = spark.sparkContext.accumulator(0)
    links = minhash._block_links

    def counted(percent):
        run = links(percent)

        def wrapped(key, rows):
            if rows["right"].nunique() < 2:
                calls.add(1)
            return run(key, rows)

        return wrapped

    monkeypatch.setattr(minhash, "_block_links", counted)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 64)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df, k=3, percent=85).collect()}
    assert got == brute_components(texts, 3, 85)[0] and calls.value > 0


def test_runs_keep_groups_whole():
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"k": np.sort(r.integers(0, 30, 200)), "j": 0, "v": range(200)})
    for cuts in ([], [50, 51, 120], list(range(1, 200)), [0, 200]):
        parts = [rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 200])]
        got = [part["v"].iloc[a:b].tolist() for part, starts in minhash._runs(iter(parts), ["k", "j"]) for a, b in zip(starts, starts[1:])]
        assert got == [g["v"].tolist() for _, g in rows.groupby("k")]
    assert list(minhash._runs(iter([rows.iloc[:0]]), ["k"])) == []


def test_near_duplicates_edges(docs, none):
    got = minhash.near_duplicates(docs, k=3).collect()
    assert len(got) == docs.count() and minhash.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[0]["component_id"] == 0 and by[0]["n_shingles"] == 0 and by[0]["kept"]
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] is None and by[None]["kept"]


def test_min_and_max_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    a, b = np.unique(minhash._mix(a + 12345)), np.unique(minhash._mix(b + 12345))
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert same == pytest.approx(900 / 1100, abs=0.12)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_components_of_stars_need_no_round(spark, monkeypatch):
    rounds, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or star(edges))
    stars = spark.createDataFrame([(1, 5), (6, 1), (2, 7), (3, 3), (None, 4)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(stars).collect()} == {(1, 1), (5, 1), (6, 1), (2, 2), (7, 2)}
    assert components.connected_components(stars.where("false")).count() == 0 and not rounds
    bent = stars.union(spark.createDataFrame([(5, 2)], "a long, b long"))  # 5 is an end of two edges
    assert {tuple(r) for r in components.connected_components(bent).collect()} == {(k, 1) for k in (1, 2, 5, 6, 7)} and rounds


def test_words_are_hashed_in_parts(monkeypatch):
    words = [w for n in range(3000) for w in (f"wort{n}", chr(0x4E00 + n), "é" * (n % 9 + 1))]
    rows, starts = toxicity.subwords(words)
    tracemalloc.start()
    toxicity.subwords(words * 20)
    assert tracemalloc.get_traced_memory()[1] < 2.5 * 20 * rows.nbytes
    tracemalloc.stop()
    monkeypatch.setattr(toxicity, "WORDS_HASHED", 7)
    again, at = toxicity.subwords(words)
    assert (again == rows).all() and (at == starts).all()


def test_packing(docs, none):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), VOCABULARY).collect()
    pieces, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        pieces.setdefault(r["doc_id"], []).append(r)
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024
    for i, t in enumerate(TEXTS):
        ids, at = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(none, VOCABULARY).count() == 0


ODD_TEXTS = [x or "" for x in TEXTS] + ["a\xa0 b", "<|endoftext|> x", "One. <|endoftext|>Two. Three", "it's 'll", " \n lead", "a\u3000b  c\x1dd\n\n e ", "He said: \"No.\" Then (it was late!) he left.\nEnd", "3.5 a.b. c", "。。 中。 文"]


def sentence_places(text, full):
    """By characters: after a line's end, and after . ! ? and closing marks before white space; in numbers of ids."""
    coded = full.encode(text, add_special_tokens=False)
    ends = {m.end() for m in re.finditer(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\xbb)\]]*(?=\s)|\n", text)}
    return [k + 1 for k, (_, stop) in enumerate(coded.offsets[:-1]) if stop in ends and (k + 1 == len(coded.offsets) or coded.offsets[k + 1][0] >= stop)]


def test_ids_and_places_do_not_depend_on_parts(monkeypatch):
    from tokenizers import Tokenizer

    full, t = Tokenizer.from_file(VOCABULARY), packing.TextTokenizer(VOCABULARY)
    r = np.random.default_rng(8)
    letters = list("ab .!\"'\n\t  3é中)") + ["<|endoftext|>", "\xa0", "’s"]
    texts = ODD_TEXTS + ["".join(r.choice(letters, 60)) for _ in range(200)]
    want = [full.encode(x, add_special_tokens=False).ids for x in texts]
    for most in (packing.TEXT_AT_ONCE, 7, 1):
        monkeypatch.setattr(packing, "TEXT_AT_ONCE", most)
        assert [t.ids(x).tolist() for x in texts] == want
    for x, ids in zip(texts, want):
        flat, n = np.array([*ids, packing.END], np.uint32), len(ids) + 1
        place, penalty = t.cut_places(flat, np.array([n]))
        assert place[-1] == n and penalty[-1] == packing.DOCUMENT_CUT and n - 1 not in place
        if x in ODD_TEXTS[-3:-2] + ["One. <|endoftext|>Two. Three"]:
            assert place[:-1].tolist() == sentence_places(x, full)


def test_places_are_the_same_alone_and_among_others():
    t = packing.TextTokenizer(VOCABULARY)
    texts = ODD_TEXTS + [". ) A.", ")", "\"", "word " * 3000]
    coded = [np.append(t.ids(x), np.uint32(packing.END)) for x in texts]
    ends = np.cumsum([len(x) for x in coded])
    together = list(zip(*(x.tolist() for x in t.cut_places(np.concatenate(coded), ends))))
    alone = [(int(p) + int(e) - len(x), int(q)) for x, e in zip(coded, ends) for p, q in zip(*t.cut_places(x, np.array([len(x)])))]
    assert together == alone
    places = np.array([0] + [p for p, _ in alone])
    assert np.diff(places).max() <= packing.WINDOW
    # inside a sentence there are places only if it is longer than a window
    kinds, gap = np.array([packing.DOCUMENT_CUT] + [q for _, q in alone]), 0
    for step, kind in zip(np.diff(places), kinds[1:]):
        gap += step
        if kind != packing.INNER_CUT:
            assert gap > packing.WINDOW or step == gap
            gap = 0


def test_windows_are_optimal():
    r = np.random.default_rng(6)
    for k in range(60):
        place = np.cumsum(r.integers(1, 9, 40))
        penalty = r.choice([0, 2, 4], len(place))
        planner, cuts = packing.Planner(16), [0]
        for lo in range(0, 40, 1 + k % 7):  # cuts given out on the way are those of the whole plan
            planner.add(place[lo : lo + 1 + k % 7].tolist(), penalty[lo : lo + 1 + k % 7].tolist())
            cuts += planner.certain()
        cuts += planner.rest()
        at = {int(p): int(q) for p, q in zip(place, penalty)}
        best = {0: 0}
        for j in place:
            best[int(j)] = min(best[int(i)] + 16 - int(j - i) + at[int(j)] for i in (0, *place) if 0 < j - i <= 16)
        assert cuts[-1] == place[-1] and all(0 < b - a <= 16 for a, b in zip(cuts, cuts[1:]))
        assert sum(16 - (b - a) + at[b] for a, b in zip(cuts, cuts[1:])) == best[int(place[-1])]


def test_packing_gives_the_same_windows_however_often_it_looks(monkeypatch):
    r, found = np.random.default_rng(9), []
    texts = [" ".join("word " * int(r.integers(1, 40)) + "end." for _ in range(r.integers(1, 30))) for _ in range(400)]
    for commit in (packing.COMMIT, 2000):
        packer, rows = packing._Packer(packing._tokenizer(VOCABULARY), 0), []
        for k in range(0, 400, 5):
            packer.add(texts[k : k + 5], list(range(k, k + 5)))
            if packer.total - packer.done > commit:
                rows += packer.flush(False)
        assert commit > 2000 or len(rows) > 100
        found.append(rows + packer.flush(True))
    assert found[0] == found[1]


@pytest.fixture(scope="module")
def tree():
    return html_extract.fit_tree_model()


def test_extraction_on_held_out_pages(tree):
    wrong = 0
    for source, spans in html_extract.labelled_pages(45, seed=77):
        page, labels = html_extract.node_labels(source, spans)
        wrong += any((p > 0.5) != y for p, y, n in zip(tree.marginals(page, page.features()), labels, page.own) if n)
    assert wrong <= 2


def test_marginals_by_enumeration(tree):
    page = html_extract.Page("<body><nav><a href='/'>x</a></nav><article><p>Some text, really.</p><ul><li>y</ul></article></body>")
    rows, n = page.features(), len(page.tag)
    total, on = 0.0, np.zeros(n)
    for labels in np.ndindex(*[2] * n):
        score = sum(tree.weights[f] for k in range(n) if labels[k] for f in rows[k]) + sum(tree.edges[page.edge_kind(k), labels[page.parent[k]], labels[k]] for k in range(1, n))
        total += np.exp(score)
        on += np.exp(score) * np.array(labels)
    assert tree.marginals(page, rows) == pytest.approx(on / total, abs=1e-9)


def test_extraction(spark, tree):
    page = "<html><head><title>t</title><script>if (a<b) {}</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><!-- x --><article><h1>T &amp; U</h1><p><b>bo</b>ld\n  text, here.<br>more words follow, too.<p>Last one stands here.</article><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "long words here. " * 20_000), (3, "u", "<<<>>> &amp; <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_html", F.lit(1))
    got = html_extract.extract(df, tree).collect()
    assert got[0]["text"] == "T & U bold text, here. more words follow, too. Last one stands here." and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["n_chars"] == len("long words here. ") * 20_000 - 1 and len(got) == 5
    assert html_extract.extract(df.where("false"), tree).count() == 0


BROKEN = ["<a ", '<a "', '<a "> "', "<div>", "<p><b>", "<!-- ", "<ul><li>", "<script>", "<table><tr><td>", "&", "<a ' \" ", "<p class='x ", "</span>", "<b><div></b>"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_pages_take_time_in_proportion(tree, part):
    def seconds(source):
        began = time.process_time()
        html_extract.main_text(source, tree)
        return time.process_time() - began

    for make in (lambda k: part * k, lambda k: "<div>" * k + part * k + "end."):
        small, large = seconds(make(8000)), seconds(make(32000))
        assert large < 8 * small + 0.3  # 4 times in proportion, 16 times for the square


def test_odd_tags():
    text = lambda source: "".join(t or "|" for _, t in html_extract.Page(source).pieces)
    assert text("a <b x='>'>c</b> < d <3 <e") == "a c < d <3 <e"
    assert text('<p title="never closed>x</p>y') == "|x|y" and text("x<!-- a -- b --> y <!doctype z> w <!-- end") == "x y  w "
    assert text("<textarea><p>&lt;</p></textarea>z") == "|<p><</p>|z" and text("<script>if (a<b) '</p>'</script>z") == "||z"
    assert text("a<br>b<hr/>c") == "a|b|c" and text("<") == "<" and text("</") == "</" and text("") == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_every_row(spark, sf, name):
    out = QUERIES[name](spark, sf)
    n = out.count()
    if name[:4] not in ("op2_", "op5_"):
        assert n == spark.read.parquet(f"{sf}/{'pages' if name[:4] in ('op7_', 'op8_') else 'documents'}.parquet").count()
    assert n > 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == first.columns, name
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept < {r[0] for r in docs.select("doc_id").collect()}, name
        docs = docs.where(F.col("doc_id").isin(sorted(kept)))
    assert {r[0] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark, sf, tmp_path):
    """Null and repeated ids, null, empty, long and equal texts, columns of clashing names, and empty tables."""
    import corpus_pipeline

    source = spark.read.parquet(f"{sf}/documents.parquet")
    net = toxicity.fit_toxicity(toxicity.with_labels(source, spark.read.parquet(f"{sf}/labels.parquet"), "toxic"))
    worst = toxicity.score_toxicity(source, net).orderBy(F.desc("score"), "doc_id").first()["doc_id"]
    toxic = source.where(f"doc_id = {worst}").first()["text"]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first()["text"]
    clean = source.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0 and quality = 1"), "doc_id").where("lang = 'en'").first()["text"]
    junk = "$$$ %%% ### !!! " * 40
    rows = [(None, toxic), (None, clean), (9_000_001, toxic), (9_000_001, clean), (9_000_002, None), (9_000_002, ""), (9_000_003, clean), (None, item), (9_000_004, item), (9_000_004, clean), (None, junk), (9_000_005, junk), (9_000_006, LONG), (9_000_003, clean)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], source.schema)
    docs = source.union(odd).select("*", *(F.lit(1).alias(c) for c in ("_gone", "_row_key", "_id", "_text", "_words", "seed", "n", "keys")))
    gone = {"toxicity": (toxic, None), "quality": (junk, None), "decontamination": (item, None)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        left = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()] if name != "packing" else None
        if name in gone:
            assert out.columns == docs.columns and not [x for x in left if x[1] == gone[name][0]], name
            assert left.count((9_000_003, clean)) == 2 and (None, clean) in left and (9_000_001, clean) in left and (9_000_004, clean) in left, name
        if name == "near duplicates":
            assert out.columns == docs.columns and {r["doc_id"] for r in out.where("doc_id is null").collect()} == {None}
            kept = [x for x in left if x[1] == clean and x[0] is not None]
            assert len({x[0] for x in kept}) == 1 and (9_000_002, "") in left and (9_000_002, None) in left
        assert stage(spark, docs.where("false"), sf).count() == 0, name
        if name == "packing":
            assert out.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0
