"""Near duplicates by min-max hashing.

Of each permutation of a document's shingles both the minimum and the maximum are kept, so that
half as many permutations give a signature of the same length. Bands of the signature make buckets.
In every bucket all members are compared with the smallest one on their full sets. Where a bucket then
still holds more than one component, its members' signatures are compared across the components; what
could be similar by them is compared on full sets, in blocks. Verified links make connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from causeway.llm._common import Scratch, materialise, tidied
from causeway.llm.components import connected_components

BANDS, PER_BAND = 32, 4  # 0.85^4 and 32 bands: a pair of similarity 0.85 is missed once in 10^10, one of 0.8 once in 10^7
PERMUTATIONS = BANDS * PER_BAND // 2
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 19
SIGNED_DOCS = 1024  # signatures that are compared with as many others in one task
CACHE_WORDS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_r = np.random.default_rng(20240229)
_A = _r.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_B = _r.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def clear_cache() -> None:
    """A function of the module, so that it empties the worker's own cache."""
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _D
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``k`` words; with fewer words, of the whole sequence.

    Words are runs of bytes that aren't white space (0x20, 0x09 to 0x0D), with A to Z in lower case.
    """
    if len(_words) > CACHE_WORDS:
        _words.clear()
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACE).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    m = min(k, len(h))
    s = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        s = _mix(s * _C + h[i : len(h) - m + 1 + i])
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, 2): minimum and maximum of each permutation of the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * _A + _B
        np.minimum(low, y.min(axis=0), out=low)
        np.maximum(high, y.max(axis=0), out=high)
    return np.stack([low, high], axis=1)


def agreement(percent: int) -> int:
    """Entries of 2 x PERMUTATIONS in which two signatures agree, for sets of that similarity, but for 10 standard deviations."""
    n, p = 2 * PERMUTATIONS, percent / 100
    return int(n * p - 10 * (n * p * (1 - p)) ** 0.5)


def band_keys(values: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of a signature; two permutations make a band of two minima and two maxima."""
    values = values.astype(np.uint64).reshape(BANDS, PER_BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(PER_BAND):
        key = _mix(key * _C + values[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(_id, n, h1, h2, keys, low) for each row of ``docs`` (_id, _text): size and 128-bit hash of the set, the band
    keys, and the signature's entries cut to a byte each, which can only make more of them agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                s = shingle_set(text, k)
                h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                values = signature(s) if len(s) else None
                rows.append((len(s), h[0], h[1], band_keys(values) if len(s) else None, values.astype(np.uint8).tobytes() if len(s) else None))
            out = pd.DataFrame(rows, columns=["n", "h1", "h2", "keys", "low"])
            out.insert(0, "_id", batch["_id"].array)
            yield out

    return docs.mapInPandas(tidied(run, clear_cache), f"_id {docs.schema['_id'].dataType.simpleString()}, n long, h1 long, h2 long, keys array<long>, low binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["_id"].array, "s": [shingle_set(t, k).tobytes() for t in batch["_text"]]})

    return docs.mapInPandas(tidied(run, clear_cache), f"rep {docs.schema['_id'].dataType.simpleString()}, s binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x size of the intersection >= percent x size of the union, for sorted sets."""
    i = np.intersect1d(a, b, assume_unique=True).size
    return 100 * i >= percent * (a.size + b.size - i)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` that are similar. Hot ends are spread by adaptive skew joins; ``sets`` has each id once."""

    @F.pandas_udf(BooleanType())
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)], dtype=bool)

    left = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    right = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"))
    both = pairs.join(left, "b").join(right, "a")
    sizes = F.octet_length("sa"), F.octet_length("sb")
    return both.where(100 * F.least(*sizes).cast("long") >= percent * F.greatest(*sizes).cast("long")).where(check("sa", "sb")).select("a", "b")


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows of a block pair as (left, right); see _dealt."""
    return rows[~rows["right"]], rows[rows["right"]]


def _dealt(rows: DataFrame, group: str, docs: int, shingles: int | None) -> DataFrame:
    """``rows`` (group, rep, component, n, ...) of groups with several components, dealt into pairs of blocks (group, i, j).

    The left blocks hold all of a group, the right ones all but its largest component, so the bulk of a
    group that is one component by now isn't copied. A block has about ``docs`` rows and ``shingles``
    shingles at most, or is one row. Every pair of different components meets in a pair of blocks (twice
    where neither is of the largest component: once on either side).
    """
    per = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("m"))
    per = per.groupBy(group).agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("mc"), F.max_by("m", F.struct("c", "component")).alias("mm"), F.sum("c").alias("c"), F.sum("m").alias("m"))
    parts = lambda c, m: F.greatest(F.lit(1), F.ceil(c / docs), F.ceil(m / shingles) if shingles else F.lit(1)).cast("int")
    per = per.where("c > mc").select(group, "main", parts(F.col("c"), F.col("m")).alias("is"), parts(F.col("c") - F.col("mc"), F.col("m") - F.col("mm")).alias("js"))
    known = rows.join(per, group)
    own = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.select(*rows.columns, "main", own("i", "is").alias("i"), upto("js").alias("j"), F.lit(False).alias("right"))
    right = known.where("component <> main").select(*rows.columns, "main", upto("is").alias("i"), own("j", "js").alias("j"), F.lit(True).alias("right"))
    # dealt by all three: else Spark takes rows already dealt by group, and one task gets all blocks of a large one
    return left.union(right).repartition(group, "i", "j")


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Batches of rows sorted by ``by``, cut so that no group is in two of them, with the places where groups start and the end."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        new = np.zeros(max(len(batch) - 1, 0), bool)
        for c in by:
            values = batch[c].to_numpy()
            new |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        rest = batch.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield batch, starts
    if rest is not None and len(rest):
        yield rest, [0, len(rest)]


def _promising(percent: int):
    """Of two blocks of a bucket the rows whose signatures agree enough with one of another component."""
    least = agreement(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _runs(batches, ["key", "i", "j"]):
            low = np.frombuffer(b"".join(rows["low"]), np.uint8).reshape(len(rows), -1)
            n, component, right = rows["n"].to_numpy(), pd.factorize(rows["component"])[0], rows["right"].to_numpy(bool)
            found = np.zeros(len(rows), bool)
            for lo, hi in zip(starts, starts[1:]):
                side = right[lo:hi]
                a, every = np.flatnonzero(~side) + lo, np.flatnonzero(side) + lo
                for k in range(0, len(every) if len(a) else 0, 16):
                    b = every[k : k + 16]
                    hit = component[a][:, None] != component[b]
                    hit &= 100 * np.minimum(n[a][:, None], n[b]) >= percent * np.maximum(n[a][:, None], n[b])
                    x, y = np.nonzero(hit)
                    close = (low[a[x]] == low[b[y]]).sum(axis=1) >= least
                    found[a[x[close]]] = found[b[y[close]]] = True
            yield rows.loc[found, ["key", "rep"]].drop_duplicates()

    return run


def _block_links(percent: int):
    """Compares two blocks of one cluster; gives the pairs of components that a similar pair of documents joins.

    Pairs are compared if they share a bucket and their components differ. Intersections are counted by
    products of 0/1 matrices over shingles that occur twice, or one by one where few pairs are left.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(rows)
        ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
        none = pd.DataFrame({"a": ca[:0], "b": cb[:0]})
        if left.empty or right.empty:  # blocks by hash: of few documents with many shingles some have none
            return none
        ka, kb = np.stack(left["keys"].to_list()), np.stack(right["keys"].to_list())
        shared = np.zeros((len(left), len(right)), bool)
        for b in range(BANDS):
            shared |= ka[:, b, None] == kb[None, :, b]
        sa = [np.frombuffer(x, np.uint64) for x in left["s"]]
        sb = [np.frombuffer(x, np.uint64) for x in right["s"]]
        na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
        shared &= ca[:, None] != cb
        shared &= 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
        # two rows outside of the largest component meet on either side
        twice = ~np.isin(ca, left["main"].to_numpy()[:1])[:, None]
        shared &= ~twice | (left["rep"].to_numpy()[:, None] < right["rep"].to_numpy())
        at, to = np.nonzero(shared)
        if not len(at):
            return none
        used_a, used_b = np.unique(at), np.unique(to)
        every, count = np.unique(np.concatenate([sa[x] for x in used_a] + [sb[x] for x in used_b]), return_counts=True)
        every = every[count > 1]
        if len(at) * 40_000 <= len(used_a) * len(used_b) * len(every):
            hit = np.array([similar(sa[x], sb[y], percent) for x, y in zip(at, to)])
        else:
            common = np.zeros((len(used_a), len(used_b)), np.float32)
            for lo in range(0, len(every), 4096):
                part = every[lo : lo + 4096]

                def dense(sets, used):
                    m = np.zeros((len(used), len(part)), np.float32)
                    for r, x in enumerate(used):
                        own = sets[x][np.searchsorted(sets[x], part[0]) : np.searchsorted(sets[x], part[-1], "right")]
                        c = np.searchsorted(part, own)
                        m[r, c[part[c] == own]] = 1
                    return m

                common += dense(sa, used_a) @ dense(sb, used_b).T
            n = common[np.searchsorted(used_a, at), np.searchsorted(used_b, to)].astype(np.int64)
            hit = 100 * n >= percent * (na[at] + nb[to] - n)
        return pd.DataFrame({"a": ca[at[hit]], "b": cb[to[hit]]}).drop_duplicates()

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Rows are linked where 100 x intersection >= ``percent`` x union of their sets of ``k``-word
    shingles. A component is named by its smallest id; ``kept`` is true for that row. Texts without a
    word (null, empty, white space) have no shingle and are linked with nothing. Rows without an id
    are linked with nothing either: their component is null and they are kept. Rows with equal ids
    count as one document with the links of all of them. An empty table gives an empty result;
    further columns are not read. Sets are compared whole, and copies of one set are compared once.
    What is small enough to be broadcast is left to Spark, which knows the sizes of the written tables.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    sig = materialise(signatures(docs, k), "minhash-signatures")
    first = F.min(F.struct("_id", "n", "keys", "low")).alias("r")
    groups = scratch.put(sig.where("n > 0 and _id is not null").groupBy("h1", "h2").agg(first).select("h1", "h2", "r._id", "r.n", "r.keys", "r.low"), "groups")

    entries = groups.select(F.explode("keys").alias("key"), F.col("_id").alias("rep"))
    crowded = scratch.put(entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = scratch.put(entries.join(crowded, "key"), "members")
    pairs = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    ids = scratch.put(members.select("rep").distinct(), "ids")
    texts = docs.join(ids, F.col("_id") == F.col("rep"), "left_semi").dropDuplicates()
    sets = scratch.put(_sets(texts, k), "sets")
    links = scratch.put(_verified(pairs, sets, percent), "links")
    label = scratch.put(connected_components(links, "minhash-labels"), "labels")

    # buckets whose members aren't all joined yet: what of other components could be similar by its signature
    open_ = members.where("size > 2").join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_keys = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    signed = open_.join(open_keys, "key").join(groups.select(F.col("_id").alias("rep"), "n", "low"), "rep").select("key", "rep", "component", "n", "low")
    signed = scratch.put(signed, "open")
    # sorted rows in place of groups: most buckets are small, and every group would cost as much as hundreds of rows
    found = _dealt(signed, "key", SIGNED_DOCS, None).sortWithinPartitions("key", "i", "j").mapInPandas(_promising(percent), f"key long, rep {kind}")
    found = scratch.put(found.distinct(), "promising")

    # clusters of such documents are compared on their sets
    hubs = found.groupBy("key").agg(F.min("rep").alias("a"))
    cluster = connected_components(found.join(hubs, "key").select("a", F.col("rep").alias("b")).distinct(), "minhash-clusters")
    cluster = cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    rows = cluster.join(label, F.col("rep") == F.col("node"), "left").select("cluster", "rep", F.coalesce("component", "rep").alias("component"))
    rows = scratch.put(rows.join(groups.select(F.col("_id").alias("rep"), "n", "keys"), "rep").join(sets, "rep").select("cluster", "rep", "component", "n", "keys", "s"), "clustered")
    more = _dealt(rows, "cluster", BLOCK_DOCS, BLOCK_SHINGLES).groupBy("cluster", "i", "j").applyInPandas(_block_links(percent), f"a {kind}, b {kind}")
    joined = connected_components(scratch.put(more, "more-links"), "minhash-joined")

    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("final"))
    label = label.join(joined, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    extra = joined.select(F.col("component").alias("node"), F.col("final").alias("component"))
    label = label.union(extra).groupBy("node").agg(F.min("component").alias("component"))
    named = groups.select("h1", "h2", "_id").join(label, F.col("_id") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "_id").alias("component_id"))
    named = materialise(named, "minhash-named")
    scratch.drop()
    out = sig.select("_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")))
    out = out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
