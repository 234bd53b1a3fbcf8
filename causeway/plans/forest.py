"""Causal forest: honest trees that split where effects differ, grown level by level from sums.

Outcome and treatment are first taken less what linear models fitted on the other fold make of the features (ry, rt).
A level of all trees is one aggregation: for each node, feature and bin the number of rows and the sums of rt, ry,
rt^2 and rt ry. Where the bins of all features make few cells, one aggregation by cell is enough for all levels. A node is cut where the effects of its two sides, slopes of ry on rt, differ most for the information
they have. Effects of leaves come from rows that had no say in the cuts. What reaches the driver is of the trees' size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.ranges import exact_quantiles
from causeway.plans.gram import Moments

BINS = 32
MOST_CELLS = 2048  # of the bins of all features together, where a tree is grown on sums by cell
LITTLE = 2  # trees that share a half of the rows; the spread between such groups gives the error
SUMS = ["n", "t", "y", "tt", "ty"]
CUT, ESTIMATE = 1, 2


@dataclass
class Forest:
    """Trees as heaps: the children of node k are 2k + 1 (code up to ``cut``) and 2k + 2; leaves have feature -1."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    effect: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins of a row's features; a value on an edge belongs below it."""
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def nodes(self, tree: int, codes: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        """Each row's node at the root, and after each of ``depth`` steps down; a row stays in its leaf."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        yield node
        for _ in range(depth):
            f = self.feature[tree, node]
            right = codes[rows, np.maximum(f, 0)] > self.cut[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
            yield node


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Evenly spread 64-bit numbers of ids' hashes."""
    z = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def in_half(h: np.ndarray, tree: int) -> np.ndarray:
    """Whether rows are in the half that the tree's group was given."""
    return _mixed(h, tree // LITTLE + 1) >> np.uint64(63) == 1


def roles(h: np.ndarray, tree: int) -> np.ndarray:
    """CUT or ESTIMATE for the rows that the tree uses, else 0."""
    first = _mixed(h, tree + 1_000_003) >> np.uint64(63) == 1
    return np.where(in_half(h, tree), np.where(first, CUT, ESTIMATE), 0)


def offered(tree: int, node: int, features: int) -> np.ndarray:
    """Features that may cut a node: two thirds of them, one at least, by a hash of tree and node."""
    drawn = _mixed(np.arange(features, dtype=np.uint64) + np.uint64((tree << 20) + node << 10), 77)
    return np.sort(np.argsort(drawn, kind="stable")[: max(1, -(-2 * features // 3))])


def _slope(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(effect, information) of sums (..., SUMS): slope of y on t, and the centred squares of t."""
    n, t, y, tt, ty = np.moveaxis(s, -1, 0)
    n = np.maximum(n, 1)
    info = tt - t * t / n
    return (ty - t * y / n) / np.where(info > 1e-12, info, np.nan), info


def best_cut(sums: np.ndarray, allowed: np.ndarray, least: int) -> tuple[int, int]:
    """(feature, code) of the cut with the largest difference of effects, of a node's sums (features, bins, SUMS); (-1, 0) if none.

    Either side needs ``least`` rows. Of equal gains the first feature and code are taken.
    """
    left = np.cumsum(sums[allowed], axis=1)[:, :-1]
    right = sums[allowed].sum(axis=1)[:, None] - left
    (a, ja), (b, jb) = _slope(left), _slope(right)
    gain = (a - b) ** 2 * ja * jb / np.maximum(ja + jb, 1e-300)
    gain = np.where((left[..., 0] >= least) & (right[..., 0] >= least) & np.isfinite(gain), gain, -1)
    if not gain.size or gain.max() <= 0:
        return -1, 0
    k = int(np.argmax(gain > gain.max() * (1 - 1e-9)))
    return int(allowed[k // gain.shape[1]]), k % gain.shape[1]


def _sums_of(keys: np.ndarray, size: int, columns: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount(keys, minlength=size).astype(float), *(np.bincount(keys, c, size) for c in columns)], axis=1)


def residuals(df: DataFrame, y: str, treatment: str, features: list[str], unit: str, seed: int) -> DataFrame:
    """(_h, _ry, _rt, features as doubles): less linear models fitted on the other half of the units."""
    rows = df.select(F.xxhash64(unit, F.lit(seed)).alias("_h"), F.col(y).cast("double").alias("_y"), F.col(treatment).cast("double").alias("_t"), *(F.col(c).cast("double").alias(f"_f{j}") for j, c in enumerate(features))).dropna()
    fold = F.pmod(F.col("_h"), F.lit(2))
    names = [f"_f{j}" for j in range(len(features))]
    of = {"_y": F.lit(0.0), "_t": F.lit(0.0)}
    for k in (0, 1):
        m = Moments(rows.where(fold != k), {c: F.col(c) for c in (*names, "_y", "_t")})
        for c in of:
            beta = m.ols(c, ["const", *names]).beta
            of[c] = F.when(fold == k, sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta[1:], names)), F.lit(float(beta[0])))).otherwise(of[c])
    return rows.select("_h", (F.col("_y") - of["_y"]).alias("_ry"), (F.col("_t") - of["_t"]).alias("_rt"), *names)


def _node_effects(sums: np.ndarray, least: int) -> np.ndarray:
    """Effects of the nodes of each tree; where too few rows are left, the parent's."""
    slope, info = _slope(sums)
    good, effect = (sums[..., 0] >= least) & (info > 1e-12), np.zeros(sums.shape[:2])
    for node in range(sums.shape[1]):
        effect[:, node] = np.where(good[:, node], slope[:, node], effect[:, (node - 1) // 2] if node else 0.0)
    return effect


def _cell_of(codes: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of the cell that a row's codes make."""
    return np.ravel_multi_index(tuple(codes.T), [len(e) + 1 for e in edges])


def _cells(edges: list[np.ndarray]) -> np.ndarray:
    """The codes of each cell."""
    shape = [len(e) + 1 for e in edges]
    return np.stack(np.unravel_index(np.arange(int(np.prod(shape))), shape), axis=1)


def _grown_on_cells(rows: DataFrame, forest: Forest, depth: int, least: int) -> Forest:
    """The same forest where the bins of all features make few cells: rows are read once, for sums by tree, role and cell.

    A group is a tree with its cells, of which all its cuts and effects follow.
    """
    trees, size = forest.feature.shape
    features, codes = len(forest.edges), _cells(forest.edges)
    names = [f"_f{j}" for j in range(features)]
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cells = shared.value, len(codes)
        total = np.zeros((trees, 2 * cells, len(SUMS)))
        for batch in batches:
            h, rt, ry = batch["_h"].to_numpy().astype(np.uint64), batch["_rt"].to_numpy(), batch["_ry"].to_numpy()
            cell, values = _cell_of(model.codes(batch[names].to_numpy(float)), model.edges), np.stack([rt, ry, rt * rt, rt * ry], axis=1)
            for start in range(0, trees, LITTLE):
                half = np.flatnonzero(in_half(h, start))  # the same for all trees of a group
                own, at, v = h[half], cell[half], list(values[half].T.copy())
                for tree in range(start, min(start + LITTLE, trees)):
                    cut = _mixed(own, tree + 1_000_003) >> np.uint64(63) == 1
                    total[tree] += _sums_of(at + cells * ~cut, 2 * cells, v)
        some = np.argwhere(total[..., 0] > 0)
        yield pd.DataFrame({"tree": some[:, 0], "cell": some[:, 1], **{s: total[some[:, 0], some[:, 1], k] for k, s in enumerate(SUMS)}})

    def one_tree(own: pd.DataFrame) -> pd.DataFrame:
        tree, cells = int(own["tree"].iat[0]), len(codes)
        total = np.zeros((2 * cells, len(SUMS)))
        total[own["cell"]] = own[SUMS]
        cutting, estimating = total[:cells], total[cells:]
        feature, cut, node = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(cells, np.int64)
        reached = np.zeros((size, len(SUMS)))
        np.add.at(reached, node, estimating)
        for level in range(depth):
            for k in np.unique(node[(node >= 2**level - 1) & (cutting[:, 0] > 0)]):
                at = node == k
                by = np.zeros((features, BINS, len(SUMS)))
                for j in range(features):
                    np.add.at(by[j], codes[at, j], cutting[at])
                feature[k], cut[k] = best_cut(by, offered(tree, int(k), features), least)
            f = feature[node]
            down = f >= 0
            node = np.where(down, 2 * node + 1 + (codes[np.arange(cells), np.maximum(f, 0)] > cut[node]), node)
            np.add.at(reached, node[down], estimating[down])
        out = pd.DataFrame({"tree": tree, "node": np.arange(size), "feature": feature, "cut": cut})
        for k, s in enumerate(SUMS):
            out[s] = reached[:, k]
        return out

    listed = ", ".join(f"{s} double" for s in SUMS)
    by = rows.mapInPandas(sums, f"tree int, cell int, {listed}").groupBy("tree", "cell").agg(*(F.sum(s).alias(s) for s in SUMS))
    at_node = np.zeros((trees, size, len(SUMS)))
    for r in by.groupBy("tree").applyInPandas(one_tree, f"tree int, node int, feature int, cut int, {listed}").collect():  # of the trees' size
        forest.feature[r["tree"], r["node"]], forest.cut[r["tree"], r["node"]] = r["feature"], r["cut"]
        at_node[r["tree"], r["node"]] = r[4:]
    shared.unpersist()
    forest.effect[:] = _node_effects(at_node, least)
    return forest


def grow(rows: DataFrame, features: int, trees: int, depth: int, least: int) -> Forest:
    """A forest on the rows of ``residuals``, which are read once a level."""
    names, size = [f"_f{j}" for j in range(features)], 2 ** (depth + 1) - 1
    q = exact_quantiles(rows, {c: [k / BINS for k in range(1, BINS)] for c in names})
    forest = Forest([np.unique(np.array([v for v in q[(c,)] if v is not None], float)) for c in names], np.full((trees, size), -1, np.int32), np.zeros((trees, size), np.int32), np.zeros((trees, size)))
    if np.prod([len(e) + 1.0 for e in forest.edges]) <= MOST_CELLS:
        return _grown_on_cells(rows, forest, depth, least)
    context = rows.sparkSession.sparkContext

    def parts(batch: pd.DataFrame, model: Forest):
        h, rt, ry = batch["_h"].to_numpy().astype(np.uint64), batch["_rt"].to_numpy(), batch["_ry"].to_numpy()
        return h, [rt, ry, rt * rt, rt * ry], model.codes(batch[names].to_numpy(float))

    for level in range(depth):
        shared, first, width = context.broadcast(forest), 2**level - 1, 2**level

        def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            total = np.zeros((trees, features, width * BINS, len(SUMS)))
            for batch in batches:
                h, values, codes = parts(batch, model)
                for tree in range(trees):
                    *_, node = model.nodes(tree, codes, level)
                    own = np.flatnonzero((roles(h, tree) == CUT) & (node >= first))  # rows above are in leaves
                    for j in range(features):
                        total[tree, j] += _sums_of((node[own] - first) * BINS + codes[own, j], width * BINS, [v[own] for v in values])
            some = np.argwhere(total[..., 0] > 0)
            out = pd.DataFrame({"tree": some[:, 0], "feature": some[:, 1], "node": some[:, 2] // BINS + first, "code": some[:, 2] % BINS})
            for k, s in enumerate(SUMS):
                out[s] = total[some[:, 0], some[:, 1], some[:, 2], k]
            yield out

        def choose(cells: pd.DataFrame) -> pd.DataFrame:
            out, tree = [], int(cells["tree"].iat[0])
            for node, own in cells.groupby("node"):
                sums = np.zeros((features, BINS, len(SUMS)))
                sums[own["feature"], own["code"]] = own[SUMS]
                f, c = best_cut(sums, offered(tree, int(node), features), least)
                if f >= 0:
                    out.append((tree, int(node), f, c))
            return pd.DataFrame(out, columns=["tree", "node", "feature", "cut"])

        schema = "tree int, feature int, node int, code int, " + ", ".join(f"{s} double" for s in SUMS)
        cells = rows.mapInPandas(histograms, schema).groupBy("tree", "feature", "node", "code").agg(*(F.sum(s).alias(s) for s in SUMS))
        found = cells.groupBy("tree").applyInPandas(choose, "tree int, node int, feature int, cut int").collect()  # a group is a tree's histograms
        shared.unpersist()
        for r in found:
            forest.feature[r["tree"], r["node"]], forest.cut[r["tree"], r["node"]] = r["feature"], r["cut"]
        if not found:
            break
    shared = context.broadcast(forest)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        total = np.zeros((trees, size, len(SUMS)))
        for batch in batches:
            h, values, codes = parts(batch, model)
            for tree in range(trees):
                own, last = roles(h, tree) == ESTIMATE, None
                for node in model.nodes(tree, codes, depth):
                    new = np.flatnonzero(own if last is None else own & (node != last))
                    total[tree] += _sums_of(node[new], size, [v[new] for v in values])
                    last = node
        some = np.argwhere(total[..., 0] > 0)
        yield pd.DataFrame({"tree": some[:, 0], "node": some[:, 1], **{s: total[some[:, 0], some[:, 1], k] for k, s in enumerate(SUMS)}})

    sums = np.zeros((trees, size, len(SUMS)))
    for r in rows.mapInPandas(leaves, "tree int, node int, " + ", ".join(f"{s} double" for s in SUMS)).groupBy("tree", "node").agg(*(F.sum(s).alias(s) for s in SUMS)).collect():
        sums[r["tree"], r["node"]] = r[2:]
    shared.unpersist()
    forest.effect[:] = _node_effects(sums, least)
    return forest


def with_effects(df: DataFrame, forest: Forest, features: list[str], unit: str, seed: int) -> DataFrame:
    """``df`` with ``cate`` and ``cate_se``: the trees' mean effect, of those whose half the row isn't in, if any, and its error.

    The error is the spread of the means of groups of trees, less what trees of one group differ by.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest)
    trees, depth = forest.feature.shape[0], (forest.feature.shape[1] + 1).bit_length() - 2
    of = F.struct(F.xxhash64(unit, F.lit(seed)).alias("h"), *(F.col(c).cast("double").alias(f"f{j}") for j, c in enumerate(features)))

    groups = [slice(k, k + LITTLE) for k in range(0, trees, LITTLE)]

    def told(model: Forest, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows with these codes: sums of the effects by group of trees, their mean and its error."""
        each = np.zeros((len(codes), trees))
        for tree in range(trees):
            *_, node = model.nodes(tree, codes, depth)
            each[:, tree] = model.effect[tree, node]
        means = np.stack([each[:, g].mean(axis=1) for g in groups], axis=1)
        inside = np.stack([each[:, g].var(axis=1) for g in groups], axis=1).mean(axis=1) / LITTLE
        return np.stack([each[:, g].sum(axis=1) for g in groups], axis=1), each.mean(axis=1), np.sqrt(np.maximum(means.var(axis=1) - inside, 0))

    few = np.prod([len(e) + 1.0 for e in forest.edges]) <= MOST_CELLS

    @F.pandas_udf("cate double, cate_se double")
    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        table = told(model, _cells(model.edges)) if few else None  # rows of one cell differ only in the trees that they are in
        size = np.array([min(g.stop, trees) - g.start for g in groups], float)
        for batch in batches:
            h, codes = batch["h"].to_numpy().astype(np.uint64), model.codes(batch.iloc[:, 1:].to_numpy(float))
            own, (sums, mean, error) = (_cell_of(codes, model.edges), table) if few else (np.arange(len(h)), told(model, codes))
            total, count = np.zeros(len(h)), np.zeros(len(h))
            for k, g in enumerate(groups):
                out = ~in_half(h, g.start)
                total += sums[own, k] * out
                count += size[k] * out
            yield pd.DataFrame({"cate": np.where(count > 0, total / np.maximum(count, 1), mean[own]), "cate_se": error[own]})

    return df.withColumn("_effects", effects(of)).select(*df.columns, "_effects.*")


def causal_forest(df: DataFrame, y: str, treatment: str, features: list[str], unit: str, trees: int = 50, depth: int = 6, least: int = 20, seed: int = 42) -> DataFrame:
    """Rows of ``df`` without a null in outcome, treatment and features, with ``cate`` and ``cate_se``.

    With no row, or a treatment that doesn't vary, effects are 0. Every choice is a hash of the unit's id, so that tasks that are run again agree.
    """
    rows = df.dropna(subset=[y, treatment, *features])
    x = residuals(rows, y, treatment, features, unit, seed).persist()
    forest = grow(x, len(features), trees, depth, least)
    x.unpersist()
    return with_effects(rows, forest, features, unit, seed)
