"""Per-entity Gram blocks: the one aggregation behind all fixed-effects estimators.

For columns Z = [regressors, time dummies, y], centred and then demeaned within the entity, each entity
contributes Z'Z. The sum over entities gives coefficients and classical errors, the blocks themselves
give clustered errors, leave-one-out and permutation results, all without looking at the panel again.
One shuffle by entity makes them, with sums on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import inverse, normal_p, solve, t_p


@dataclass
class Fit:
    """A least-squares fit with the entity effects absorbed."""

    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    rss: float
    tss: float
    n: int
    entities: int
    rank: int

    @property
    def df(self) -> int:
        return self.n - self.entities - self.rank

    @cached_property
    def covariance(self) -> np.ndarray:
        return self.bread * (self.rss / self.df if self.df > 0 else np.nan)

    def row(self, name: str, covariance: np.ndarray | None = None, df: float | None = None) -> dict:
        k = self.names.index(name)
        v = (self.covariance if covariance is None else covariance)[k, k]
        se = float(np.sqrt(v)) if v >= 0 else float("nan")
        t = float(self.beta[k]) / se if se > 0 else float("nan")
        p = t_p(t, self.df if df is None else df) if se > 0 else float("nan")
        return {"coef": float(self.beta[k]), "se": se, "t": t, "p": p}


class Gram:
    """Blocks of a panel. ``columns`` are the regressors; time effects become dummies of all periods but the first.

    ``keep`` has columns of which an entity's largest value stands beside its block.
    """

    def __init__(self, df: DataFrame, entity: str, time: str | None, outcome: str, columns: dict[str, Column] | list[str], periods: list | None = None, keep: dict[str, Column] | None = None):
        columns = {c: F.col(c) for c in columns} if isinstance(columns, list) else columns
        keep = keep or {}
        used = [F.col(entity).alias("_e"), *([F.col(time).alias("_t")] if time else []), F.col(outcome).cast("double").alias("_y"), *(c.cast("double").alias(f"_x{k}") for k, c in enumerate(columns.values()))]
        rows = df.select(*used, *(c.alias(f"_k_{n}") for n, c in keep.items()))
        # read twice, for the means and for the sums; let go once the blocks are there
        rows = self.rows = rows.dropna(subset=[c for c in rows.columns if not c.startswith("_k_")]).persist()
        self.entity, self.kept = entity, False
        raw = [f"_x{k}" for k in range(len(columns))] + ["_y"]
        # one pass for the periods, which are few, and the means: sums of squares of centred values lose no digits
        means = rows.agg(*(F.avg(c).alias(c) for c in raw), *([F.collect_set("_t").alias("_t")] if time else [])).first()
        self.periods = list(periods) if periods is not None else sorted(means["_t"]) if time else []
        self.names = [*columns, *(f"t={p}" for p in self.periods[1:])]
        self.means = {c: means[r] or 0.0 for c, r in zip(columns, raw)}
        z = [F.col(c) - F.lit(means[c] or 0.0) for c in raw]
        z = z[:-1] + [(F.col("_t") == F.lit(p)).cast("double") for p in self.periods[1:]] + z[-1:]
        self.k = len(z)
        wide = rows.select("_e", *(f"_k_{n}" for n in keep), *(c.alias(f"z{i}") for i, c in enumerate(z)))
        sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(self.k)]
        dummy = range(len(columns), self.k - 1)  # at most one of them is 1, so their products need no sum
        pairs = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        products = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs if not (i in dummy and j in dummy)]
        by = wide.groupBy("_e").agg(F.count(F.lit(1)).alias("n"), *(F.max(f"_k_{n}").alias(n) for n in keep), *sums, *products)
        raw = lambda i, j: F.col(f"s{i}") if i == j in dummy else F.lit(0.0) if i in dummy and j in dummy else F.col(f"p{i}_{j}")
        within = [raw(i, j) - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") for i, j in pairs]
        self.blocks = by.select("_e", "n", *keep, F.array(*within).alias("g"))

    def place(self, i: int, j: int) -> int:
        """Where a block has the product of columns ``i`` and ``j``: the upper triangle, line by line."""
        i, j = min(i, j), max(i, j)
        return i * self.k - i * (i - 1) // 2 + j - i

    def persist(self) -> "Gram":
        self.blocks, self.kept = self.blocks.persist(), True
        return self

    def free(self) -> None:
        """Gives back what is cached; results that were collected stay."""
        self.rows.unpersist()
        if self.kept:
            self.blocks.unpersist()

    def _square(self, upper) -> np.ndarray:
        g = np.zeros((self.k, self.k))
        i = np.triu_indices(self.k)
        g[i] = upper
        return g + g.T - np.diag(np.diag(g))

    @cached_property
    def total(self) -> tuple[np.ndarray, int, int]:
        """(sum of the blocks, rows, entities)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, n, e = 0.0, 0, 0
            for batch in batches:
                if len(batch):
                    g, n, e = g + np.stack(batch["g"].to_list()).sum(axis=0), n + int(batch["n"].sum()), e + len(batch)
            yield pd.DataFrame({"g": [list(g)] if e else [None], "n": [n], "e": [e]})

        parts = self.blocks.select("g", "n").mapInPandas(run, "g array<double>, n long, e long").where("e > 0").collect()  # one row per partition
        if self.kept:
            self.rows.unpersist()
        g = np.sum([p["g"] for p in parts], axis=0) if parts else np.zeros(self.k * (self.k + 1) // 2)
        return self._square(g), sum(p["n"] for p in parts), sum(p["e"] for p in parts)

    def fit(self, use: list[str] | None = None, total: np.ndarray | None = None, n: int | None = None, entities: int | None = None) -> Fit:
        g, n0, e0 = self.total
        g = g if total is None else total
        names = [x for x in self.names if use is None or x in use or x.startswith("t=")]
        at = [self.names.index(x) for x in names]
        xx, xy, yy = g[np.ix_(at, at)], g[at, -1], g[-1, -1]
        beta = solve(xx, xy)
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        rank = int(np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-9, hermitian=True)) if at else 0
        return Fit(names, beta, inverse(xx), float(yy - 2 * beta @ xy + beta @ xx @ beta), float(yy), n0 if n is None else n, e0 if entities is None else entities, rank)

    def clustered(self, fit: Fit) -> tuple[np.ndarray, float]:
        """Covariance clustered by entity, and its degrees of freedom.

        The score of an entity is its block times (1, -beta), so the meat is one more sum over blocks. The
        factor is N/(N-1) x (n-1)/(n-K), with K the slopes.
        """
        at = [self.names.index(x) for x in fit.names]
        weight = np.zeros(self.k)
        weight[at], weight[-1] = -fit.beta, 1.0
        k, triangle = self.k, np.triu_indices(self.k)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            meat = np.zeros((len(at), len(at)))
            for batch in batches:
                if len(batch):
                    g = np.zeros((len(batch), k, k))
                    g[:, triangle[0], triangle[1]] = np.stack(batch["g"].to_list())
                    g[:, triangle[1], triangle[0]] = g[:, triangle[0], triangle[1]]
                    s = (g @ weight)[:, at]
                    meat += s.T @ s
            yield pd.DataFrame({"m": [meat.reshape(-1).tolist()]})

        parts = self.blocks.select("g").mapInPandas(run, "m array<double>").collect()  # one row per partition
        meat = np.sum([p["m"] for p in parts], axis=0).reshape(len(at), len(at))
        n, e = fit.n, fit.entities
        factor = e / (e - 1) * (n - 1) / (n - fit.rank) if e > 1 and n > fit.rank else float("nan")
        return fit.bread @ meat @ fit.bread * factor, e - 1

    def leave_one_out(self, name: str) -> DataFrame:
        """(entity, coef): the coefficient without each entity, from the total less its block; solved many at once."""
        g, _, _ = self.total
        k, at = self.names.index(name), np.triu_indices(self.k)
        scale = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, (1 << 22) // g.size)  # 32 MB of matrices at once
            for batch in batches:
                for lo in range(0, len(batch), step):
                    part = batch.iloc[lo : lo + step]
                    own = np.zeros((len(part), *g.shape))
                    own[:, at[0], at[1]] = np.stack(part["g"].to_list())
                    own[:, at[1], at[0]] = own[:, at[0], at[1]]
                    rest = g - own
                    inverses = np.linalg.pinv(rest[:, :-1, :-1] / np.outer(scale, scale), rcond=1e-11, hermitian=True)
                    yield pd.DataFrame({"entity": part["_e"].array, "coef": (inverses[:, k] * (rest[:, :-1, -1] / scale)).sum(axis=1) / scale[k]})

        kind = self.blocks.schema["_e"].dataType.simpleString()
        return self.blocks.select("_e", "g").mapInPandas(run, f"entity {kind}, coef double")


def wald_f(fit: Fit, names: list[str]) -> tuple[float, int]:
    """F statistic that the named coefficients are all zero, and how many there are."""
    at = [fit.names.index(x) for x in names if x in fit.names]
    if not at:
        return float("nan"), 0
    b, v = fit.beta[at], fit.covariance[np.ix_(at, at)]
    return float(b @ inverse(v) @ b / len(at)), len(at)


@dataclass
class Ols:
    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    rss: float
    tss: float
    n: float

    @property
    def df(self) -> float:
        return self.n - len(self.names)

    @property
    def covariance(self) -> np.ndarray:
        return self.bread * (self.rss / self.df if self.df > 0 else np.nan)

    def row(self, name: str, normal: bool = False) -> dict:
        k = self.names.index(name)
        se = float(np.sqrt(max(self.covariance[k, k], 0)))
        t = float(self.beta[k]) / se if se > 0 else float("nan")
        return {"coef": float(self.beta[k]), "se": se, "t": t, "p": normal_p(t) if normal else t_p(t, self.df)}


class Moments:
    """Weighted sums of products of [1, columns], with the columns centred on their means.

    Centring keeps the digits of columns with large means; only the constant depends on it, and it is
    moved back in ``ols``.
    """

    def __init__(self, df: DataFrame, columns: dict[str, Column], weight: Column | None = None):
        w = F.lit(1.0) if weight is None else weight
        rows = df.select(w.alias("_w"), *(c.cast("double").alias(f"c{k}") for k, c in enumerate(columns.values()))).dropna().where("_w > 0")
        raw = [f"c{k}" for k in range(len(columns))]
        means = rows.agg(*(F.avg(c).alias(c) for c in raw)).first() if raw else {}
        self.means = np.array([0.0, *(means[c] or 0.0 for c in raw)])
        cols = [F.lit(1.0), *(F.col(c) - F.lit(means[c] or 0.0) for c in raw)]
        m = len(cols)
        r = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("_w") * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(m) for j in range(i, m))).first()
        g = np.zeros((m, m))
        g[np.triu_indices(m)] = [x or 0.0 for x in r[1:]]
        self.g, self.names, self.n = g + g.T - np.diag(np.diag(g)), ["const", *columns], int(r["n"])

    def at(self, names: list[str]) -> list[int]:
        return [self.names.index(x) for x in names]

    def ols(self, y: str, xs: list[str]) -> Ols:
        """``y`` on ``xs``, of which the first is the constant."""
        g, at, k = self.g, self.at(xs), self.names.index(y)
        xx, xy = g[np.ix_(at, at)], g[at, k]
        beta, bread = solve(xx, xy), inverse(xx)
        rss = float(g[k, k] - 2 * beta @ xy + beta @ xx @ beta)
        total = g[k, k] - g[0, k] ** 2 / g[0, 0] if g[0, 0] else 0.0
        back = np.eye(len(at))
        back[0, 1:] = -self.means[at[1:]]
        beta = back @ beta
        beta[0] += self.means[k]
        return Ols(xs, beta, back @ bread @ back.T, rss, float(total), self.n)


def ols(df: DataFrame, y: Column, xs: dict[str, Column], weight: Column | None = None) -> Ols:
    """Weighted least squares with a constant, from an aggregation for the means and one for the products."""
    return Moments(df, {**xs, "_y": y}, weight).ols("_y", ["const", *xs])


def logit(df: DataFrame, y: str, xs: list[str], penalty: float = 0.0, rounds: int = 30) -> np.ndarray:
    """Coefficients [constant, xs] of a logistic regression by Newton's method, one aggregation a round.

    ``penalty`` is half the weight of the squared coefficients (without the constant) against the mean of the
    log-likelihood. Rows with a null are left out. Only k x k sums reach the driver.
    """
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    k, b = len(cols), np.zeros(len(cols))
    rows = df.select(F.col(y).cast("double").alias("_y"), *(c.alias(f"z{i}") for i, c in enumerate(cols))).dropna()
    z = [F.col(f"z{i}") for i in range(k)]
    ridge = np.diag([0.0, *[penalty] * (k - 1)]) + 1e-12 * np.eye(k)
    for _ in range(rounds):
        score = sum((F.lit(float(v)) * c for v, c in zip(b, z)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0))))
        at = rows.withColumn("_p", p).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        sums = [F.sum(F.col("_w") * z[i] * z[j]) for i in range(k) for j in range(i, k)] + [F.sum((F.col("_y") - F.col("_p")) * c) for c in z]
        r = at.agg(F.count(F.lit(1)), *sums).first()
        n, values = r[0], np.array([x or 0.0 for x in r[1:]])
        if not n:
            return b
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = values[:-k] / n
        h = h + h.T - np.diag(np.diag(h)) + ridge
        step = np.linalg.solve(h, values[-k:] / n - ridge @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return b
