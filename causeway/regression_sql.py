"""SQL that states regressions: normal equations as one row of sums, and their solution by sweeping one variable after another."""

from __future__ import annotations


def moments(source: str, cols: list[str], weight: str = "1", by: str = "", last: tuple[str, ...] = ("y",)) -> str:
    """A query with the sums of products a{i}_{j} of ``cols`` and ``last``, and the rows n; one row, or one per ``by``."""
    every = [*cols, *last]
    sums = ", ".join(f"sum({weight} * ({every[i]}) * ({every[j]}))::DOUBLE AS a{i}_{j}" for i in range(len(every)) for j in range(i, len(every)))
    return f"SELECT {by + ', ' if by else ''}count(*) AS n, {sums} FROM {source}" + (f" GROUP BY {by}" if by else "")


def sweep(start: str, k: int, name: str, keep: str = "n", rest: int = 1) -> str:
    """CTEs that sweep the first ``k`` of k + ``rest`` variables of the query ``start``; the last of them is called ``name``.

    Then a{i}_{k} is the coefficient of variable i for variable k, -a{i}_{j} the inverse of the sums of products, and the others are
    sums of products of residuals, a{k}_{k} those of squares.
    """
    a = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    out = [f"{name}_0 AS MATERIALIZED ({start})"]
    for p in range(k):
        new = []
        for i in range(k + rest):
            for j in range(i, k + rest):
                if i == p and j == p:
                    x = f"-1 / {a(p, p)}"
                elif p in (i, j):
                    x = f"{a(i, j)} / {a(p, p)}"
                else:
                    x = f"{a(i, j)} - {a(i, p)} * {a(p, j)} / {a(p, p)}"
                new.append(f"{x} AS a{i}_{j}")
        out.append(f"{name if p == k - 1 else f'{name}_{p + 1}'} AS MATERIALIZED (SELECT {keep}, {', '.join(new)} FROM {name}_{p})")
    return ", ".join(out)


def within(source: str, cols: dict[str, str], by: str = "") -> str:
    """A query of a balanced panel (e, t): each column less its entity's and period's means plus the mean; {column: expression}."""
    key = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"SELECT {key}e, t, y0 - avg(y0) OVER (PARTITION BY {key}e) AS ye, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}e) - avg({c}) OVER (PARTITION BY {key}t) + avg({c}) OVER ({over}) AS {c}" for c in cols) + f" FROM (SELECT {key}e, t, {cols['y']} AS y0, {', '.join(f'{x} AS {c}' for c, x in cols.items())} FROM {source})"


def normal_p(z: str) -> str:
    """Two-sided, by Simpson's rule; an expression over the column ``z``."""
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 12 THEN 0 ELSE greatest(0, 1 - 2 * abs({z}) / 3000 * list_sum([(CASE WHEN i % 1000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * ({z} * i / 1000.0) ** 2) FOR i IN range(0, 1001)]) / sqrt(2 * pi())) END"


def t_p(t: str, v: str) -> str:
    """Two-sided p-value of Student's t with ``v`` degrees of freedom, by Simpson's rule up to 40."""
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN abs({t}) > 40 THEN 0 ELSE greatest(0, 1 - 2 * abs({t}) / 6000 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * list_sum([(CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + ({t} * i / 2000.0) ** 2 / {v}) ** (-({v} + 1) / 2.0) FOR i IN range(0, 2001)])) END"


def newton(source: str, y: str, cols: list[str], name: str, by: str = "", rounds: int = 9, penalty: float = 0.0) -> str:
    """CTEs of a logistic regression of ``y`` on [1, cols] in the CTE ``source``, by group where ``by`` is given; ``name`` has b0, b1, ...

    A step is a weighted regression of (y - p) / (p (1 - p)) with weights p (1 - p). ``penalty`` isn't on the constant.
    """
    k = len(cols) + 1
    b = ", ".join(f"b{i}" for i in range(k))
    key, join = (f"{by}, ", f"JOIN {{0}} USING ({by})") if by else ("", "CROSS JOIN {0}")
    score = " + ".join(["b0", *(f"b{i + 1} * {c}" for i, c in enumerate(cols))])
    out = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT {key}{', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM {source})"]
    for r in range(rounds):
        at = f"(SELECT *, p * (1 - p) AS w, ({y} - p) / (p * (1 - p)) AS z FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM {source} {join.format(f'{name}{r}')}))"
        start = moments(at, ["1", *cols], "w", by, ("z",))
        if penalty:
            own = ", ".join(f"a{i}_{i} + n * {penalty} AS a{i}_{i}, a{i}_{k} - n * {penalty} * b{i} AS a{i}_{k}" for i in range(1, k))
            start = f"SELECT * REPLACE ({own}) FROM ({start}) {join.format(f'{name}{r}')}"
        out.append(sweep(start, k, f"{name}s{r}", f"{key}n"))
        step = ", ".join(f"b{i} + a{i}_{k} AS b{i}" for i in range(k))
        out.append(f"{name if r == rounds - 1 else f'{name}{r + 1}'} AS MATERIALIZED (SELECT {key}{step} FROM {name}{r} {join.format(f'{name}s{r}')})")
    return ", ".join(out)
