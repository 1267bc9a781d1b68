"""Tests and models."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v is not None and v == v else float("nan"))


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail by the continued fraction or series of the incomplete gamma function."""

    def tail(x: float, k: float) -> float:
        a, x = k / 2, x / 2
        if x <= 0:
            return 1.0
        front = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return 1 - total * front
        b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    return pd.Series([tail(a, b) for a, b in zip(x, dof, strict=True)])


def z_tests(df: DataFrame, level: str, dead: str, survivor: str) -> DataFrame:
    """Each level's share among dead against its share among survivors, by the pooled z statistic."""
    c = df.groupBy(level).agg(F.sum(F.col(dead).cast("int")).alias("a"), F.sum(F.col(survivor).cast("int")).alias("b"))
    t = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both = c.crossJoin(F.broadcast(t))  # one row
    p = (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb"))
    z = F.try_divide(F.col("a") / F.col("na") - F.col("b") / F.col("nb"), F.sqrt(p * (1 - p) * (1 / F.col("na") + 1 / F.col("nb"))))
    return both.select(level, "a", "b", z.alias("z"))


def step_up(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: significant up to the largest p that is under its rank's share of alpha. For a few rows of tests."""
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(p)))
    m = F.count("*").over(Window.partitionBy())
    passing = ranked.withColumn("_pass", F.when(F.col(p) <= F.col("rank") / m * alpha, F.col(p)))
    return passing.withColumn("significant", F.coalesce(F.col(p) <= F.max("_pass").over(Window.partitionBy()), F.lit(False))).drop("_pass")


def chi_square(df: DataFrame, level: str, dead: str, survivor: str) -> DataFrame:
    """Statistic and degrees of freedom of the levels by dead or survivor."""
    c = df.groupBy(level).agg(F.sum(F.col(dead).cast("int")).alias("a"), F.sum(F.col(survivor).cast("int")).alias("b")).filter("a + b > 0")
    t = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both = c.crossJoin(F.broadcast(t)).withColumn("r", (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb")))
    ea, eb = F.col("r") * F.col("na"), F.col("r") * F.col("nb")
    return both.agg(F.sum((F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb).alias("chi2"), (F.count("*") - 1).alias("dof"))


class Design(NamedTuple):
    """A model: the rows that it is fitted on and its terms, named columns of numbers; an intercept comes first by itself."""

    rows: Column
    terms: list[tuple[str, Column]]


def treatment(df: DataFrame, column: str, base: str | None = None) -> list[tuple[str, Column]]:
    """A 0/1 term for each level of a column of few levels but the base, which is the first in order if none is named."""
    levels = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]  # one row a level
    base = levels[0] if base is None and levels else base
    return [(f"{column}[{v}]", (F.col(column) == v).cast("double")) for v in levels if v != base]


def interaction(left: list[tuple[str, Column]], right: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
    return [(f"{a}:{b}", x * y) for a, x in left for b, y in right]


def top_levels(df: DataFrame, column: str, most: int, other: str = "Other") -> Column:
    """The column with all but its most frequent levels, ties by name, under one name."""
    kept = [r[0] for r in df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most).collect()]
    return F.when(F.col(column).isin(kept), F.col(column)).otherwise(other)


_FITTED = "model string, available boolean, problem string, n long, pseudo_r2 double, term string, coefficient double, std_error double, odds_ratio double, low double, high double, p_value double"
_Z = 1.959963984540054


def _sums(df: DataFrame, label: str, designs: dict[str, Design], betas: dict[str, np.ndarray]) -> dict[str, dict]:
    """Of every model, by one scan: rows, ones, log likelihood, gradient and Gram matrix at its coefficients."""
    y = F.col(label).cast("double")
    columns, sums = [], []
    for k, (name, design) in enumerate(designs.items()):
        x = [F.lit(1.0), *[c.cast("double") for _, c in design.terms]]
        whole = F.coalesce(design.rows, F.lit(False)) & y.isNotNull()
        for c in x[1:]:
            whole = whole & c.isNotNull()
        eta = sum((c * float(b) for c, b in zip(x[1:], betas[name][1:], strict=True)), F.lit(float(betas[name][0])))
        eta = F.least(F.greatest(eta, F.lit(-700.0)), F.lit(700.0))
        columns += [whole.alias(f"in{k}"), (1 / (1 + F.exp(-eta))).alias(f"p{k}"), (y * eta - F.log1p(F.exp(-F.abs(eta))) - F.greatest(eta, F.lit(0.0))).alias(f"l{k}"), *[c.alias(f"x{k}_{i}") for i, c in enumerate(x)]]
        own = lambda c, k=k: F.sum(F.when(F.col(f"in{k}"), c))
        p = F.col(f"p{k}")
        sums += [own(F.lit(1)).alias(f"n{k}"), own(F.col("y")).alias(f"ones{k}"), own(F.col(f"l{k}")).alias(f"ll{k}")]
        sums += [own((F.col("y") - p) * F.col(f"x{k}_{i}")).alias(f"g{k}_{i}") for i in range(len(x))]
        sums += [own(p * (1 - p) * F.col(f"x{k}_{i}") * F.col(f"x{k}_{j}")).alias(f"h{k}_{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    row = df.select(y.alias("y"), *columns).agg(*sums).first()
    out = {}
    for k, (name, design) in enumerate(designs.items()):
        d = len(design.terms) + 1
        gram = np.array([[row[f"h{k}_{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
        out[name] = {"n": row[f"n{k}"] or 0, "ones": row[f"ones{k}"] or 0.0, "ll": row[f"ll{k}"] or 0.0, "gradient": np.array([row[f"g{k}_{i}"] or 0.0 for i in range(d)]), "gram": gram}
    return out


def logit_models(df: DataFrame, label: str, designs: dict[str, Design], stable: tuple[str, ...] = (), steps: int = 100, widest: float = 5.0) -> DataFrame:
    """Logistic models of one label by Newton's method: a row for each term, or one that tells why a model is not available.

    A step is one scan for all models that have not converged. A model needs 30 rows and
    both outcomes. Those named in `stable` are only available if every odds ratio's 95 %
    interval is finite and spans at most e^widest. Rows with a null term are left out.
    """
    betas = {name: np.zeros(len(d.terms) + 1) for name, d in designs.items()}
    problems: dict[str, str] = {}
    last: dict[str, dict] = {}
    live = dict(designs)
    for _ in range(steps):
        if not live:
            break
        for name, s in _sums(df, label, live, betas).items():
            last[name] = s
            if s["n"] < 30 or not 0 < s["ones"] < s["n"]:
                problems[name] = "insufficient variation"
            elif np.linalg.cond(s["gram"]) > 1e14:
                problems[name] = "singular matrix"
            elif np.abs(move := np.linalg.solve(s["gram"], s["gradient"])).max() < 1e-10:
                live = {k: v for k, v in live.items() if k != name}
                continue
            else:
                betas[name] = betas[name] + move
                continue
            live = {k: v for k, v in live.items() if k != name}
    problems |= {name: "no convergence" for name in live}

    rows = []
    for name, design in designs.items():
        s = last[name]
        terms = []
        if name not in problems:
            errors = np.sqrt(np.diag(np.linalg.inv(s["gram"])))
            share = s["ones"] / s["n"]
            r2 = 1 - s["ll"] / (s["n"] * (share * math.log(share) + (1 - share) * math.log(1 - share)))
            for term, b, e in zip(["intercept", *[t for t, _ in design.terms]], betas[name].tolist(), errors.tolist(), strict=True):
                ends = [math.exp(min(b + z * e, 700.0)) for z in (0.0, -_Z, _Z)]
                terms.append((name, True, None, int(s["n"]), r2, term, b, e, *ends, math.erfc(abs(b / e) / math.sqrt(2))))
            wide = any(not 2 * _Z * t[7] <= widest for t in terms if t[5] != "intercept") or len(terms) < 2
            if name in stable and wide:
                problems[name] = "unstable confidence intervals"
        if name in problems:
            terms = [(name, False, problems[name], int(s["n"]), *[None] * 8)]
        rows += terms
    return df.sparkSession.createDataFrame(rows, _FITTED)


def logistic(df: DataFrame, label: str, terms: list[str]) -> DataFrame:
    """Odds ratios with 95 % intervals and p-values of 0/1 or numeric terms, and McFadden's pseudo R2; no rows if the model is not available."""
    fitted = logit_models(df, label, {"model": Design(F.lit(True), [(t, F.col(t)) for t in terms])})
    return fitted.filter("available").select("term", "coefficient", "std_error", "odds_ratio", "low", "high", "p_value", "pseudo_r2")


def death_models(df: DataFrame, died: str, ai: str, funding: str, era: str, category: str, rad: str, group: str, top: int = 8) -> DataFrame:
    """Three models of death: by nativeness, funding, era and category; among native ones by dependency, group, funding and era; and with dependency times funding.

    Rows of an unknown era are left out, categories beyond the most frequent are one. The
    last model is only available with stable intervals.
    """
    known = df.filter(F.col(era) != "unknown")
    rows = known.withColumn("category", top_levels(known, category, top))
    native = F.col(ai) & F.col(rad).isin("RAD-H", "RAD-M", "RAD-L")
    ones = rows.filter(native)
    amount, eras, levels = [("log_funding", F.col(funding))], treatment(rows, era), treatment(ones, rad, "RAD-L")
    return logit_models(rows, died, {
        "model1": Design(F.lit(True), [("ai_native", F.col(ai).cast("double")), *amount, *eras, *treatment(rows, "category")]),
        "model2": Design(native, [*levels, *treatment(ones, group), *amount, *treatment(ones, era)]),
        "model3": Design(native, [*levels, *amount, *interaction(levels, amount), *treatment(ones, era)]),
    }, stable=("model3",))
