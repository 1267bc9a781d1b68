"""Audits of request logs against sliding limits, and replays of sequential controllers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.folds import folded, smoothing
from attestry.operators.ranks import summed_before


def utilisation(df: DataFrame, ts: str, tokens: str, rpm: int, tpm: int, *by: str, seconds: int = 60) -> DataFrame:
    """Requests and tokens of the trailing window at each request, as shares of their limits, and the larger share."""
    marked = df.withColumn("_second", F.unix_seconds(F.col(ts).cast("timestamp")))
    counted = trailing(marked, "_second", seconds, {"_calls": F.count("*"), "_tokens": F.sum(tokens)}, *by)
    shares = counted.withColumn("rpm_share", F.col("_calls") / rpm).withColumn("tpm_share", F.col("_tokens") / tpm).withColumn("utilisation", F.greatest("rpm_share", "tpm_share"))
    return shares.drop("_second", "_calls", "_tokens")


def trailing(df: DataFrame, second: str, seconds: int, sums: dict[str, Column], *by: str, windows: int = 4) -> DataFrame:
    """`df` with aggregates over the rows of the last `seconds` seconds up to each row's own, of the same `by`.

    Time is cut into spells of a few windows. A row in the last window's length of a
    spell is copied to the next one, where it counts but is no result, so that a spell is
    worked out by itself and a group of any size is spread over as many tasks as it has
    spells. Rows of a null time have null aggregates.
    """
    spell = seconds * windows
    own = F.floor(F.col(second) / spell)
    late = F.pmod(F.col(second), F.lit(spell)) >= spell - (seconds - 1)
    spells = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    copied = df.filter(F.col(second).isNotNull()).select("*", own.alias("_own"), F.explode(spells).alias("_spell"))
    w = Window.partitionBy(*by, "_spell").orderBy(second).rangeBetween(-(seconds - 1), 0)
    found = copied.withColumns({name: c.over(w) for name, c in sums.items()}).filter(F.col("_own") == F.col("_spell")).drop("_own", "_spell")
    rest = df.filter(F.col(second).isNull()).withColumns({name: F.lit(None) for name in sums})
    return found.unionByName(rest)


def adaptive_concurrency(df: DataFrame, key: str, line: str, outcome: str, start: int = 128, most: int = 1024) -> DataFrame:
    """Concurrency after every call: a sixteenth more for 32 healthy calls, half on a rate limit, four fifths on a passing error."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        limit, healthy, out = float(start), 0, []
        for o in pdf.sort_values(line)[outcome]:
            if o == "ok":
                healthy += 1
                if healthy >= 32:
                    limit, healthy = min(most, limit * 1.0625), 0
            elif o == "rate_limited":
                limit, healthy = max(1.0, limit * 0.5), 0
            elif o == "transient":
                limit, healthy = max(1.0, limit * 0.8), 0
            out.append(int(limit))
        return pd.DataFrame({key: k[0], "calls": [len(out)], "last_limit": [out[-1]], "least_limit": [min(out)]})

    return df.select(key, line, outcome).groupBy(key).applyInPandas(run, f"{key} long, calls long, last_limit long, least_limit long")


def smoothed(df: DataFrame, key: str, line: str, value: str, alpha: float = 0.2, **sizes: int) -> DataFrame:
    """Exponentially weighted mean after each key's last row; a key of any size, its runs of rows as affine steps."""
    return folded(df, key, line, [value], smoothing(value, alpha), **sizes).select(key, "state.n", F.col("state.mean").alias("ewma"))


def credit_gate(df: DataFrame, line: str, credits: str, budget: float) -> DataFrame:
    """Rows of a run's whole log that were started: none from the first at which the credits spent and the mean of a row no longer fit the budget."""
    spent = summed_before(df, line, F.col(credits), "_place", "_spent")
    mean = F.coalesce(F.try_divide(F.col("_spent"), F.col("_place")), F.lit(0))
    stop = spent.filter(F.col("_spent") + mean > budget).agg(F.min("_place").alias("_stop"))  # one row
    return spent.join(F.broadcast(stop), F.lit(True)).filter(F.col("_stop").isNull() | (F.col("_place") < F.col("_stop"))).drop("_place", "_spent", "_stop")


def budget_stop(df: DataFrame, line: str, cost: str, budget: float, *by: str) -> DataFrame:
    """Rows of a replay that ran before the next would have overrun: spent so far and the mean row fit the budget."""
    w = Window.partitionBy(*by).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    spent, mean = F.coalesce(F.sum(cost).over(w), F.lit(0.0)), F.coalesce(F.avg(cost).over(w), F.lit(0.0))
    whole = Window.partitionBy(*by).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_over", (spent + mean > budget).cast("int")).withColumn("_stop", F.max("_over").over(whole)).filter("_stop = 0").drop("_over", "_stop")
