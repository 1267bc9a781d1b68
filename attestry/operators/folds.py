"""Folds over each key's rows in order, where a key may hold any share of the rows.

A key of few rows is folded in one group. A key of more is cut into runs of neighbouring
rows; what a run does to whatever comes before it is a function, functions of runs are
composed in order, a bounded number in a group and level by level, and the last one is
applied to the start. So no group holds more than a bounded number of rows or functions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are folded in one group, rows of a run of a larger key, functions composed in one group.
FEW, RUN, TOGETHER = 20_000, 4_096, 256


class Fold(NamedTuple):
    """A fold and its functions, all as columns.

    `step(state, row)` is the next state. `extend(function, row)` is the function that
    does the row's step last, `then(f, g)` that which does f and then g, `apply(f)` its
    state from the start. Types are those of `start` and `identity`.
    """

    start: Column
    step: Callable[[Column, Column], Column]
    identity: Column
    extend: Callable[[Column, Column], Column]
    then: Callable[[Column, Column], Column]
    apply: Callable[[Column], Column]


def _in_order(rows: Column) -> Column:
    return F.sort_array(F.collect_list(rows))


def folded(df: DataFrame, key: str, line: str, columns: list[str], fold: Fold, few: int | None = None, run: int | None = None, together: int | None = None) -> DataFrame:
    """(key, state): each key's state after all its rows, in the order of `line`, a position that no two rows share.

    Rows with a null position are left out; a null key is a key of its own.
    """
    few, run, together = few or FEW, run or RUN, together or TOGETHER
    rows = df.filter(F.col(line).isNotNull()).select(F.col(key), F.struct(F.col(line).cast("long").alias("line"), *[F.col(c) for c in columns]).alias("row"))
    many = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min("row.line").alias("_first"), F.max("row.line").alias("_last")).filter(F.col("_n") > few)
    span = many.agg(F.max(F.col("_last") - F.col("_first"))).first()[0]
    if span is None:
        return rows.groupBy(key).agg(F.aggregate(_in_order(F.col("row")), fold.start, fold.step).alias("state"))

    marked = rows.join(many.select("_key", "_first"), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_hot", F.col("_first").isNotNull())
    small = marked.filter(~F.col("_hot")).groupBy(key).agg(F.aggregate(_in_order(F.col("row")), fold.start, fold.step).alias("state"))
    place = F.floor((F.col("row.line") - F.col("_first")) / run)
    functions = marked.filter("_hot").groupBy(key, place.alias("_at")).agg(F.aggregate(_in_order(F.col("row")), fold.identity, fold.extend).alias("_f"))
    places = span // run + 1
    while places > 1:
        ordered = F.transform(_in_order(F.struct("_at", "_f")), lambda x: x["_f"])
        composed = F.aggregate(F.slice(ordered, 2, together), F.element_at(ordered, 1), fold.then)
        functions = functions.groupBy(key, F.floor(F.col("_at") / together).alias("_up")).agg(composed.alias("_f")).withColumnRenamed("_up", "_at")
        places = -(-places // together)
    return small.unionByName(functions.select(key, fold.apply(F.col("_f")).alias("state")))


def smoothing(value: str, alpha: float) -> Fold:
    """The exponentially weighted mean: each value moves it by `alpha` of the distance; the first one sets it, null ones do nothing.

    A function takes a mean x to a * x + b and no mean to `fresh`.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"))

    def step(s: Column, r: Column) -> Column:
        v = r[value].cast("double")
        return F.struct((s["n"] + 1).alias("n"), F.coalesce(s["mean"] + alpha * (v - s["mean"]), v, s["mean"]).alias("mean"))

    identity = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("fresh"))

    def extend(f: Column, r: Column) -> Column:
        v = r[value].cast("double")
        moved = lambda old, new: F.coalesce(new, old)
        return F.struct((f["n"] + 1).alias("n"), moved(f["a"], F.when(v.isNotNull(), f["a"] * (1 - alpha))).alias("a"), moved(f["b"], f["b"] + alpha * (v - f["b"])).alias("b"), F.coalesce(f["fresh"] + alpha * (v - f["fresh"]), v, f["fresh"]).alias("fresh"))

    def then(f: Column, g: Column) -> Column:
        return F.struct((f["n"] + g["n"]).alias("n"), (f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), F.coalesce(g["a"] * f["fresh"] + g["b"], g["fresh"]).alias("fresh"))

    return Fold(start, step, identity, extend, then, lambda f: F.struct(f["n"].alias("n"), f["fresh"].alias("mean")))
