"""Exact quantiles by counting, without a buffer of a group's values.

Each group's wanted ranks lie between two of its values. A round counts the values
between them in bins, first by their power of two and then by equal parts, keeps the bin that
holds the rank and goes on between that bin's least and greatest value, until these are
equal: seven rounds at most for 1,024 bins. A round is one scan, its counts are
combined before they are shuffled, and what goes on is a table of one row a group and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.ranks import checkpointed

#: Bins of one interval and round.
BINS = 1024


def _scale(v: Column) -> Column:
    """A whole number that grows with the sign and the power of two of a value."""
    power = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    return F.when(v == float("inf"), 9999).when(v == -float("inf"), -9999).when(v == 0, 0).when(v > 0, power).otherwise(-power)


def _bin(bins: int, v: Column, low: Column, high: Column) -> Column:
    """The bin of a value between two others: by scale, or, between values of one scale, by equal parts, where the ends are in the first and the last."""
    part = F.floor(F.coalesce(F.try_divide(v - low, high - low), F.lit(0.5)) * bins)
    inner = F.when(v == low, 0).when(v == high, bins - 1).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(bins - 1)))
    return F.when(_scale(low) == _scale(high), inner).otherwise(_scale(v)).cast("int")


def exact_quantiles(df: DataFrame, value: str, shares: list[float], *by: str, bins: int = BINS) -> DataFrame:
    """One row a group with its count of values `n` and `q`, the quantiles at these shares, between neighbours in proportion.

    Nulls and NaN are no values; a group without any has no row; without `by` all rows are one group.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = checkpointed(rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).filter("_n > 0"))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(s * (F.col("_n") - 1)), F.ceil(s * (F.col("_n") - 1))) for s in shares])))
    targets = ends.select(*groups, "_n", "_low", "_high", F.lit(0).cast("long").alias("_under"), F.explode(wanted).alias("_rank"))
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]

    found = None
    while True:
        targets = checkpointed(targets)
        done = targets.filter(F.col("_low") == F.col("_high")).select(*groups, "_n", "_rank", F.col("_low").alias("_at"))
        found = done if found is None else found.unionByName(done)
        targets = targets.filter(F.col("_low") < F.col("_high"))
        if not targets.head(1):
            break
        # ranks of a group that are still between the same values share a count
        spans = targets.select(*groups, "_low", "_high").distinct()
        within = rows.alias("r").join(spans.alias("s"), [*same("r", "s"), F.col("r._v").between(F.col("s._low"), F.col("s._high"))])
        binned = within.select(*[F.col(f"s.{g}").alias(g) for g in groups], "_low", "_high", "_v", _bin(bins, F.col("_v"), F.col("_low"), F.col("_high")).alias("_bin"))
        counts = binned.groupBy(*groups, "_low", "_high", "_bin").agg(F.count("*").alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = Window.partitionBy(*groups, "_low", "_high").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
        counts = counts.withColumn("_earlier", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        hit = F.col("t._rank") - F.col("t._under")
        both = targets.alias("t").join(counts.alias("c"), [*same("t", "c"), F.col("t._low") == F.col("c._low"), F.col("t._high") == F.col("c._high"), hit >= F.col("c._earlier"), hit < F.col("c._earlier") + F.col("c._count")])
        targets = both.select(*[F.col(f"t.{g}").alias(g) for g in groups], "_n", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_under") + F.col("_earlier")).alias("_under"), "_rank")

    at = F.map_from_entries(F.collect_list(F.struct("_rank", "_at")))  # twice as many as shares
    ranks = found.groupBy(*groups).agg(F.first("_n").alias("n"), at.alias("_ranks")).filter(F.col("n").isNotNull())
    each = []
    for s in shares:
        place = s * (F.col("n") - 1)
        low, high = (F.element_at("_ranks", f(place)) for f in (F.floor, F.ceil))
        each.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))))
    return ranks.select(*[F.col(g).alias(c) for c, g in zip(by, groups, strict=True)], "n", F.array(*each).alias("q"))
