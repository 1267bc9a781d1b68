"""Distributions, rates, grids, series and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import edge_bin, normal_half_width, wilson
from attestry.operators.quantiles import exact_quantiles


def fixed_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts and percent of each value of the domain, zeros too."""
    dim = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], f"place int, {column} string")
    counts = df.filter(F.col(column).isin(*domain)).groupBy(column).agg(F.count("*").alias("n"))
    both = F.broadcast(dim).join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # over as many rows as the domain
    return both.select(column, "n", F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)).alias("pct"))


def rate_with_interval(df: DataFrame, flag: str, *by: str) -> DataFrame:
    k, n = F.sum(F.col(flag).cast("int")), F.count("*")
    low, high = wilson(F.col("k"), F.col("n"))
    return df.groupBy(*by).agg(k.alias("k"), n.alias("n")).select(*by, "k", "n", (100.0 * F.col("k") / F.col("n")).alias("pct"), low.alias("low"), high.alias("high"))


def mortality(df: DataFrame, dead: str, survivor: str, *by: str) -> DataFrame:
    """Dead of dead and survivors, in percent; levels without either are left out."""
    d, s = F.sum(F.col(dead).cast("int")), F.sum(F.col(survivor).cast("int"))
    return df.groupBy(*by).agg(d.alias("dead"), s.alias("survivors")).filter("dead + survivors > 0").withColumn("mortality_pct", 100.0 * F.col("dead") / (F.col("dead") + F.col("survivors")))


def grid(df: DataFrame, rows: tuple[str, list[str]], columns: tuple[str, list[str]], dead: str, survivor: str) -> DataFrame:
    """Mortality of every cell of two fixed domains; null where a cell is empty."""
    spark = df.sparkSession
    a = spark.createDataFrame([(v,) for v in rows[1]], f"{rows[0]} string")
    b = spark.createDataFrame([(v,) for v in columns[1]], f"{columns[0]} string")
    cells = df.groupBy(rows[0], columns[0]).agg(F.sum(F.col(dead).cast("int")).alias("dead"), F.sum(F.col(survivor).cast("int")).alias("survivors"))
    both = a.crossJoin(b).join(cells, [rows[0], columns[0]], "left").na.fill(0, ["dead", "survivors"])
    return both.withColumn("mortality_pct", F.try_divide(100.0 * F.col("dead"), F.col("dead") + F.col("survivors")))


def threshold_cube(df: DataFrame, by: list[str], score: str, thresholds: list[int], level: str) -> DataFrame:
    """Counts of `level` in every cell of the cube of `by`, for each least score.

    Rows are counted once by score; the thresholds then sum the few counts above them.
    """
    counts = df.cube(*by, level, score).agg(F.count("*").alias("n"), F.grouping(level).alias("_l"), F.grouping(score).alias("_s")).filter("_l = 0 AND _s = 0")
    least = df.sparkSession.createDataFrame([(t,) for t in thresholds], "min_score int")
    over = counts.join(F.broadcast(least), F.col(score) >= F.col("min_score"))
    return over.groupBy(*[F.coalesce(F.col(b), F.lit("ALL")).alias(b) for b in by], "min_score", level).agg(F.sum("n").alias("n"))


def lift(df: DataFrame, column: str, dead: str, survivor: str) -> DataFrame:
    """Shares among dead and among survivors, and their ratio; null where no survivor has the value."""
    c = df.groupBy(column).agg(F.sum(F.col(dead).cast("int")).alias("n_dead"), F.sum(F.col(survivor).cast("int")).alias("n_survivor"))
    t = c.agg(F.sum("n_dead").alias("_d"), F.sum("n_survivor").alias("_s"))
    both = c.crossJoin(F.broadcast(t))  # one row
    d, s = F.try_divide(F.col("n_dead").cast("double"), F.col("_d")), F.try_divide(F.col("n_survivor").cast("double"), F.col("_s"))
    return both.select(column, "n_dead", "n_survivor", d.alias("dead_share"), s.alias("survivor_share"), F.try_divide(d, s).alias("lift"))


def monthly(a: DataFrame, a_ts: str, b: DataFrame, b_ts: str, since: str) -> DataFrame:
    """Counts by month of two tables; a month of either is there, with 0 for the other."""
    def count(df: DataFrame, ts: str, name: str) -> DataFrame:
        return df.filter(F.col(ts) >= F.lit(since).cast("timestamp")).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias(name))

    return count(a, a_ts, "n_a").join(count(b, b_ts, "n_b"), "month", "full_outer").na.fill(0)


def histogram(df: DataFrame, column: str, edges: list[float], *by: str) -> DataFrame:
    bins = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, low double, high double")
    counts = df.select(*by, edge_bin(F.col(column), edges).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    if not by:
        return F.broadcast(bins).join(counts, "bin", "left").na.fill(0, ["n"])
    return counts.join(F.broadcast(bins), "bin")


def percentiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, extremes, mean, median and 95th percentile by group."""
    x = F.col(column).cast("double")
    rest = df.groupBy(*by).agg(F.count(column).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"))
    q = exact_quantiles(df, column, [0.5, 0.95], *by).select(*[F.col(b).alias(f"_{b}") for b in by], "q")
    both = rest.join(q, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] or F.lit(True), "left")
    return both.select(*by, "n", "min", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "max")


def rate_with_normal_interval(df: DataFrame, flag: Column, *by: str) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))
    return out.withColumn("half_width", normal_half_width(F.col("rate"), F.col("n")))


def failure_sets(df: DataFrame, stage: str, reason: str) -> DataFrame:
    """Counts by stage, by reason, by both and of all, in one pass."""
    return df.cube(stage, reason).agg(F.count("*").alias("n")).select(F.coalesce(F.col(stage), F.lit("*")).alias("stage"), F.coalesce(F.col(reason), F.lit("*")).alias("reason"), "n")


def consensus(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The value that all rows share, null where they differ."""
    return df.groupBy(*by).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value), F.count("*").alias("n"))


def repeats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, extremes and half range of groups with two rows or more."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.filter("n >= 2").withColumn("half_range", (F.col("high") - F.col("low")) / 2)


def active_seconds(df: DataFrame, ts: str, gap: int, *by: str) -> DataFrame:
    """Sum of the gaps between neighbouring times that are over 0 and at most `gap` seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    d = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    return df.select(*by, d.alias("d")).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when((F.col("d") > 0) & (F.col("d") <= gap), F.col("d"))), F.lit(0.0)).alias("active_s"))
