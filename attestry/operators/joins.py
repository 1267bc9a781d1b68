"""Joins with the audits and fallbacks that evidence tables need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.dates import day_gap
from attestry.operators.dedupe import keep_last


def with_evidence(master: DataFrame, processed: DataFrame, key: str, line: str, columns: list[str]) -> DataFrame:
    """Every master row with its last processed row; absent values are empty."""
    last = keep_last(processed, key, line).select(key, *columns)
    return master.join(last, key, "left").na.fill("", columns)


def evidence_panel(master: DataFrame, processed: DataFrame, key: str, line: str, evidence: str) -> DataFrame:
    """Master rows whose last processed row has evidence."""
    last = keep_last(processed, key, line).filter(F.trim(F.coalesce(evidence, F.lit(""))) != "")
    return master.join(last, key)


def overlay(base: DataFrame, targets: DataFrame, verdicts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Targets take the new verdict where there is one and a source that says so; others stay."""
    t = targets.select(key).distinct().withColumn("_target", F.lit(True))
    v = verdicts.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_judged"))
    both = base.join(t, key, "left").join(v, key, "left")
    new = F.col("_target").isNotNull() & F.col("_judged").isNotNull()
    out = both.select(*[F.when(new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns], F.when(new, "wayback_dead").when(F.col("_target").isNotNull(), "dead_metadata").otherwise("live").alias("evidence_source"))
    return out


def unfinished(targets: DataFrame, log: DataFrame, key: str, terminal: Column) -> DataFrame:
    return targets.join(log.filter(terminal).select(key).distinct(), key, "left_anti")


def audit_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts that a 1:1 left join has to have: rows, rows without a match, rows gained."""
    r = right.groupBy(key).agg(F.count("*").alias("_n"))
    return left.join(r, key, "left").agg(F.count("*").alias("n_left"), F.sum(F.when(F.col("_n").isNull(), 1).otherwise(0)).alias("n_unmatched"), F.sum(F.greatest(F.coalesce("_n", F.lit(1)) - 1, F.lit(0))).alias("n_gained"))


def as_of(captures: DataFrame, key: str, ts: str, days: int = 182) -> DataFrame:
    """Per key: the last capture, a target so many days before it, and the latest capture at or before the target, else the first with thin set."""
    target = F.max(ts).over(Window.partitionBy(key)) - F.expr(f"INTERVAL {days} DAYS")
    marked = captures.select(key, ts, target.alias("target_ts"))
    found = marked.groupBy(key).agg(F.max(ts).alias("death_ts"), F.min(ts).alias("first_ts"), F.max("target_ts").alias("target_ts"), F.max(F.when(F.col(ts) <= F.col("target_ts"), F.col(ts))).alias("_before"), F.count("*").alias("n_captures"))
    chosen = F.coalesce("_before", "first_ts")
    return found.select(key, "n_captures", "death_ts", "target_ts", chosen.alias("closest_ts"), F.col("_before").isNull().alias("thin_history"), day_gap(chosen, F.col("target_ts")).alias("drift_days"), F.floor((F.unix_timestamp("death_ts") - F.unix_timestamp("first_ts")) / 86400).alias("lifespan_days"))


def nearest(captures: DataFrame, key: str, ts: str, low: str, high: str, target: str) -> DataFrame:
    """Per key: the capture of least whole-day distance to the target inside the window, the earliest on ties."""
    inside = captures.filter((F.col(ts) >= F.lit(low).cast("timestamp")) & (F.col(ts) < F.lit(high).cast("timestamp")))
    gap = day_gap(F.col(ts), F.lit(target).cast("timestamp"))
    return inside.groupBy(key).agg(F.min_by(ts, F.struct(gap, F.col(ts))).alias("closest_ts"), F.min(gap).alias("drift_days"), F.count("*").alias("n_window"))


def latest_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """General as-of join: each left row with the right value of the latest time at or before it; one shuffle."""
    l = left.select(key, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    r = right.select(key, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    before = Window.partitionBy(key).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_found", F.last("_value", ignorenulls=True).over(before))
    return both.filter("_side = 1").select("_row.*", F.col("_found").alias(value))


def require_ids(df: DataFrame, ids: list, key: str) -> None:
    """Fails if the table lacks any of a few ids, naming them."""
    there = {r[0] for r in df.select(key).filter(F.col(key).isin(ids)).distinct().collect()}  # at most as many as asked for
    lost = [i for i in ids if i not in there]
    if lost:
        raise ValueError(f"missing {key}: {lost}")


def in_order(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the ids asked for, with their place in the list."""
    asked = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"place int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(asked), key)


def flips(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many verdicts differ, column by column, of keys in both."""
    a = before.select(key, *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    both = after.join(a, key)
    return both.agg(F.count("*").alias("n_both"), *[F.sum((F.col(c).cast("string") != F.col(f"_{c}")).cast("long")).alias(f"{c}_flips") for c in columns])


def required(df: DataFrame, column: str, what: str) -> DataFrame:
    """Rows unchanged; the query fails where the column is null."""
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{what}: no {column}"))).otherwise(F.col(column)))
