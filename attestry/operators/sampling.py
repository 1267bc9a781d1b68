"""Deterministic samples by the rank of a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.quantiles import exact_quantiles
from attestry.operators.ranks import in_turn, placed


def hash_rank(seed: str, key: str):
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)


def terciles(df: DataFrame, size: str) -> DataFrame:
    """Rows with short, medium or long, by the thirds of all sizes."""
    cuts = exact_quantiles(df, size, [1 / 3, 2 / 3]).select(F.col("q").alias("_cut"))
    both = df.join(F.broadcast(cuts), F.lit(True), "left")  # one row
    return both.withColumn("tercile", F.when(F.col(size) <= F.col("_cut")[0], "short").when(F.col(size) <= F.col("_cut")[1], "medium").otherwise("long")).drop("_cut")


def quota_sample(df: DataFrame, stratum: str, size: str, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """Each stratum's quota, spread over the terciles with what is over to the shorter, gaps filled from the rest of the stratum."""
    marked = terciles(df, size).withColumn("_h", hash_rank(seed, key))
    place = F.when(F.col("tercile") == "short", 0).when(F.col("tercile") == "medium", 1).otherwise(2)
    quota = F.coalesce(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col(stratum)], F.lit(0))
    share = F.floor(quota / 3) + (place < quota % 3).cast("int")
    inside = F.row_number().over(Window.partitionBy(stratum, "tercile").orderBy("_h"))
    first = marked.withColumn("_rest", (inside > share).cast("int"))
    order = F.row_number().over(Window.partitionBy(stratum).orderBy("_rest", "_h"))
    return first.withColumn("_order", order).filter(F.col("_order") <= quota).drop("_h", "_rest", "_order")


def length_spread(df: DataFrame, size: str, key: str, count: int, parent: str) -> DataFrame:
    """`count` rows at equal steps of the order by size, half steps to the even place."""
    ranked = placed(df.withColumn("_hash", hash_rank(parent, key)), size, "_hash", name="_at").drop("_hash")
    total = ranked.agg(F.count("*").alias("_n"))
    steps = df.sparkSession.range(count).crossJoin(F.broadcast(total))  # one row
    at = F.rint(F.col("id") * (F.col("_n") - 1) / max(1, count - 1)) if count > 1 else F.floor(F.col("_n") / 2)
    return ranked.join(F.broadcast(steps.select(at.cast("long").alias("_at")).distinct()), "_at").drop("_at")  # as many rows as asked for


def interleave(df: DataFrame, source: str, key: str, first: str) -> DataFrame:
    """Rows of a few sources in turn, each in the order of its key."""
    return in_turn(df, source, key, first)
