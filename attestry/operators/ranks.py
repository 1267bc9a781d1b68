"""Exact places in an order of the whole table, without a task that holds all rows.

Rows are cut into ranges of the order and sorted within them; how many rows the ranges
before it have is added to a row's place in its own. The sorted table is checkpointed:
a range's borders come from a sample and may fall elsewhere if they are found again.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors share no other folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """`df` with each row's place in the order, from 0; rows that the order does not tell apart come in any order.

    An order that ends in a key keeps equal values in different ranges.
    """
    ranges = df.repartitionByRange(_width(df.sparkSession), *order).sortWithinPartitions(*order)
    held = checkpointed(ranges.withColumns({"_range": F.spark_partition_id(), "_in_range": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = {r["_range"]: r["n"] for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offsets = F.array(*[F.lit(n).cast("long") for n in before or [0]])
    return held.withColumn(name, offsets[F.col("_range")] + F.col("_in_range")).drop("_range", "_in_range")


def placed_by(df: DataFrame, group: str, *order: Column | str, name: str = "place") -> DataFrame:
    """`df` with each row's place in its group's order, from 0; a group may hold any share of the rows."""
    rows = placed(df, F.col(group), *order, name="_all")
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_all").alias("_first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_group", "_first")


def running(df: DataFrame, group: str, order: str, value: Column, place: str = "place", least: str = "least") -> DataFrame:
    """`df` with each row's place in its group's order, from 1, and the least value up to it; a group may hold any share of the rows.

    What the ranges before have of a group is added to the row's own range.
    """
    ranges = df.withColumn("_value", value).repartitionByRange(_width(df.sparkSession), F.col(group), order)
    held = checkpointed(ranges.withColumn("_range", F.spark_partition_id()))
    parts = held.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"), F.min("_value").alias("_m"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select("_group", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.min("_m").over(earlier).alias("_m"))
    here = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = held.withColumns({place: F.count("*").over(here), least: F.min("_value").over(here)})
    both = own.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    return both.withColumns({place: F.col(place) + F.col("_n"), least: F.least(least, "_m")}).drop("_value", "_range", "_group", "_part", "_n", "_m")


def summed_before(df: DataFrame, order: str, value: Column, place: str = "place", total: str = "total") -> DataFrame:
    """`df` with each row's place in the order of the whole table, from 0, and the sum of `value` over the rows before it (0 for none, nulls count as 0)."""
    held = checkpointed(df.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(_width(df.sparkSession), order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy(F.col("_range").alias("_part")).agg(F.count("*").alias("_n"), F.sum("_value").alias("_s"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))  # one row a range
    here = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumns({place: F.count("*").over(here), total: F.coalesce(F.sum("_value").over(here), F.lit(0))})
    both = own.join(F.broadcast(parts), F.col("_range") == F.col("_part"))
    return both.withColumns({place: F.col(place) + F.col("_n"), total: F.col(total) + F.col("_s")}).drop("_value", "_range", "_part", "_n", "_s")


def summed_to(df: DataFrame, place: str, value: Column, cuts: DataFrame, cut: str) -> DataFrame:
    """`cuts` (a few rows) with the sum of `value` over the rows whose place is under each cut, as `total`.

    A row counts for the first cut after it, and the few sums by cut are then added up.
    """
    ordered = sorted({r[0] for r in cuts.select(F.col(cut).cast("long")).collect()})
    bounds = F.array(*[F.lit(c) for c in ordered])
    slot = F.array_size(F.filter(bounds, lambda c: c <= F.col(place)))
    sums = df.select(slot.alias("_slot"), value.alias("_v")).filter(F.col("_slot") < len(ordered)).groupBy("_slot").agg(F.sum("_v").alias("_s"))
    listed = df.sparkSession.createDataFrame(list(enumerate(ordered)), "_cut_at int, _cut long")
    totals = listed.join(F.broadcast(sums), F.col("_slot") <= F.col("_cut_at"), "left").groupBy("_cut").agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("total"))  # as many rows as cuts
    return cuts.join(F.broadcast(totals), F.col(cut).cast("long") == F.col("_cut")).drop("_cut")


def in_turn(df: DataFrame, source: str, key: str, first: str, name: str = "place") -> DataFrame:
    """Rows of a few sources in turn, each in the order of its key, `first` before the others; places from 1.

    Of every source, as many rows as the row's own place in it come before its turn, or all if it has fewer.
    """
    rows = placed_by(df, source, key, name="_turn")
    counts = [r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()]  # one row a source
    before = sum((F.least(F.col("_turn"), F.lit(n)) for n in counts), F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("_turn").orderBy(F.col(source) != first, key))  # one row a source
    return rows.withColumn(name, before + within).drop("_turn")
