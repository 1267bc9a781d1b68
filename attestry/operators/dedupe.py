"""One row per key, by several policies that do not agree with each other.

All are aggregates of max_by/min_by over a struct of the row, so they combine
before the shuffle and never sort a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: str, order: Column, largest: bool) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    pick = F.max_by if largest else F.min_by
    return df.groupBy(key).agg(pick(F.struct(*rest), order).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def keep_last(df: DataFrame, key: str, line: str) -> DataFrame:
    return _pick(df, key, F.col(line), True)


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    return _pick(df, key, F.struct(*order), False)


def prefer_ok_first(df: DataFrame, key: str, ok: Column, line: str) -> DataFrame:
    """The first good row, else the first."""
    return _pick(df.filter(F.col(key).isNotNull()), key, F.struct((~ok).alias("bad"), F.col(line)), False)


def prefer_ok_last(df: DataFrame, key: str, ok: Column, line: str) -> DataFrame:
    """The last good row, else the last."""
    return _pick(df, key, F.struct(ok.alias("good"), F.col(line)), True)


def by_rank(df: DataFrame, key: str, rank: Column, line: str) -> DataFrame:
    """The highest rank; of rank 0 the last row, of others the first."""
    return _pick(df, key, F.struct(rank.alias("rank"), F.when(rank == 0, F.col(line)).otherwise(-F.col(line)).alias("at")), True)


def last_where(df: DataFrame, key: str, keep: Column, line: str) -> DataFrame:
    return keep_last(df.filter(keep), key, line)


def upsert(df: DataFrame, identity: str, number: str) -> DataFrame:
    """The highest number of each identity; rows without one never collapse."""
    named, free = df.filter(F.col(identity).isNotNull()), df.filter(F.col(identity).isNull())
    return keep_last(named, identity, number).select(df.columns).unionByName(free)


def conflicts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose rows disagree in a field; null counts as a value."""
    many = F.lit(False)
    aggs = []
    for c in fields:
        aggs.append(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))).alias(c))
        many = many | (F.col(c) > 1)
    return df.groupBy(key).agg(*aggs).filter(many).select(key)
