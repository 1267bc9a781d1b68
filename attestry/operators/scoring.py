"""Scores of predicted against gold labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.draws import digest_words
from attestry.operators.ranks import placed, summed_to


def accuracy(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    hit = (F.col(gold) == F.coalesce(F.col(pred), F.lit("__missing__"))).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit("__missing__")).alias("pred")).agg(F.count("*").alias("n"))


def paired(gold: DataFrame, run: DataFrame, baseline: DataFrame, key: str, label: str, pred: str) -> DataFrame:
    """(key, run, baseline): whether each of two runs has each gold row right; a row that one of them lacks fails, as does one that is there twice."""
    one = lambda df, name: df.groupBy(F.col(key).alias(f"_{name}")).agg(F.count("*").alias(f"_n_{name}"), F.first(pred).alias(name))
    both = gold.join(one(run, "run"), F.col(key) == F.col("_run"), "left").join(one(baseline, "baseline"), F.col(key) == F.col("_baseline"), "left")
    bad = (F.coalesce("_n_run", F.lit(0)) != 1) | (F.coalesce("_n_baseline", F.lit(0)) != 1)
    right = lambda c: F.when(bad, F.raise_error(F.concat(F.lit("runs are not paired at "), F.col(key).cast("string")))).otherwise(F.coalesce(F.col(c) == F.col(label), F.lit(False)))
    return both.select(key, right("run").alias("run"), right("baseline").alias("baseline"))


def paired_accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracies of paired runs, their difference, and the rows that only one of them has right."""
    a, b = F.col("run").cast("double"), F.col("baseline").cast("double")
    return pairs.agg(F.count("*").alias("n"), F.avg(a).alias("run"), F.avg(b).alias("baseline"), F.avg(a - b).alias("delta"), F.count_if(F.col("run") & ~F.col("baseline")).alias("only_run"), F.count_if(F.col("baseline") & ~F.col("run")).alias("only_baseline"))


def class_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """F1 of every label of gold or prediction, from the confusion counts."""
    c = confusion(df, gold, pred)
    g = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("n_gold"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("n_hit"))
    p = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    both = g.join(p, "label", "full_outer").na.fill(0)
    return both.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("n_hit"), F.col("n_gold") + F.col("n_pred")), F.lit(0.0)))


def macro_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return class_f1(df, gold, pred).agg(F.count("*").alias("n_labels"), F.avg("f1").alias("macro_f1"))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Equal bins of confidence, the last closed on the right; empty ones with nulls."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    got = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    dim = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return F.broadcast(dim).join(got, "bin", "left").na.fill(0, ["n"])


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    r = reliability(df, confidence, correct, bins).filter("n > 0")
    return r.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def selective_curve(df: DataFrame, confidence: str, correct: str, key: str, steps: int = 10) -> DataFrame:
    """Accuracy of the most confident share of rows, for each step of coverage; ties by key."""
    ranked = placed(df.select(confidence, correct, key), F.desc(confidence), F.col(key))
    n = ranked.count()
    grid = df.sparkSession.range(1, steps + 1).select((F.col("id") / steps).alias("coverage"))
    wanted = grid.withColumn("k", F.greatest(F.lit(1), F.rint(F.col("coverage") * n)).cast("long")).filter(F.col("k") <= n)
    return summed_to(ranked, "place", F.col(correct).cast("double"), wanted, "k").select("coverage", "k", (F.col("total") / F.col("k")).alias("accuracy"))


def spread_summary(df: DataFrame, value: str, least: float) -> DataFrame:
    """Count, minimum, mean, the upper of the middle values and the share under a threshold."""
    ranked = placed(df.select(value, F.rand(7).alias("_tie")), value, "_tie")  # so that equal values are no single range
    middle = ranked.join(F.broadcast(ranked.agg(F.floor(F.count("*") / 2).alias("_half"))), F.col("place") == F.col("_half")).select(F.col(value).alias("upper_median"))  # one row
    rest = df.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.avg((F.col(value) < least).cast("double")).alias("below_share"))
    return rest.join(F.broadcast(middle), F.lit(True), "left").select("n", "least", "mean", "upper_median", "below_share")


#: Neighbouring rows that one task draws from, and tasks that draw from few of them.
RANGE, TASKS = 65_536, 64


def draws_of(n: int, size: int, at: int, seed: int, resamples: int) -> np.ndarray:
    """How many of each resample's n draws fall in range `at` of the ranges of `size` rows.

    The ranges are the leaves of a tree; the draws of a node go to its left half by a
    binomial whose randomness is the node's own, so that every task finds the same.
    """
    low, high = 0, -(-n // size)
    draws = np.full(resamples, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rows = lambda a, b: min(b * size, n) - a * size
        left = np.random.Generator(np.random.Philox(key=[seed, (low << 32) | high])).binomial(draws, rows(low, middle) / rows(low, high))
        draws, low, high = (left, low, middle) if at < middle else (draws - left, middle, high)
    return draws


def bootstrap(df: DataFrame, values: list[str], key: str, resamples: int, seed: int, size: int | None = None) -> DataFrame:
    """Means of `values` in resamples with replacement, each of exactly as many draws as there are rows; `draws` counts them.

    Rows in the order of `key` are cut into ranges. Each range knows how many draws of a
    resample it has; the 32-bit words of digests of seed, resample, range and a counter
    say which of its rows they are. Rows stay in their range, only sums are shuffled.
    """
    size = size or RANGE
    ranked = placed(df.select(F.col(key).alias("_key"), *[F.col(v).cast("double").alias(v) for v in values]), "_key")
    n = ranked.count()
    shares = max(1, TASKS // max(1, -(-n // size)))
    ranges = ranked.groupBy(F.floor(F.col("place") / size).alias("_range")).agg(F.sort_array(F.collect_list(F.struct("place", *values))).alias("_rows"))  # at most `size` rows
    tasks = ranges.select("_range", *[F.col(f"_rows.{v}").alias(v) for v in values], F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    columns = "resample long, draws long, " + ", ".join(f"`{v}` double" for v in values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, share) in enumerate(zip(batch.column("_range").to_pylist(), batch.column("_share").to_pylist(), strict=True)):
                rows = np.stack([batch.column(v)[i].values.to_numpy(zero_copy_only=False) for v in values])
                held = np.concatenate([rows, np.zeros((len(values), 1))], axis=1)  # the last for words that are no draws
                mine = np.arange(share, resamples, shares)
                draws = draws_of(n, size, at, seed, resamples)[mine]
                sums = np.zeros((len(values), len(mine)))
                for some, words in digest_words(seed, mine, at, draws):
                    for k, word in enumerate(words):
                        drawn = word.astype(np.uint64)
                        drawn *= np.uint64(rows.shape[1])
                        drawn >>= np.uint64(32)
                        counts = (draws[some] + 3 - k) // 4
                        least = int(counts.min())
                        drawn[:, least:][np.arange(least, drawn.shape[1]) >= counts[:, None]] = rows.shape[1]
                        for total, v in zip(sums, held, strict=True):
                            total[some] += v.take(drawn.view(np.int64), mode="clip").sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(draws), *map(pa.array, sums)], names=["resample", "draws", *values])

    parts = tasks.repartition(TASKS, "_range", "_share").mapInArrow(run, columns)
    return parts.groupBy("resample").agg(F.sum("draws").alias("draws"), *[(F.sum(v) / F.sum("draws")).alias(v) for v in values])


def interval(resamples: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    p = F.percentile(F.col(value), F.array(F.lit(a), F.lit(1 - a)))
    return resamples.agg(F.avg(value).alias("mean"), p[0].alias("low"), p[1].alias("high"))
