"""Archive candidates, listings, banks and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.ranks import placed, running


def union_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Rows of all sources, each with the source's name and its place among the sources."""
    out = None
    for ordinal, (name, rows) in enumerate(sources):
        part = rows.withColumns({"source": F.lit(name), "ordinal": F.lit(ordinal)})
        out = part if out is None else out.unionByName(part)
    return out


def members(df: DataFrame, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is among `keys`, or is not."""
    return df.join(keys.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def is_resolvable(status: Column, stamp: Column) -> Column:
    return F.coalesce((status == "ok") & (F.trim(stamp) != ""), F.lit(False))


def is_retrievable(status: Column, has_window: Column, stamp: Column) -> Column:
    """A successful probe with a capture in the window; the flag is text."""
    return is_resolvable(status, stamp) & F.coalesce(has_window == "True", F.lit(False))


def existed_by(founded: Column, cutoff: str) -> Column:
    """Whether the founding month, as text, is not after the cutoff's; blank is not."""
    month = F.substring(F.coalesce(founded, F.lit("")), 1, len(cutoff))
    return (month != "") & (month <= cutoff)


def ranked_candidates(df: DataFrame, wanted: Column, n: int, key: str, *descending: str) -> DataFrame:
    """The first n of the rows wanted, largest values first, ties by key."""
    return df.filter(wanted).orderBy(*[F.desc(c) for c in descending], F.asc(key)).limit(n)


def example_rows(df: DataFrame, smallest: tuple[str, int], longest: tuple[str, int], key: str) -> DataFrame:
    """The rows of least and those of greatest value of two columns, each with the list it is on."""
    near = df.orderBy(F.asc(smallest[0]), key).limit(smallest[1]).withColumn("listed", F.lit("smallest"))
    far = df.orderBy(F.desc(longest[0]), key).limit(longest[1]).withColumn("listed", F.lit("longest"))
    return near.unionByName(far)


def listing(df: DataFrame, key: str) -> DataFrame:
    """Keys with their counts and places, most frequent first, ties by key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return placed(counts, F.desc("n"), F.asc(key)).withColumn("place", F.col("place") + 1)


def leaderboard(df: DataFrame, group: str, correct: str, least: int = 1) -> DataFrame:
    """Accuracy by group with its place, best first, ties by group; small groups are left out."""
    rates = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")).filter(F.col("n") >= least)
    return rates.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), F.asc(group))).cast("long"))  # one row a group


def missing_from_bank(asked: DataFrame, bank: DataFrame, key: str, valid: Column) -> DataFrame:
    """Keys asked for that the bank does not hold with a valid payload; a bank serves only if there are none."""
    return asked.select(key).distinct().join(bank.filter(valid).select(key), key, "left_anti")


def banked(bank: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The bank's rows, and of keys it lacks the fresh ones."""
    return bank.unionByName(fresh.join(bank.select(key), key, "left_anti").select(bank.columns))


def refreshed(df: DataFrame, fresh: DataFrame, key: str, *columns: str) -> DataFrame:
    """Columns replaced where a fresh row has a value."""
    new = fresh.select(key, *[F.col(c).alias(f"fresh {c}") for c in columns])
    return df.join(new, key, "left").select(*[F.coalesce(f"fresh {c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def first_usable(primary: DataFrame, fallback: DataFrame, key: str, column: str) -> DataFrame:
    """The primary result, or the fallback's where that is missing or blank, and which it is."""
    other = fallback.select(key, F.col(column).alias("other"))
    usable = F.coalesce(F.trim(column) != "", F.lit(False))
    both = primary.select(key, column).join(other, key, "left")
    return both.select(key, F.when(usable, F.col(column)).otherwise(F.coalesce("other", F.lit(""))).alias(column), F.when(usable, "primary").when(F.coalesce("other", F.lit("")) != "", "fallback").otherwise("none").alias("used"))


def with_repeats(df: DataFrame, cell: str, value: str, label: str) -> DataFrame:
    """Detail rows and, of each cell with two or more, a row of their mean."""
    means = df.groupBy(cell).agg(F.count("*").alias("_n"), F.avg(value).alias(value)).filter("_n >= 2")
    return df.select(cell, label, value).unionByName(means.select(cell, F.concat(F.lit("mean of "), F.col("_n").cast("string")).alias(label), value))


def idempotency_key(company: Column, stage: Column, input_hash: Column) -> Column:
    return F.concat_ws(":", company, stage, input_hash)


def request_json(model: str, effort: str, instructions: Column, message: Column) -> Column:
    """A request's payload as JSON, of nested arrays and structs."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(F.lit(effort).alias("effort")).alias("reasoning"), F.array(turn("system", instructions), turn("user", message)).alias("input")))


def request_fingerprint(settings: dict[str, str | Column]) -> Column:
    """SHA-256 of settings by name, texts or columns, as compact JSON, whatever their order."""
    pairs = F.array(*[F.array(F.lit(k), settings[k] if isinstance(settings[k], Column) else F.lit(settings[k])) for k in sorted(settings)])
    return F.sha2(F.to_json(pairs), 256)


def strict_schema(schema: dict) -> dict:
    """The JSON schema with every object closed and all of its properties required."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) for k, v in schema.items()}
    if isinstance(out.get("properties"), dict):
        out |= {"additionalProperties": False, "required": list(out["properties"])}
    return out


def retry_delay(attempt: Column, draw: Column, base: float = 0.5, most: float = 8.0, jitter: float = 0.2) -> Column:
    """Seconds before an attempt: doubling up to a bound, moved by a draw in [0, 1) of a fifth either way."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1)) * (1 - jitter + 2 * jitter * draw)


def outage_waits(failures: DataFrame, key: str, line: str, first: float = 60.0, most: float = 600.0, total: float = 1800.0) -> DataFrame:
    """Each failure with its attempt, the doubling wait after it, the waits so far, and whether the row is given up."""
    w = Window.partitionBy(key).orderBy(line)
    numbered = failures.withColumn("attempt", F.row_number().over(w))
    waits = numbered.withColumn("wait_s", F.least(F.lit(most), first * F.pow(F.lit(2.0), F.col("attempt") - 1)))
    so_far = waits.withColumn("waited_s", F.sum("wait_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return so_far.withColumn("given_up", F.col("waited_s") > total)


def heartbeats(log: DataFrame, by: str, ts: str, line: str, every: int) -> DataFrame:
    """After every so many rows of a job: rows done, rows a minute since its start, and minutes to go at that rate."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    placed_rows = running(log.withColumn("_s", seconds), by, line, F.col("_s"), "done", "_first")
    sizes = log.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_all"))
    rows = placed_rows.join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    rate = F.try_divide(F.col("done") * 60.0, F.col("_s") - F.col("_first"))
    return rows.filter((F.col("done") % every == 0) | (F.col("done") == F.col("_all"))).select(by, F.col("done").cast("long").alias("done"), rate.alias("per_minute"), F.try_divide(F.col("_all") - F.col("done"), rate).alias("minutes_left"))


def cell_cost(stages: DataFrame, cell: str, first: str, second: str, has_bank: str) -> DataFrame:
    """Cost of each cell: the second stage's, and the first's where it is not banked."""
    paid = F.when(F.col(has_bank), 0.0).otherwise(F.col(first))
    return stages.groupBy(cell).agg(F.count("*").alias("n"), F.sum(second).alias("second_usd"), F.sum(paid).alias("first_usd"), (F.sum(second) + F.sum(paid)).alias("usd"))


def probed(df: DataFrame, probes: DataFrame, key: str, column: str, force: bool = False) -> DataFrame:
    """`df` with `column` from `probes` where it holds neither true nor false (or everywhere, if forced); rows without a probe stay."""
    fresh = probes.select(F.col(key), F.col(column).alias("_fresh"))
    settled = F.lit(False) if force else F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))).isin("true", "false")
    return df.join(fresh, key, "left").withColumn(column, F.when(settled, F.col(column)).otherwise(F.coalesce("_fresh", column))).drop("_fresh")


def job_progress(jobs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows done, spend of the job's own stage and whether all is done; jobs (job, stage, rows_total), predictions (job, stage, row, usd)."""
    done = predictions.groupBy("job").agg(F.countDistinct("row").alias("rows_done"))
    spent = predictions.groupBy("job", "stage").agg(F.sum("usd").alias("spend_usd"))
    out = jobs.join(done, "job", "left").join(spent, ["job", "stage"], "left").withColumns({"rows_done": F.coalesce("rows_done", F.lit(0)), "spend_usd": F.coalesce("spend_usd", F.lit(0.0))})
    return out.withColumn("complete", F.col("rows_done") == F.col("rows_total"))


def first_pending(rows: DataFrame, done: DataFrame, key: str, line: str, n: int) -> DataFrame:
    """The first n rows in input order that are not done."""
    return rows.join(done.select(key).distinct(), key, "left_anti").orderBy(line).limit(n)
