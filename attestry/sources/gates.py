"""What has to hold before a run goes on: settings that may not change, a matching smoke run, room and inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.files import file_stamps


def run_settings(spark: SparkSession, glob: str) -> DataFrame:
    """(run_id, settings): every setting of each run's file of settings, values as text (JSON where they are no scalars); the folder is the run."""
    whole = spark.read.text(glob, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"), "value")
    return whole.select("run_id", F.from_json("value", "map<string,string>").alias("settings"))


def changed_settings(df: DataFrame, was: str, now: str, fields: list[str], *keys: str) -> DataFrame:
    """(keys, field, was, now): the fields whose values differ between two maps of settings; an absent one is null."""
    names = F.array(*[F.lit(f) for f in fields])
    value = lambda side, f: F.try_element_at(F.col(side), f)
    listed = F.filter(F.transform(names, lambda f: F.struct(f.alias("field"), value(was, f).alias("was"), value(now, f).alias("now"))), lambda x: ~x["was"].eqNullSafe(x["now"]))
    return df.select(*keys, F.explode(listed).alias("_x")).select(*keys, "_x.*")


def require_same_settings(changed: DataFrame) -> None:
    """Fails if anything changed, naming the fields."""
    fields = sorted({r.field for r in changed.select("field").distinct().collect()})  # at most one row a field
    if fields:
        raise ValueError(f"cannot resume: {', '.join(fields)} changed since the run began")


def matching_smokes(runs: DataFrame, wanted: dict[str, str], rows: int) -> DataFrame:
    """Smoke runs of the same identity that are complete and without failures, newest first.

    `runs` has run_id, settings, n_rows, n_completed, n_errors, has_final and finished_at.
    """
    same = F.try_element_at("settings", F.lit("kind")) == "smoke"
    for field, value in wanted.items():
        same = same & F.try_element_at("settings", F.lit(field)).eqNullSafe(F.lit(value))
    whole = (F.col("n_rows") == rows) & (F.col("n_completed") == rows) & (F.col("n_errors") == 0) & F.col("has_final")
    return runs.filter(F.coalesce(same & whole, F.lit(False))).orderBy(F.desc("finished_at"), "run_id")


def preflight(spark: SparkSession, pending: int, inputs: list[str], output: str, least_free_bytes: int) -> DataFrame:
    """(name, ok, found): work is there, every input has files, and the output's store has room."""
    place = spark._jvm.org.apache.hadoop.fs.Path(output)
    free = int(place.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus().getRemaining())
    rows = [("pending rows", pending > 0, str(pending)), ("free bytes", free >= least_free_bytes, str(free))]
    rows += [(f"input {path}", bool(found), str(len(found))) for path in inputs for found in [file_stamps(spark, path)]]
    return spark.createDataFrame(rows, "name string, ok boolean, found string")


def require_ready(report: DataFrame) -> None:
    bad = [f"{r.name} ({r.found})" for r in report.filter(~F.col("ok")).collect()]
    if bad:
        raise ValueError(f"not ready: {', '.join(bad)}")


def finished_ids(log: DataFrame, key: str, line: str, ok: Column, retryable: Column) -> DataFrame:
    """Keys that need no further call: one that succeeded, or whose last row failed for good."""
    flags = log.select(key, line, F.coalesce(ok, F.lit(False)).alias("_ok"), F.coalesce(retryable, F.lit(False)).alias("_again"))
    ends = flags.groupBy(key).agg(F.bool_or("_ok").alias("_done"), F.max_by("_again", line).alias("_again"))
    return ends.filter(F.col("_done") | ~F.col("_again")).select(key, F.col("_done").alias("succeeded"))
