"""Folders of runs: scored reports with their settings, registries, the newest valid manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.files import header_and_rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _found(spark: SparkSession, glob: str) -> list[tuple[int, str, str]]:
    """(modification time, name, path) of the files of a glob."""
    place = spark._jvm.org.apache.hadoop.fs.Path(glob)
    hits = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [(h.getModificationTime(), h.getPath().getName(), h.getPath().toString()) for h in hits or []]


def _folder(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -2)


def scored_reports(spark: SparkSession, folder: str, report: str, settings: str) -> DataFrame:
    """Every `<run>/scored.json`, newest first, with the columns of a `config.json` beside it where there is one.

    A setting overrides a report's column of the same name; a report without a file of
    settings keeps its own.
    """
    stem = {"run_id": _folder(F.col("_metadata.file_path")), "modified": F.col("_metadata.file_modification_time")}
    scored = spark.read.schema(report).option("multiLine", True).json(f"{folder}/*/scored.json").withColumns(stem)
    if not _found(spark, f"{folder}/*/config.json"):
        return scored.orderBy(F.desc("modified"), "run_id")
    config = spark.read.schema(settings).option("multiLine", True).json(f"{folder}/*/config.json").withColumn("run_id", _folder(F.col("_metadata.file_path")))
    both = scored.alias("s").join(config.alias("c"), "run_id", "left")
    mine, theirs = set(scored.columns), [c for c in config.columns if c != "run_id"]
    columns = [F.coalesce(F.col(f"c.{c}"), F.col(f"s.{c}")).alias(c) if c in theirs else F.col(f"s.{c}") for c in scored.columns if c != "run_id"]
    return both.select("run_id", *columns, *[F.col(f"c.{c}") for c in theirs if c not in mine]).orderBy(F.desc("modified"), "run_id")


def registry(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of {"instances": [...]} with a whole number `n`, oldest first; a missing or damaged file has none."""
    whole = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    listed = whole.select(F.from_json("value", "instances array<string>").alias("o")).select(F.explode("o.instances").alias("e"))
    numbered = listed.filter(F.regexp_like(F.get_json_object("e", "$.n"), F.lit(r"^-?[0-9]+$")) & F.regexp_like("e", F.lit(r'"n"\s*:\s*-?[0-9]')))
    return numbered.select(F.from_json("e", entry).alias("o")).select("o.*").orderBy("n")


def newest_manifest(spark: SparkSession, glob: str, header: str, row: str, count: str = "n_rows") -> str:
    """Path of the newest file whose header counts as many rows as follow; fails if there is none."""
    problems = []
    for _, name, path in sorted(_found(spark, glob), reverse=True):
        try:
            head, rows = header_and_rows(spark, path, header, row)
            wanted, n = [r[0] for r in head.select(count).limit(2).collect()], rows.count()
        except Exception as e:  # noqa: BLE001  whatever is wrong with a file, an older one may do
            problems.append(f"{name}: {type(e).__name__}")
            continue
        if wanted == [n]:
            return path
        problems.append(f"{name}: counts {wanted}, has {n}")
    raise ValueError(f"no valid manifest; newest: {problems[0]}" if problems else "no manifest")


def valid_run_id(run_id: str) -> str:
    """The id itself; fails if it could leave its folder."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"run id {run_id!r}")
    return run_id
