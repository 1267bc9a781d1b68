"""Manifests: a header with counts and digests, then the rows that it vouches for.

A row's digest is that of its JSON text; the rows' digest is that of `sinks.rows_digest`
over their ordinals; the manifest's own is that of its version, counts and rows' digest.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.ranks import placed
from attestry.sources import sinks
from attestry.sources.lines import physical_lines
from attestry.sources.runs import exists

VERSION = 1


def _identity(row_count: int, source_counts: dict[str, int], rows_sha256: str) -> str:
    said = {"manifest_version": VERSION, "row_count": row_count, "rows_sha256": rows_sha256, "source_counts": source_counts}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _measured(rows: DataFrame, source: str) -> tuple[int, dict[str, int], str]:
    """Count, counts by source and digest of (ordinal, value) rows with a source, one row a source on the driver."""
    counts = {str(r[source]): r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()}
    digest = sinks.rows_digest(rows.select("ordinal", F.sha2("value", 256).alias("d")), "d", "ordinal")
    return sum(counts.values()), counts, digest


def write_manifest(rows: DataFrame, key: str, source: str, folder: str) -> str:
    """Writes `rows` in the order of their key under the name of their digest and tells the path; the same rows are written once.

    Fails on a null or repeated key.
    """
    spark = rows.sparkSession
    bad = rows.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"null or repeated {key}: {bad[0][key]!r}")
    ordered = placed(rows, F.col(key), name="ordinal")
    text = F.to_json(F.struct(F.lit("row").alias("record_type"), "ordinal", *[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    told = ordered.select("ordinal", F.col(source).cast("string").alias("source"), text.alias("value"))
    n, counts, digest = _measured(told, "source")
    name = _identity(n, counts, digest)
    target = f"{folder}/manifest_{name}"
    if not exists(spark, f"{target}/_SUCCESS"):
        header = json.dumps({"record_type": "manifest", "manifest_version": VERSION, "row_count": n, "source_counts": counts, "rows_sha256": digest, "manifest_sha256": name})
        told.select("value").unionByName(spark.createDataFrame([(header,)], "value string")).write.mode("overwrite").text(target)
    return target


def load_manifest(spark: SparkSession, path: str, row: str, source: str) -> DataFrame:
    """(ordinal, ...) rows of a manifest, verified against its header: their number, their counts by source, and both digests.

    Fails on a record of another type, on none or several headers, and on any of those
    that differ; blank lines count as none.
    """
    lines = physical_lines(spark, path).filter(F.trim("value") != "").withColumn("kind", F.get_json_object("value", "$.record_type"))
    odd = lines.filter(F.col("kind").isNull() | ~F.col("kind").isin("manifest", "row")).select("line_no").limit(1).collect()
    if odd:
        raise ValueError(f"line {odd[0].line_no + 1} is no record of a manifest")
    heads = [json.loads(r.value) for r in lines.filter("kind = 'manifest'").select("value").limit(2).collect()]
    if len(heads) != 1 or heads[0].get("manifest_version") != VERSION:
        raise ValueError("a manifest has one header, of this version")
    head = heads[0]
    rows = lines.filter("kind = 'row'").select("value", F.get_json_object("value", "$.ordinal").try_cast("long").alias("ordinal"), F.coalesce(F.get_json_object("value", f"$['{source}']"), F.lit("None")).alias("source"))
    n, counts, digest = _measured(rows, "source")
    for what, found in (("row_count", n), ("source_counts", counts), ("rows_sha256", digest), ("manifest_sha256", _identity(n, counts, digest))):
        if head.get(what) != found:
            raise ValueError(f"{what}: the header has {head.get(what)}, the rows {found}")
    return rows.select("ordinal", F.from_json("value", row).alias("o")).select("ordinal", "o.*")
