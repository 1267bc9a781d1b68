"""Several artefacts of one state, published together.

Each publication is a folder of its own under `versions`; readers find the present one
through the file `CURRENT`, which is replaced in one step once all of it is written. A
writer that dies before leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.ranks import checkpointed
from attestry.sources import files

_POINTER = "CURRENT"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> str | None:
    """Path of the version that readers see, null before the first."""
    place, store = _place(spark, f"{folder}/{_POINTER}")
    if not store.exists(place):
        return None
    return f"{folder}/versions/{spark.read.text(f'{folder}/{_POINTER}').first().value}"


def published(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One artefact of the present version; fails if that has none of the name."""
    version = current_version(spark, folder)
    if version is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.schema(schema).json(f"{version}/{name}")


def summary(spark: SparkSession, folder: str) -> dict:
    """The facts written beside the present version's artefacts."""
    version = current_version(spark, folder)
    return json.loads("\n".join(r.value for r in spark.read.text(f"{version}/summary.json").collect())) if version else {}


def publish(spark: SparkSession, folder: str, artefacts: dict[str, DataFrame], facts: dict, keep: int = 2) -> str:
    """Writes all artefacts and the facts, then lets readers see them; the newest `keep` versions stay, others go."""
    name = uuid.uuid4().hex
    version = f"{folder}/versions/{name}"
    counts = {}
    for artefact, rows in artefacts.items():
        rows.write.mode("errorifexists").json(f"{version}/{artefact}")
        counts[artefact] = spark.read.schema(rows.schema).json(f"{version}/{artefact}").count()
    files.replace_file(spark, f"{version}/summary.json", json.dumps({**facts, "rows": counts}, sort_keys=True))
    files.replace_file(spark, f"{folder}/{_POINTER}", name)
    place, store = _place(spark, f"{folder}/versions")
    old = sorted(((f.getModificationTime(), f.getPath().getName()) for f in store.listStatus(place) if f.getPath().getName() != name), reverse=True)
    for _, gone in old[max(0, keep - 1) :]:
        store.delete(_place(spark, f"{folder}/versions/{gone}")[0], True)
    return version


def failures(manifest: DataFrame, state: DataFrame, key: str, stopped: bool = False) -> DataFrame:
    """Rows of the manifest that are not complete: the stage they wait for, what state they are in, and their last failure or why there is none."""
    both = manifest.select(key).distinct().join(state, key, "left").filter(F.col("completed_line").isNull())
    begun, failed = F.col("pass_a_line").isNotNull(), F.col("error_line").isNotNull()
    reason = F.when(~failed, F.lit("shutdown" if stopped else "not_completed"))
    return both.select(key, F.when(begun, "pass_b").otherwise("pass_a").alias("stage"), F.when(begun, "pass_a_only").otherwise("not_started").alias("state"), "error_line", "error_retriable", reason.alias("reason"))


def publish_state(manifest: DataFrame, state: DataFrame, results: DataFrame, key: str, folder: str, facts: dict, stopped: bool = False) -> bool:
    """Publishes what a run has: `in_progress` rows, `failures`, a summary, and `final` rows if nothing is missing; whether all is complete.

    All come from one written copy of the state, so that they agree.
    """
    spark = manifest.sparkSession
    held = checkpointed(state)
    total = manifest.select(key).distinct().count()
    missing = checkpointed(failures(manifest, held, key, stopped))
    gone = missing.count()
    done = results.join(missing.select(key), key, "left_anti").join(manifest.select(key).distinct(), key, "left_semi")
    artefacts = {"in_progress": done, "failures": missing} | ({"final": done} if gone == 0 else {})
    publish(spark, folder, artefacts, {**facts, "manifest_rows": total, "completed": total - gone, "incomplete": gone, "stopped": stopped})
    return gone == 0
