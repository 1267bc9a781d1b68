"""Writers: fixed columns, content addresses, guards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def contract(df: DataFrame, columns: list[str], fill: bool = True) -> DataFrame:
    """Exactly these columns in order; absent ones are blank, or fail if `fill` is off; null is blank."""
    absent = [c for c in columns if c not in df.columns]
    if absent and not fill:
        raise ValueError(f"missing columns {absent}")
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


#: Cells as they are: quotes doubled, white space kept.
_AS_IS = {"header": True, "emptyValue": "", "lineSep": "\n", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    contract(df, columns, fill=False).write.mode("errorifexists").csv(path, **_AS_IS)


def rows_digest(df: DataFrame, digest: str, order: str) -> str:
    """SHA-256 over the digests of the rows in order.

    Digests are joined by buckets of 2^16 neighbours of the order first, so that a
    task holds one bucket and the driver one line for each.
    """
    bucket = F.floor(F.col(order) / 65536)
    parts = df.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256)).first()[0]


def write_addressed(df: DataFrame, digest: str, folder: str) -> str:
    """Parquet under its digest; what is there already under that name is the same content."""
    target = f"{folder}/manifest_sha={digest}"
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(target)
    return target


def refuse_overwrite(df: DataFrame, columns: list[str]) -> None:
    """Fails if any of the columns has a value by hand."""
    filled = F.lit(False)
    for c in columns:
        filled = filled | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    if df.filter(filled).limit(1).collect():
        raise ValueError("labels are there; refusing to overwrite them")


def append_json(df: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines; a failed write leaves no part of it visible."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, columns: list[str], path: str) -> None:
    contract(df, columns).write.mode("append").csv(path, **_AS_IS)


def journal_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of events to a journal, each exactly once, and stops when what is there now is written.

    The checkpoint is the run's lock: a second query with it fails, and a restart goes on
    after the last committed batch.
    """
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_folder(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what was there: written beside it in full, then renamed, so that a failed write leaves the old rows."""
    spark, beside, old = rows.sparkSession, f"{path}.new", f"{path}.old"
    rows.write.mode("overwrite").json(beside)
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(place(old), True)
    if store.exists(place(path)):
        store.rename(place(path), place(old))
    if not store.rename(place(beside), place(path)):
        raise OSError(f"{beside} could not be renamed")
    store.delete(place(old), True)


def archive_run(spark: SparkSession, run: str, archive: str) -> int:
    """Copies a run's folder under the next number of an archive and tells it; the copy shows under its number only once it is whole."""
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsc.hadoopConfiguration()
    store = place(archive).getFileSystem(conf)
    store.mkdirs(place(archive))
    taken = [int(f.getPath().getName()) for f in store.listStatus(place(archive)) if f.getPath().getName().isdigit()]
    number, beside = max(taken, default=0) + 1, place(f"{archive}/.{uuid.uuid4().hex}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(place(run).getFileSystem(conf), place(run), store, beside, False, conf)
    if store.exists(place(f"{archive}/{number}")) or not store.rename(beside, place(f"{archive}/{number}")):
        raise OSError(f"{archive}/{number} is there already")
    return number


def publish_run(rows: DataFrame, expected: int, folder: str) -> bool:
    """Writes `in_progress` always and `final` only when every expected row is complete; else a final of before goes."""
    replace_folder(rows, f"{folder}/in_progress")
    spark = rows.sparkSession
    written = spark.read.schema(rows.schema).json(f"{folder}/in_progress")
    done = written.count() == expected
    if done:
        replace_folder(written, f"{folder}/final")
    else:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/final")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return done
