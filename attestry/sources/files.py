"""Readers with the rules that hand-made CSV and JSON-lines files need."""

from __future__ import annotations

import csv
import io
import uuid

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attestry.sources.lines import physical_lines, quoted_records, written


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every cell a string, blank and never null; rows with too many cells go, short ones are filled."""
    wide = StructType([StructField(c, StringType()) for c in [*columns, "_extra"]])
    rows = spark.read.schema(wide).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    return rows.filter("_extra IS NULL").drop("_extra").na.fill("")


#: Follows a record's last cell, to tell a blank cell from a missing one.
_END = "\x01end of record"


def csv_contract(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """Rows with source_row_number (the header is row 1, blank lines count as none), from as many tasks as the files have blocks.

    Fails on a header that lacks a column or has one twice, on a row without a cell for
    any of the columns, on a file that ends inside quotes, and on a blank or repeated
    key. Cells beyond the header are ignored.
    """
    records = quoted_records(spark, path)
    heads = [next(csv.reader(io.StringIO(r.value.lstrip("\ufeff")))) for r in records.filter("record_no = 0").orderBy("file").collect()]  # one a file
    names = heads[0] if heads else []
    if any(h != names for h in heads):
        raise ValueError("headers differ between files")
    missing, twice = [c for c in columns if c not in names], {c for c in names if names.count(c) > 1}
    if missing or twice:
        raise ValueError(f"header: missing {missing}, repeated {sorted(twice)}")
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names) + 1)])
    # a cell too many would make the record a damaged one, so the parser is told of no column for the rest
    cells = F.from_csv(F.concat("value", F.lit(f",{_END}")), schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    parsed = records.filter("record_no > 0").select((F.col("record_no") + 1).alias("source_row_number"), "is_whole", cells.alias("cell"))
    row = F.col("source_row_number").cast("string")
    ends = F.array_position(F.array(*[F.coalesce(F.col(f"cell.c{i}"), F.lit("")) for i in range(len(names) + 1)]), _END)
    fail = lambda what: F.raise_error(F.concat(F.lit("row "), row, F.lit(what)))
    out = [
        F.when(~F.col("is_whole"), fail(": the file ends inside quotes")).when((ends > 0) & (ends <= names.index(c) + 1), fail(f" has no value for {c!r}")).otherwise(F.coalesce(F.col(f"cell.c{names.index(c)}"), F.lit(""))).alias(c)
        for c in columns
    ]
    rows = parsed.select(*out, "source_row_number")
    bad = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("source_row_number").alias("row")).filter((F.trim(key) == "") | (F.col("n") > 1)).orderBy("row").limit(1).collect()
    if bad:
        raise ValueError(f"row {bad[0].row}: blank or repeated {key}: {bad[0][key]!r}")
    return rows


def file_stamps(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and time of change of every file of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return {f.getPath().toString(): (f.getLen(), f.getModificationTime()) for f in found or []}


def require_unchanged(spark: SparkSession, path: str, before: dict[str, tuple[int, int]]) -> None:
    """Fails if a file of the path is another than when `before` was taken."""
    if file_stamps(spark, path) != before:
        raise ValueError("input changed while it was read")


def typed(df: DataFrame, stamps: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """14-digit times and numbers; what does not parse is null."""
    for c in stamps:
        df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit("yyyyMMddHHmmss")))
    for c in numbers:
        df = df.withColumn(c, F.col(c).try_cast("double"))
    return df


def json_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that parse; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _objects(lines: DataFrame, schema: str) -> DataFrame:
    """`lines` with the object `o` of each, and `fault`: what keeps a line from being an object of the schema, or null."""
    types = StructType.fromDDL(schema)
    whole = F.coalesce(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"), F.lit(False))
    parsed = lines.withColumn("o", F.from_json("value", schema))
    lost = F.lit(None).cast("string")
    for name in types.names:
        told = F.get_json_object("value", f"$['{name}']").isNotNull() & F.col(f"o.`{name}`").isNull()
        lost = F.coalesce(lost, F.when(told, F.lit(f"{name} has another type")))
    return parsed.withColumn("fault", F.when(~whole, F.lit("no JSON object")).otherwise(lost))


def json_strict(spark: SparkSession, path: str, schema: str, last_may_break: bool = True) -> DataFrame:
    """Objects with line_no, from 0; a line that is no object of the schema fails, but for the last of a file that does not parse, where that is allowed."""
    lines = physical_lines(spark, path).filter(F.trim("value") != "")
    ends = written(lines.groupBy("file").agg(F.max("line_no").alias("_end")))  # one row a file
    parsed = _objects(lines.join(ends, "file"), schema)
    torn = (F.col("line_no") == F.col("_end")) & (F.col("fault") == "no JSON object") if last_may_break else F.lit(False)
    broken = parsed.filter(F.col("fault").isNotNull() & ~torn).select("line_no", "fault").orderBy("line_no").limit(1).collect()
    if broken:
        raise ValueError(f"line {broken[0].line_no + 1}: {broken[0].fault}")
    return parsed.filter("fault IS NULL").select("line_no", "o.*")


def journal_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Committed events only: a last line without its newline does not count even if it parses; a committed line that is no object of the schema fails."""
    lines = physical_lines(spark, path).filter("is_closed AND value <> ''")
    damaged = F.raise_error(F.concat(F.lit("damaged journal line "), (F.col("line_no") + 1).cast("string"), F.lit(": "), F.col("fault")))
    checked = _objects(lines, schema).withColumn("o", F.when(F.col("fault").isNull(), F.col("o")).otherwise(damaged))
    return checked.select("line_no", "o.*")


def heal_journal(spark: SparkSession, path: str) -> int:
    """Cuts an uncommitted tail off a journal file and tells its length in bytes; only the file's end is read, and committed lines are not written again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    length, tail, reach = store.getFileStatus(place).getLen(), b"", 65536
    while True:
        stream = store.open(place)
        stream.seek(max(0, length - reach))
        tail = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        if b"\n" in tail or reach >= length:
            break
        reach *= 4
    loose = len(tail) - (tail.rfind(b"\n") + 1)
    if loose:
        # a local store keeps sums beside its files, which only its raw form leaves alone
        local = is_instance_of(spark.sparkContext._gateway, store, "org.apache.hadoop.fs.ChecksumFileSystem")
        (store.getRawFileSystem() if local else store).truncate(place, length - loose)
        if local:
            store.getRawFileSystem().delete(store.getChecksumFile(place), False)
    return loose


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """A file's new content, in place at once: written beside it, then renamed over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if "://" in path else jvm.org.apache.hadoop.fs.FileContext.getLocalFSFileContext(conf)
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray(content.encode()))
    out.close()
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    store.rename(beside, target, renames)


def header_and_rows(spark: SparkSession, path: str, header: str, row: str) -> tuple[DataFrame, DataFrame]:
    """A file whose first record is a manifest and whose others are its rows."""
    lines = physical_lines(spark, path).filter(F.trim("value") != "").withColumn("kind", F.get_json_object("value", "$.record_type"))
    pick = lambda kind, schema: lines.filter(F.col("kind") == kind).select("line_no", F.from_json("value", schema).alias("o")).select("line_no", "o.*")
    return pick("manifest", header), pick("row", row)


def json_folder(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One object a file, keyed by the file's stem; `_a` files win over plain ones of a stem."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("_file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("_file", r"(_a)?\.json$", "")
    best = F.max_by(F.struct("*"), F.col("_file").endswith("_a.json").cast("int"))
    return rows.groupBy(stem.alias("key")).agg(best.alias("r")).select("key", "r.*").drop("_file")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def snapshot_dates(df: DataFrame, key: str, ok: Column, stamp: str, line: str) -> DataFrame:
    """Date of each key's last successful fetch."""
    return df.filter(ok).groupBy(key).agg(F.max_by(F.substring(F.col(stamp).cast("string"), 1, 10), line).alias("snapshot_date"))


def archive_dates(df: DataFrame, key: str, stamp: str, line: str) -> DataFrame:
    """Date of each key's first row, from a 14-digit time; a blank one fails."""
    first = df.groupBy(key).agg(F.min_by(F.coalesce(F.col(stamp).cast("string"), F.lit("")), line).alias("_stamp"))
    blank = F.raise_error(F.concat(F.lit("no snapshot time: "), F.col(key).cast("string")))
    good = F.when(F.trim("_stamp") == "", blank).otherwise(F.col("_stamp"))
    return first.select(key, F.regexp_replace(good, r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3").alias("snapshot_date"))
