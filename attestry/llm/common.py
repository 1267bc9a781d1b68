"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that several contracts name: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's own readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where that is unset (tests, local sessions) one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors share no other folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that a loop writes to the shared folder to cut its lineage, and drops once its result is written.

    A checkpoint keeps the planner's estimate of its size, and that of a join is a
    product, so that in a loop of joins it grows to numbers of millions of digits. A
    table's size is what it is.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """The table of `df`, the only one that stays."""
        spark, before = df.sparkSession, len(self.paths)
        out = self.written(df)
        for path in self.paths[:before]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = self.paths[before:]
        return out


#: Names that a table hardly has: the key of a row, and whether its identifier is shared.
ROW_KEY, SHARED, _OF = "key of the row", "identifier is shared", "shared identifier"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with ROW_KEY, a long, and SHARED.

    The key is the identifier, or, where that is null or more than one row's, a hash
    of identifier and text: rows of one key have equal identifiers and texts.
    """
    key = F.col(id_col).cast("long")
    shared = checkpointed(docs.groupBy(key.alias(_OF)).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(_OF).isNull()).select(_OF))
    if not shared.head(1):
        return docs.withColumn(ROW_KEY, key).withColumn(SHARED, F.lit(False))
    marked = docs.join(shared.select(_OF, F.lit(True).alias(SHARED)), key.eqNullSafe(F.col(_OF)), "left").drop(_OF)
    flag = F.coalesce(F.col(SHARED), F.lit(False))
    return marked.withColumn(SHARED, flag).withColumn(ROW_KEY, F.when(flag, F.xxhash64(key, F.col(text_col))).otherwise(key))


def one_row_a_key(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `keyed` rows, one of each key; only rows with shared identifiers are grouped."""
    alone = rows.filter(~F.col(SHARED)).select(columns)
    some = rows.filter(F.col(SHARED)).groupBy(ROW_KEY).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("r"))
    return alone.unionByName(some.select("r.*"))


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def key_remainder(col: str, mod: int) -> Column:
    """crc32 of the identifier's decimal text, modulo `mod`."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def crc_mod(doc_id: int, mod: int) -> int:
    """The same remainder for one identifier in Python."""
    return zlib.crc32(str(doc_id).encode()) % mod


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
