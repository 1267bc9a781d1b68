"""Lines and quoted records of text files, read in as many tasks as the files have blocks.

A block's rows are counted where they are read; counts of the blocks before it turn a
row's place in its block into its place in the file. Whether a line begins inside
quotes is the parity of the quotes before it, found the same way. The lines of a
record are put together where its block is read; only what lies on a block's border
is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.operators.ranks import checkpoint_folder

_BLOCK = ["file", "block"]
#: Rows of a table by block that every task may get (some 128 MB of text stand behind each).
SENT = 100_000


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are between line feeds, with the file and the block that they were read from."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("file_bytes"), "value")


def _kept(df: DataFrame) -> DataFrame:
    """A table in the shared folder."""
    place = f"{checkpoint_folder(df.sparkSession)}/blocks/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def written(df: DataFrame) -> DataFrame:
    """A table by file or block in the shared folder, marked to be sent to all tasks if it has at most SENT rows."""
    back = _kept(df)
    return F.broadcast(back) if back.count() <= SENT else back


def _before(blocks: DataFrame, *sums: str) -> DataFrame:
    """Sums over the blocks before each one of its file; one row a block."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of `_raw`, perhaps without some, with each one's place in its file, from 0, how many there are in it, and whether each has its line feed."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    blocks = marked.groupBy(*_BLOCK).agg(F.min("_id").alias("_first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("size"), F.first("file_bytes").alias("bytes"))
    file = Window.partitionBy("file")
    blocks = _before(blocks, "n").withColumns({"n_all": F.sum("n").over(file), "all_fed": F.sum("size").over(file) <= F.col("bytes")}).drop("n", "size", "bytes")
    out = marked.join(written(blocks), _BLOCK)
    return out.withColumn("place", F.col("n_before") + F.col("_id") - F.col("_first")).drop("_id", "_first", "n_before")


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, is_last, is_closed): all lines, numbered from 0 in each file; a last line may lack its line feed."""
    lines = _placed(_raw(spark, path))
    last = F.col("place") == F.col("n_all") - 1
    return lines.select("file", F.col("place").alias("line_no"), "value", last.alias("is_last"), (F.col("all_fed") | ~last).alias("is_closed"))


def _quotes(value: str):
    return F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Lines of one block at a time, in their order: file and block, the lines, the quotes in each, and which are blank."""
    for batch in batches:
        n = batch.num_rows
        differs = np.zeros(max(0, n - 1), dtype=bool)
        for name in _BLOCK:
            c = batch.column(name)
            differs |= pc.not_equal(c.slice(1), c.slice(0, max(0, n - 1))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
        for low, high in zip(edges, edges[1:], strict=False):
            if run := batch.slice(low, high - low):
                value = run.column("value")
                quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
                blank = pc.equal(pc.ascii_rtrim(value, "\r"), "").to_numpy(zero_copy_only=False)
                yield (run.column("file")[0].as_py(), run.column("block")[0].as_py()), run, quotes, blank


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, its quotes and how many records begin in it, if it begins outside quotes and if inside."""
    totals: dict[tuple[str, int], np.ndarray] = {}  # of the blocks of a task
    for block, _, quotes, blank in _runs(batches):
        so_far = totals.setdefault(block, np.zeros(3, dtype=np.int64))
        odd = (so_far[0] + np.cumsum(quotes) - quotes) % 2 == 1
        so_far += [quotes.sum(), (~odd & ~blank).sum(), (odd & ~blank).sum()]
    names = [*_BLOCK, "quotes", "begun_outside", "begun_inside"]
    columns = [pa.array([b[0] for b in totals], pa.string()), pa.array([b[1] for b in totals], pa.int64())]
    yield pa.RecordBatch.from_arrays([*columns, *[pa.array([int(t[i]) for t in totals.values()], pa.int64()) for i in range(3)]], names=names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block, lines put together; what a block has of a record that begins before it or ends after it is marked as a part."""

    def out(values: pa.Array, bounds: list[int], number: int, quotes: int, in_part: bool) -> pa.RecordBatch:
        n = len(bounds) - 1
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), "\n")
        of = [pa.repeat(pa.scalar(block[0], pa.string()), n), pa.repeat(pa.scalar(block[1], pa.int64()), n), pa.array(range(number, number + n), pa.int64())]
        return pa.RecordBatch.from_arrays([*of, text, pa.repeat(pa.scalar(quotes, pa.int64()), n), pa.repeat(in_part, n)], names=["file", "block", "record_no", "value", "quotes", "in_part"])

    def closed(over: bool) -> Iterator[pa.RecordBatch]:
        """The record whose lines are held; `over`: the block has no more lines."""
        if held:
            values = pa.concat_arrays(held)
            yield out(values, [0, len(values)], number, held_quotes, from_before or over and held_quotes % 2 == 1)

    block, held, held_quotes, number, from_before, inside = None, [], 0, 0, False, 0
    for here, run, quotes, blank in _runs(batches):
        if here != block:
            yield from closed(True)
            from_before = run.column("inside")[0].as_py()
            block, held, held_quotes, number, inside = here, [], 0, run.column("begun_before")[0].as_py() - 1, int(from_before)
        within = (inside + np.cumsum(quotes) - quotes) % 2 == 1
        inside = (inside + int(quotes.sum())) % 2
        stays = within | ~blank
        value, quotes, begins = run.column("value").filter(pa.array(stays)), quotes[stays], np.flatnonzero(~within[stays])
        first = int(begins[0]) if len(begins) else len(value)
        if first:
            held.append(value.slice(0, first))
            held_quotes += int(quotes[:first].sum())
        if len(begins):
            yield from closed(False)
            if len(begins) > 1:
                yield out(value.slice(first), (begins - first).tolist(), number + 1, 0, False)
            last = int(begins[-1])
            number, from_before, held, held_quotes = number + len(begins), False, [value.slice(last)], int(quotes[last:].sum())
    yield from closed(True)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_no, value, is_whole): records whose quoted cells may hold line ends, numbered from 0 in each file; blank lines outside quotes are none.

    A record is not whole if the file ends inside its quotes.
    """
    raw = _raw(spark, path)
    blank = F.rtrim(F.col("value"), F.lit("\r")) == ""
    if not raw.filter(_quotes("value") % 2 == 1).limit(1).collect():
        return _placed(raw.filter(~blank)).select("file", F.col("place").alias("record_no"), F.regexp_replace("value", "\r$", "").alias("value"), F.lit(True).alias("is_whole"))

    lines = raw.select(*_BLOCK, "value")
    counts = _before(lines.mapInArrow(_counted, "file string, block long, quotes long, begun_outside long, begun_inside long"), "quotes")
    inside = F.col("quotes_before") % 2 == 1
    begun = _before(counts.select(*_BLOCK, inside.alias("inside"), F.when(inside, F.col("begun_inside")).otherwise(F.col("begun_outside")).alias("begun")), "begun")
    parts = lines.join(written(begun.drop("begun")), _BLOCK).mapInArrow(_gathered, "file string, block long, record_no long, value string, quotes long, in_part boolean")
    pieces = F.sort_array(F.collect_list(F.struct("block", "value")))
    torn = parts.filter("in_part").groupBy("file", "record_no").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"), (F.sum("quotes") % 2 == 0).alias("is_whole"))  # at most one record a block
    records = parts.filter("NOT in_part").select("file", "record_no", "value", F.lit(True).alias("is_whole")).union(_kept(torn))
    return records.withColumn("value", F.regexp_replace("value", "\r$", ""))
