"""Substring dedup by bucket-pointer refinement over content-chosen suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else.

Sorting every suffix is not needed: each window of `length` bytes holds a q-gram
whose hash is least among the window's q-grams, and equal windows choose equal
offsets. Those q-grams, the anchors, are the suffixes whose buckets are refined.
A window is then an anchor and an alignment, the anchor's offset in the window;
the windows that choose one anchor are a run of alignments.

1. Initial buckets: anchors by q-gram. A bucket of one holds no repeat and goes.
2. An anchor whose whole run of windows equals another's is settled at once: all
   its windows repeat. One representative stays.
3. The others' buckets are refined: alignments are cut into ranges, and the
   bucket of a range is the identifier (a 128-bit digest) of the bytes that all
   its windows share, which reach from earlier to later offsets than the parent
   bucket's. Buckets of one go; a range whose bytes all repeat is settled, and
   again one representative stays; the rest is refined recursively with the new
   identifiers down to single windows.

Counts are pre-aggregated before each shuffle and equal surroundings collapse,
so thousands of copies or a passage in a third of all rows are a few bucket rows
each, and no bucket is ever gathered in a task.

Defined results: a null text is empty (0 bytes, 0 spans, digest of no bytes);
texts under `length` bytes stay whole; repeated rows are copies of each other;
very long texts are hashed in overlapping chunks; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import ROW_KEY, arrow_rows, checkpointed, keyed, read_table

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of an anchor.
GRAM = 64
#: Windows whose anchors are found at once in a very long text.
CHUNK = 1 << 18
#: Alignments in a range, level by level.
RANGES = (23, 4, 1)

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(0, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size, base = max(n, 1 << 14), _BASE[which]
        rows = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        _POWERS[which] = (rows[0], rows[1])
    up, down = _POWERS[which]
    return up[:n], down[:n]


class _Rolling:
    """Hashes of all substrings of one length of a byte array."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[which][data] * up[:-1], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        return self._mixed((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])

    def between(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[stops] - self.sums[starts]) * self.down[starts])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return pick(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors' positions and q-gram hashes, least and most alignment, and two hashes of the run of windows."""
    span, n = length - gram, len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64, np.uint64))
    found = []
    for start in range(0, n - length + 1, CHUNK):
        stop = min(start + CHUNK, n - length + 1)  # of the windows' starts
        # windows before and after, so that a run is whole wherever a chunk ends
        low, high = max(0, start - span), min(n, stop + span + length)
        one, two = _Rolling(data[low:high], 0), _Rolling(data[low:high], 1)
        hashes = one.all(gram)
        # the upper half of the hash, then the place: the least is the leftmost of equals
        order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (_sliding(order, span + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        last = np.append(first[1:], len(chosen)) - 1
        pos = chosen[first]
        # a run belongs to the chunk in which it begins
        mine = (first + low >= start) & (first + low < stop) if start else first + low < stop
        pos, first, last = pos[mine], first[mine], last[mine]
        runs = np.zeros((2, len(pos)), dtype=np.uint64)
        for i, rolling in enumerate((one, two)):
            runs[i] = rolling.between(first, last + length)
        found.append((pos + low, hashes[pos], pos - last, pos - first, runs[0], runs[1]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _released(spark: SparkSession) -> None:
    """Shuffle files of steps that are done can go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _anchor_rows(length: int, gram: int, only_hash: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = anchors(np.frombuffer((text or "").encode(), dtype=np.uint8), length, gram)
                held.append((np.full(len(got[0]), doc_id, dtype=np.int64), *got))
            if not held:
                continue
            doc, pos, h, least, most, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            out = {"h": pa.array(h.view(np.int64))}
            if not only_hash:
                # a place in a text and its alignments in one number
                out |= {"doc_id": pa.array(doc), "place": pa.array(pos << 20 | least << 10 | most), "run": pa.array(one.view(np.int64)), "run2": pa.array(two.view(np.int64))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _bits(column: str, shift: int, width: int):
    return F.shiftright(column, shift).bitwiseAND(F.lit((1 << width) - 1))


def _surroundings(length: int):
    """Rows of documents with places: each anchor's run of windows as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                data = (text or "").encode()
                for place in places:
                    pos, least, most = place >> 20, place >> 10 & 1023, place & 1023
                    rows.append((doc_id, place, data[pos - most : pos - least + length]))
                if len(rows) > 20_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary()))
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})

    return run


def _refined(length: int, size: int):
    """Each range of alignments cut into ranges of `size`: identifiers of the shared and of all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            out = []
            for doc_id, place, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "bytes", "ranges")), strict=True):
                least, most = place >> 10 & 1023, place & 1023
                for r in ranges:
                    for lo in range(r >> 10, (r & 1023) + 1, size):
                        hi = min(lo + size - 1, r & 1023)
                        if hi < least or lo > most:
                            continue
                        # the bytes from the anchor - lo to the anchor - hi + length; data begins at the anchor - most
                        shared = xxh3_64_intdigest(data[max(0, most - lo) : most - hi + length]) if lo <= most and hi >= least else 0
                        whole = xxh3_128_digest(data[most - hi : most - lo + length]) if lo >= least and hi <= most else None
                        out.append((doc_id, place, lo << 10 | hi, shared - (1 << 63), whole))
            kinds = (("doc_id", pa.int64()), ("place", pa.int64()), ("range", pa.int32()), ("shared", pa.int64()), ("whole", pa.binary()))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})

    return run


def _settled(rows: DataFrame, key: list[str], known: str, keep: list[str]) -> DataFrame:
    """`keep` and, where `known` holds and the key occurs again, `again`; `one` marks one row of such a key."""
    # a written table, so that the join deals both sides anew and can split a hot key
    twice = checkpointed(rows.filter(known).groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).filter("n > 1"))
    return rows.join(twice, key, "left").select(*keep, F.col("n").isNotNull().alias("again"), F.coalesce(F.col("first.doc_id") == F.col("doc_id"), F.lit(False)).__and__(F.coalesce(F.col("first.place") == F.col("place"), F.lit(False))).alias("one"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, but_first: bool = False) -> DataFrame:
    """(doc_id, spans): packed byte ranges (start << 12 | bytes), unmerged, of documents that have repeated windows.

    Rows of one doc_id have to be wholly equal, as those of `keyed` are. With
    `but_first`, a window's first occurrence, by doc_id and place, is no range.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    span = length - gram
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_enough = texts.filter(F.octet_length("text") >= length)
    # a written table, so that the join below deals both sides anew and can split a hot bucket
    shared = checkpointed(long_enough.mapInArrow(_anchor_rows(length, gram, True), "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    every = long_enough.mapInArrow(_anchor_rows(length, gram, False), "h long, doc_id long, place long, run long, run2 long")
    held = checkpointed(every.join(shared, "h", "left_semi"))
    _released(spark)

    def marked(tagged: DataFrame, lo, hi) -> DataFrame:
        """One row a document: the bytes of its repeated windows."""
        start = F.shiftright("place", 20) - hi
        return tagged.filter("again AND NOT one" if but_first else "again").groupBy("doc_id").agg(F.collect_list(F.shiftleft(start, 12) + (hi - lo + length)).alias("spans"))

    # anchors whose whole run of windows repeats are settled; one of each stays as a partner for others
    place_range = (_bits("place", 10, 10), _bits("place", 0, 10))
    tagged = checkpointed(_settled(held.withColumn("alignments", F.col("place").bitwiseAND(F.lit((1 << 20) - 1))), ["h", "alignments", "run", "run2"], "true", ["h", "doc_id", "place"]))
    del held
    marks = [checkpointed(marked(tagged, *place_range))]
    left = tagged.filter("NOT again OR one").select("h", "doc_id", "place", "again")
    worth = left.groupBy("h").agg(F.count("*").alias("n"), F.min("again").alias("settled")).filter("n > 1 AND NOT settled").select("h")
    places = left.join(worth, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    runs = checkpointed(long_enough.join(places, "doc_id").mapInArrow(_surroundings(length), "doc_id long, place long, bytes binary"))
    del tagged, left, worth, places
    _released(spark)

    ranges = runs.select("doc_id", "place", F.array(F.lit(span)).alias("ranges"))
    for size in RANGES:
        rows = checkpointed(runs.join(ranges, ["doc_id", "place"]).mapInArrow(_refined(length, size), "doc_id long, place long, range int, shared long, whole binary"))
        tagged = checkpointed(_settled(rows, ["range", "whole"], "whole IS NOT NULL", ["doc_id", "place", "range", "shared"]))
        marks.append(checkpointed(marked(tagged, _bits("range", 10, 10), _bits("range", 0, 10))))
        del rows
        left = tagged.filter("NOT again OR one")
        worth = left.groupBy("range", "shared").agg(F.count("*").alias("m")).filter("m > 1").select("range", "shared")
        ranges = left.join(worth, ["range", "shared"], "left_semi").groupBy("doc_id", "place").agg(F.collect_list("range").alias("ranges"))
        if size > 1:
            ranges = checkpointed(ranges)
        del tagged, left, worth
        _released(spark)
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for span in sorted(spans or ()):
        start, stop = span >> 12, (span >> 12) + (span & 4095)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    return b"".join([*kept, data[at:]])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, runs = (text or "").encode(), _merged(spans)
            kept = _without(data, runs)
            rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        wide = pa.int64()
        columns = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("n_bytes", wide), ("n_removed", wide), ("n_spans", wide), ("kept_sha256", pa.string())))}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)


#: Not a name that a table has.
_SPANS = "repeated spans"


def with_spans(docs: DataFrame, length: int = LENGTH, but_first: bool = False) -> DataFrame:
    """`docs` and their repeated ranges; rows with null or shared identifiers are told apart by their texts."""
    rows = keyed(docs)
    spans = repeated_ranges(rows.select(F.col(ROW_KEY).alias("doc_id"), "text"), length, but_first=but_first)
    return rows.join(spans.select(F.col("doc_id").alias(ROW_KEY), F.col("spans").alias(_SPANS)), ROW_KEY, "left").select(*docs.columns, _SPANS)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document of `documents`, and the digest of what stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).withColumnRenamed(_SPANS, "spans").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, but_first: bool = False) -> DataFrame:
    """`docs` with the repeated bytes cut from `text`; bytes of a character cut in two go with it."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else _without(t.encode(), _merged(s)).decode(errors="ignore") for t, s in zip(batch.column("text").to_pylist(), batch.column(_SPANS).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return with_spans(docs, length, but_first).mapInArrow(run, fields)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every repeated passage the first occurrence stays, the others are cut from their texts.

    First is the smallest key, then the earliest place. Defined results: every row
    stays; null texts stay null, texts without a repeat as they are; of wholly equal
    rows each is cut like the other; n_chars, where it is there, follows the text; all other
    columns, of whatever names, keep their values; an empty table stays empty.
    """
    out = without_repeats(docs, but_first=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
