"""Exact dedup with an extendible-hash index on shared files.

Each task normalises its rows, chains equal texts by comparing bytes and writes
one index page row per document to the shared folder; only the first row of a
text in a task, its head, carries the bytes, with the count and the best member
of its chain. Heads are counted by leading key bits, and the directory is grown from
these counts: a bucket over capacity is split by one more bit, doubling the directory's
array where its depth was reached. Owner tasks take whole buckets (key ranges), chain heads whose
64-bit keys collide and compare their bytes, and return what stays for each
head. Members find their head's result by its id, so a text with a third of all
rows costs one head per task and no task meets its members.

Defined results: null text counts as empty; empty texts are one group; of equal
texts the row with the most code points, then the smallest id, stays; texts of
any length are compared whole; an empty table gives an empty table; other
columns are ignored; repeated rows are copies of each other; a null id comes after
all others; rows that share the id of the one that stays count as kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import ASCII_SPACE, ROW_KEY, arrow_rows, checkpointed, keyed, one_row_a_key, read_table, shuffle_width

#: Leading key bits that the histogram counts; the directory never gets deeper.
MAX_DEPTH = 16
#: Heads that a bucket holds before it is split.
CAPACITY = 2048

_PAGE = "doc_id long, head_id long, prefix int, key long, text_sha256 string, body binary, members long, best_chars long, best_id long"


class Directory:
    """An extendible-hash directory: an array with a place for each value of the leading `depth` bits, and the bucket that each place leads to.

    Several places lead to one bucket while that needs fewer bits. A bucket over
    capacity is split by its next bit; if it has as many bits as the array, the array
    doubles first. Buckets hold counts of heads by cell, a cell being MAX_DEPTH bits;
    one cell is never split.
    """

    def __init__(self, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH):
        self.capacity, self.max_depth = capacity, max_depth
        self.depth, self.places = 0, [0]
        self.depths: list[int] = [0]
        self.cells: list[dict[int, int]] = [{}]
        self.sizes: list[int] = [0]

    def insert(self, cell: int, heads: int) -> None:
        bucket = self.places[cell >> (self.max_depth - self.depth)]
        self.cells[bucket][cell] = self.cells[bucket].get(cell, 0) + heads
        self.sizes[bucket] += heads
        # a bucket was within capacity before, so only the half with this cell can be over it
        while self.sizes[bucket] > self.capacity and self.depths[bucket] < self.max_depth:
            self._split(bucket, cell)
            bucket = self.places[cell >> (self.max_depth - self.depth)]

    def _split(self, bucket: int, cell: int) -> None:
        if self.depths[bucket] == self.depth:
            self.places = [p for p in self.places for _ in range(2)]
            self.depth += 1
        self.depths[bucket] += 1
        bit = self.max_depth - self.depths[bucket]
        moved = {c: n for c, n in self.cells[bucket].items() if c >> bit & 1}
        self.cells[bucket] = {c: n for c, n in self.cells[bucket].items() if not c >> bit & 1}
        self.sizes[bucket] = sum(self.cells[bucket].values())
        self.depths.append(self.depths[bucket])
        self.cells.append(moved)
        self.sizes.append(sum(moved.values()))
        # the upper half of the places that led to the bucket
        low = cell >> (bit + 1) << (bit + 1)
        first, last = low + (1 << bit) >> (self.max_depth - self.depth), low + (2 << bit) - 1 >> (self.max_depth - self.depth)
        self.places[first : last + 1] = [len(self.depths) - 1] * (last + 1 - first)

    def buckets(self) -> list[tuple[int, int, int]]:
        """(first cell, last cell, depth) of each bucket, in order."""
        out, at = [], 0
        while at < len(self.places):
            depth = self.depths[self.places[at]]
            span = 1 << (self.depth - depth)
            out.append((at << (self.max_depth - self.depth), (at + span << (self.max_depth - self.depth)) - 1, depth))
            at += span
        return out


def build_directory(histogram: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets (first cell, last cell, depth) of a directory after all heads, counted by cell, have gone in."""
    directory = Directory(capacity, max_depth)
    for cell, heads in histogram.items():
        directory.insert(cell, heads)
    return directory.buckets()


def _before(chars: int, doc_id: int | None, best_chars: int, best_id: int | None) -> bool:
    """Whether a row stays rather than the best so far: more code points, then the smaller id, null last."""
    return (-chars, doc_id is None, doc_id or 0) < (-best_chars, best_id is None, best_id or 0)


def _pages(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # a head's id names its task, so that a document's id need not be unique
        next_head = TaskContext.get().partitionId() << 40
        # chains: 64-bit key -> [head id, members, most chars, best id, digest, body]
        chains: dict[int, list[list]] = {}
        for batch in batches:
            ids, heads, prefixes, keys, digests = [], [], [], [], []
            for doc_id, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                text = text or ""
                body = text.encode().translate(None, ASCII_SPACE)
                digest = hashlib.sha256(body)
                key = int.from_bytes(digest.digest()[:8], "big")
                chain = chains.setdefault(key, [])
                head = next((h for h in chain if h[5] == body), None)
                if head is None:
                    head = [next_head, 1, len(text), doc_id, digest.hexdigest(), body]
                    chain.append(head)
                    next_head += 1
                else:
                    head[1] += 1
                    if _before(len(text), doc_id, head[2], head[3]):
                        head[2], head[3] = len(text), doc_id
                ids.append(doc_id)
                heads.append(head[0])
                keys.append(key - (1 << 63))
                prefixes.append(key >> (64 - MAX_DEPTH))
                digests.append(digest.hexdigest())
            n = len(ids)
            yield _page(ids, heads, prefixes, keys, digests, [None] * n, [None] * n, [None] * n, [None] * n)
        rows = [(key, h) for key, chain in chains.items() for h in chain]
        for at in range(0, len(rows), 1000):
            part = rows[at : at + 1000]
            yield _page([None] * len(part), [h[0] for _, h in part], [k >> (64 - MAX_DEPTH) for k, _ in part], [k - (1 << 63) for k, _ in part], [h[4] for _, h in part], [h[5] for _, h in part], [h[1] for _, h in part], [h[2] for _, h in part], [h[3] for _, h in part])

    return run


def _page(ids, heads, prefixes, keys, digests, bodies, members, chars, best) -> pa.RecordBatch:
    wide = pa.int64()
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, wide), "head_id": pa.array(heads, wide), "prefix": pa.array(prefixes, pa.int32()), "key": pa.array(keys, wide), "text_sha256": pa.array(digests, pa.string()), "body": pa.array(bodies, pa.binary()), "members": pa.array(members, wide), "best_chars": pa.array(chars, wide), "best_id": pa.array(best, wide)})


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order: one key's heads at a time, chained by their bytes."""

    def settle(heads: list[tuple]) -> list[tuple]:
        chains: list[list] = []
        for head_id, body, members, chars, best in heads:
            chain = next((c for c in chains if c[0] == body), None)
            if chain is None:
                chain = [body, 0, -1, 0, []]
                chains.append(chain)
            chain[1] += members
            if _before(chars, best, chain[2], chain[3]):
                chain[2], chain[3] = chars, best
            chain[4].append(head_id)
        return [(head_id, c[3], c[1]) for c in chains for head_id in c[4]]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("head_id", "keep_id", "group_size"))})

    now, heads = None, []
    for batch in batches:
        out = []
        for key, *head in zip(*(batch.column(c).to_pylist() for c in ("key", "head_id", "body", "members", "best_chars", "best_id")), strict=True):
            if key != now:
                out += settle(heads)
                now, heads = key, []
            elif heads and head[1] == heads[0][1]:
                head[1] = heads[0][1]  # equal bytes are held once
            heads.append(tuple(head))
        if out:
            yield packed(out)
    if heads:
        yield packed(settle(heads))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    arrow_rows(spark)
    pages = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pages("doc_id", "text"), _PAGE))
    heads = pages.filter("members IS NOT NULL")
    histogram = {r.prefix: r.n for r in heads.groupBy("prefix").agg(F.count("*").alias("n")).collect()}
    directory = build_directory(histogram)
    # at most 2^MAX_DEPTH rows
    slots = spark.createDataFrame([(p, b) for b, (first, last, _) in enumerate(directory) for p in range(first, last + 1) if p in histogram], "prefix int, bucket int")
    owned = heads.join(F.broadcast(slots), "prefix").select("bucket", "key", "head_id", "body", "members", "best_chars", "best_id")
    owned = owned.repartition(max(shuffle_width(spark), 2 * len(directory)), "bucket").sortWithinPartitions("key", "head_id")
    settled = owned.mapInArrow(_own, "head_id long, keep_id long, group_size long")
    members = pages.filter("members IS NULL").select("doc_id", "head_id", "text_sha256")
    found = members.join(settled, "head_id")
    return found.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all of `documents`."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts exactly one row stays, whatever the identifiers.

    Defined results: null and empty texts are one group; rows with null or shared
    identifiers are told apart by their texts; of wholly equal rows one stays; very
    long texts are compared whole; an empty table stays empty; all columns, of
    whatever names, keep their values.
    """
    rows = keyed(docs)
    kept = exact_groups(rows.select(F.col(ROW_KEY).alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias(ROW_KEY))
    return one_row_a_key(rows.join(kept, ROW_KEY, "left_semi"), docs.columns)


#: DuckDB SQL for op9's rows.
OP9_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
"""
