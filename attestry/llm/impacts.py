"""Ranked lexical search: impact-ordered postings, taken score at a time.

The query set is taken in blocks of bounded vocabulary. For a block, one pass over
the documents leaves each one's length and its counts of the block's terms; N, L and
document frequencies are sums over that table. Every task then makes shards of its
documents, as many postings in each as SHARD says: a term's postings are grouped in
segments of equal impact, and a query takes the segments of its terms from the
highest impact down. What a document can still gain is at most the sum of the next
impact of each term. Once that bound leaves few documents that can be among the best
k (those of earlier shards of the task count too), their scores are completed from
the shard's rows by document. Tasks send k rows a query at most; these are merged by
groups of tasks and then by query, so no task gets the rows of all.

Defined results: null and empty texts have no terms and count neither in N nor in L;
each row is a document, repeated ones too; a null doc_id is ranked after all others
of its score; an item without terms, or whose terms no document has, has no rows;
items that share an identifier, or have none, are ranked each by itself; other
columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, arrow_rows, read_table

#: Terms of items in one block, about (a block holds one item at least), and postings in one shard.
HELD_TERMS, SHARD = 200_000, 2_000_000
#: Postings between the first two looks at the bound; each next stretch is twice as long.
STRETCH = 4096
#: Documents, as a multiple of k, that are completed once no others can be among the best.
COMPLETED = 4
#: Bytes of text that are split at once.
PART = 1 << 20

#: Letters and digits of ASCII, capitals made small, and all bytes of other characters; anything else separates.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(raw: bytes | None) -> Counter:
    """Occurrences of each term of a text in UTF-8; only a part of it is split at a time."""
    counts: Counter = Counter()
    if raw:
        spaced, at = raw.translate(_TERMS), 0
        while at < len(spaced):
            stop = spaced.find(b" ", at + PART) if at + PART < len(spaced) else -1
            stop = len(spaced) if stop < 0 else stop
            counts.update(spaced[at:stop].split())
            at = stop
    return counts


def _raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _spread(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    lengths = stops - starts
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Shard:
    """Documents of one task: segments of equal impact by term, and rows by document."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids = ids
        self.row_at = np.concatenate([[0], np.cumsum(lengths)])
        self.row_terms, self.row_impacts = terms, impacts
        order = np.lexsort((-impacts, terms))
        self.docs = np.repeat(np.arange(len(ids)), lengths)[order]
        terms, impacts = terms[order], impacts[order]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (impacts[1:] != impacts[:-1])
        starts = np.flatnonzero(new)
        self.at, self.impact = np.append(starts, len(terms)), impacts[starts]
        self.first = np.searchsorted(terms[starts], np.arange(n_terms + 1))
        self.wanted = np.zeros(n_terms, dtype=bool)

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents of which the best k, if over 0 and not under `least`, are all there."""
        first, last = self.first[terms], self.first[terms + 1]
        segments = _spread(first, last)
        of = np.repeat(np.arange(len(terms)), last - first)
        order = np.argsort(-self.impact[segments], kind="stable")
        segments, of = segments[order], of[order]
        gathered = np.cumsum(self.at[segments + 1] - self.at[segments])
        score, taken, done, stretch = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(terms), dtype=np.int64), 0, STRETCH
        while True:
            stop = min(int(np.searchsorted(gathered, (gathered[done - 1] if done else 0) + stretch)) + 1, len(segments))
            part = segments[done:stop]
            np.add.at(score, self.docs[_spread(self.at[part], self.at[part + 1])], np.repeat(self.impact[part], self.at[part + 1] - self.at[part]))
            taken += np.bincount(of[done:stop], minlength=len(terms))
            done, stretch = stop, stretch * 2
            following = first + taken
            bound = int(self.impact[following[following < last]].sum())
            kth = int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0
            alive = np.flatnonzero(score + bound >= max(kth, least, 1))
            if done == len(segments):
                return alive, score[alive]
            if len(alive) <= COMPLETED * k:
                return alive, self.complete(alive, terms)

    def complete(self, places: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of the documents at these places."""
        starts, stops = self.row_at[places], self.row_at[places + 1]
        rows = _spread(starts, stops)
        self.wanted[terms] = True
        gained = np.where(self.wanted[self.row_terms[rows]], self.row_impacts[rows], 0)
        self.wanted[terms] = False
        out = np.zeros(len(places), dtype=np.int64)
        np.add.at(out, np.repeat(np.arange(len(places)), stops - starts), gained)
        return out


class _Best:
    """The best k of a query so far: scores, whether the identifier is null, identifiers."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids[:, 1], ids[:, 0], -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def _counts(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's length and its counts of the terms that have a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.keys()
        for batch in batches:
            n, terms, tfs = [], [], []
            for raw in _raw(batch, "text"):
                counts = term_counts(raw)
                hits = counts.keys() & known
                n.append(counts.total())
                terms.append([numbers[t] for t in hits])
                tfs.append([counts[t] for t in hits])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _found(counted: DataFrame, asked: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): each task's best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in asked]

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            n, terms, tfs = (table.column(c).combine_chunks() for c in ("n", "terms", "tfs"))
            lengths = terms.value_lengths().to_numpy()
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            m = 50 + (50 * n.to_numpy() * n_docs) // n_all
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, lengths)))
            doc = table.column("doc_id").combine_chunks()
            ids = np.stack([doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), doc.fill_null(0).to_numpy()], axis=1)
            shard = Shard(ids, lengths, term, impact, len(weights))
            for mine, (_, wanted) in zip(best, asked, strict=True):
                places, score = shard.search(wanted, k, mine.least())
                mine.take(score, ids[places])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= SHARD:
                search(held)
                held, size = [], 0
        if size:
            search(held)
        for at in range(0, len(asked), 1000):
            part = best[at : at + 1000]
            sizes = [len(b.score) for b in part]
            null, doc = np.concatenate([b.id for b in part]).T
            item = [asked[at + i][0] for i, size in enumerate(sizes) for _ in range(size)]
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(np.arange(at, at + len(part)), sizes), pa.int64()), "item_id": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "score": pa.array(np.concatenate([b.score for b in part]), pa.int64())})

    return counted.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query: by groups of tasks, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `queries` (item_id, text) the k best of `docs` (doc_id, text)."""
    arrow_rows(docs.sparkSession, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "terms": pa.array([sorted(term_counts(raw)) for raw in _raw(batch, "text")], pa.list_(pa.binary()))})

    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(split, "item_id long, terms array<binary>").filter(F.size("terms") > 0)
    asked = scratch.written(asked)
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / HELD_TERMS))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()  # about HELD_TERMS terms
        numbers = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
        counted = scratch.written(_counts(docs, numbers))
        n_docs, n_all = counted.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # at most as many as the block's terms
        weights = np.zeros(len(numbers), dtype=np.int64)
        for r in frequency:
            weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        wanted = [(r.item_id, np.array([numbers[bytes(t)] for t in r.terms], dtype=np.int64)) for r in rows]
        best = scratch.written(_ranked(_found(counted, wanted, weights, n_docs, n_all or 1, k), k))
        out = best if out is None else out.unionByName(best)
    return scratch.result(out)


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents of the highest score for each item of `benchmark`."""
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM lengths),
norms AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_all AS m FROM lengths CROSS JOIN totals),
counts AS (SELECT term, doc_id, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts CROSS JOIN totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
