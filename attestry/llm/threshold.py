"""Exact top-k inner products by Fagin's threshold algorithm.

Components become whole numbers. Every task makes shards of its vectors: equal
vectors are one node with as many of their smallest ids as any query can need, and
each dimension is a sorted list of the nodes. A query goes down the lists of its dimensions side by side, from
the top where its component is positive and from the bottom where it is negative;
nodes that it meets for the first time get their whole inner product. What the lists
say at the present depth bounds every node not met. The query stops once that bound
is below its kth score so far, of this shard and those that the task had before, or
once all nodes are met. Queries are sent to the tasks in blocks of a bounded number;
no vector is shuffled. A task sends k rows a query at most; these are merged by
groups of tasks and then by query.

Whole numbers are held in doubles where no sum of products can reach 2^53, which is
exact, and in Python's integers beyond; a score that a long cannot hold counts as the
nearest long.

Defined results: null vectors, those with null or non-finite components, those
without an id and those of another dimension than most take no part; zero vectors do.
Each row is a candidate, repeated ones too, but a query never finds rows of its own
id; a row that repeats a query's id and vector asks nothing new. Ties go to the smaller id;
fewer candidates than wanted give fewer rows; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, arrow_rows, read_table

#: Queries in one block, about, and vectors in one shard.
BLOCK, SHARD = 8192, 65_536
#: Entries of each list that are read before the first look at the bound; each next stretch is twice as long.
STRETCH = 8
#: Doubles hold every whole number below this.
EXACT = 2**53
_LONG = np.iinfo(np.int64)


def _whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles, or Python's integers if scaling overflows."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[math.floor(int(scale) * int(x)) if abs(x) >= EXACT else math.floor(scale * x) for x in v] for v in vectors.tolist()], dtype=object)


def _as_long(score) -> int:
    return min(max(int(score), int(_LONG.min)), int(_LONG.max))


def _held(score: np.ndarray) -> np.ndarray:
    """Scores that a long can hold."""
    return np.array([_as_long(s) for s in score], dtype=object) if score.dtype == object else score


class _Best:
    """The best k of a query so far, best first: scores and ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0), np.zeros(0, dtype=np.int64)

    def least(self):
        return self.score[-1] if len(self.score) == self.k else -math.inf

    def take(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if score.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k], dtype=np.int64)
        else:
            order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class SortedLists:
    """Nodes of one shard and, for each dimension, their order by that component."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray]):
        self.points = points
        self.id_at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        self.ids = np.concatenate(ids)
        self.order = np.argsort(points, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(points.T, self.order, axis=1)
        self.largest = max((abs(int(x)) for x in (points.min(), points.max())), default=0)

    def search(self, query: np.ndarray, own: int, best: _Best) -> int:
        """Takes into `best` what of this shard belongs there, and tells how many nodes were scored."""
        n, d = self.points.shape
        points, values = self.points, self.values
        if query.dtype == object or self.largest * max((abs(int(x)) for x in query), default=0) * d >= EXACT:
            whole = lambda x: x if x.dtype == object else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
            query, points, values = whole(query), whole(points), whole(values)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met, n_met, depth, stretch = np.zeros(n, dtype=bool), 0, 0, STRETCH
        if not len(up) + len(down):
            depth, n_met = n, n
            self._offer(np.arange(n), np.zeros(n), own, best)
        while n_met < n and depth < n:
            stop = min(depth + stretch, n)
            near = np.concatenate([self.order[up, n - stop : n - depth].ravel(), self.order[down, depth:stop].ravel()])
            new = np.zeros(n, dtype=bool)
            new[near] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            n_met += len(new)
            if len(new):
                self._offer(new, _held(points[new] @ query), own, best)
            bound = (values[up, n - stop] * query[up]).sum() + (values[down, stop - 1] * query[down]).sum()
            bound = bound if query.dtype != object else _as_long(bound)
            if bound < best.least():  # at equality one not met may have a smaller id
                break
            depth, stretch = stop, stretch * 2
        return n_met

    def _offer(self, nodes: np.ndarray, score: np.ndarray, own: int, best: _Best) -> None:
        if len(nodes) > 8 * best.k and score.dtype != object:
            kth = max(np.partition(score, len(score) - best.k - 1)[len(score) - best.k - 1], best.least())  # one of them may be the query's own
        else:
            kth = best.least()
        good = score >= kth
        nodes, score = nodes[good], score[good]
        lengths = self.id_at[nodes + 1] - self.id_at[nodes]
        at = np.arange(lengths.sum()) + np.repeat(self.id_at[nodes] - np.cumsum(lengths) + lengths, lengths)
        ids, score = self.ids[at], np.repeat(score, lengths)
        other = ids != own
        best.take(score[other], ids[other])


def finite(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _shard(ids: np.ndarray, vectors: np.ndarray, k: int) -> SortedLists:
    """Equal vectors become one node with its 2 k smallest ids, each at most k times: k are left without any one of them."""
    numeric = vectors.astype(np.float64)
    _, first, node = np.unique(numeric, axis=0, return_index=True, return_inverse=True)
    if vectors.dtype == object:
        seen: dict[tuple, int] = {}
        node = np.array([seen.setdefault(tuple(v), len(seen)) for v in vectors.tolist()])
        first = np.unique(node, return_index=True)[1]
    order = np.lexsort((ids, node.ravel()))
    cuts = np.searchsorted(node.ravel()[order], np.arange(len(first) + 1))
    kept = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = ids[order[a:b]]
        fresh = np.full(len(mine), True)
        fresh[k:] = mine[k:] != mine[:-k]  # not the same as k places before
        kept.append(mine[fresh][: 2 * k])
    return SortedLists(vectors[first], kept)


def _found(given: DataFrame, asked: list[tuple[int, np.ndarray]], d: int, k: int, scale: float) -> DataFrame:
    """(query, query_id, vec_id, score): each task's best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(own, _whole(vector[None, :], scale)[0]) for own, vector in asked]
        best = [_Best(k) for _ in asked]

        def search(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
            shard = _shard(np.concatenate([i for i, _ in held]), _whole(np.concatenate([v for _, v in held]), scale), k)
            for mine, (own, query) in zip(best, queries, strict=True):
                shard.search(query, own, mine)

        held, size = [], 0
        for batch in batches:
            held.append((batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"), d)))
            size += batch.num_rows
            if size >= SHARD:
                search(held)
                held, size = [], 0
        if size:
            search(held)
        if not asked:
            return
        sizes = [len(b.id) for b in best]
        yield pa.RecordBatch.from_pydict({
            "query": pa.array(np.repeat(np.arange(len(asked)), sizes), pa.int64()), "query_id": pa.array(np.repeat(np.array([own for own, _ in asked], dtype=np.int64), sizes), pa.int64()),
            "vec_id": pa.array(np.concatenate([b.id for b in best]), pa.int64()), "score": pa.array([_as_long(s) for b in best for s in b.score.tolist()], pa.int64()),
        })

    return given.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query: by groups of tasks, then of all."""
    order = [F.desc("score"), F.asc("vec_id")]
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def highest_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products; both tables are (vec_id, embedding)."""
    arrow_rows(vectors.sparkSession, 2000)
    scratch = Scratch()

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter(finite(F.col("vec")) & F.col("vec_id").isNotNull())

    given = clean(vectors)
    sizes = given.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    whole = F.size("vec") == d
    asked = scratch.written(clean(queries).filter(whole).distinct())
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)) == block).collect()  # about BLOCK rows
        found = _found(given.filter(whole), [(r.vec_id, np.array(r.vec, dtype=np.float64)) for r in rows], d, k, scale)
        best = scratch.written(_ranked(found, k))
        out = best if out is None else out.unionByName(best)
    return scratch.result(out)


def op13_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest products with each row of `embeddings` whose vec_id is divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return highest_products(vectors, vectors.filter("vec_id % 100 = 0"))


OP13_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INT AS rank, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10
"""
