"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one graph node with its smallest ids, merged in each task
before the shuffle. Nodes are dealt to shards by a hash of the vector. A shard's
layers are flat neighbour arrays; a layer is built after those above it, in
batches that search the layer so far together, choose diverse neighbours and
link back. Every query searches every shard, streaming past the finished graph,
candidates are ranked by exact distance in double precision and shard results
are merged.

Defined results: null, zero, non-finite or null-holding vectors, and those of
another dimension than most, take no part; ties go to the smaller id; a query
never finds its own row but does find equal ones; fewer candidates than wanted
give fewer rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import arrow_rows, checkpointed, read_table

#: Nodes in a shard, about.
SHARD = 8192
#: Links of a node: above the ground layer, and on it.
LINKS, GROUND_LINKS = 16, 32
#: Beam while building and while searching.
BUILD_BEAM, SEARCH_BEAM = 64, 160
#: Nodes inserted together, and beam members expanded together.
TOGETHER, WIDE = 512, 4


def _distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of ids; -1 is infinitely far."""
    gap = points[ids] - queries[:, None, :]
    out = np.einsum("bmd,bmd->bm", gap, gap)
    out[ids < 0] = np.inf
    return out


def _beam(points: np.ndarray, links: np.ndarray, n: int, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest nodes found from each query's entries: ids and squared distances, nearest first."""
    b = len(queries)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column is for -1
    seen[rows, entry] = True
    seen[:, n] = True
    fill = max(0, width - entry.shape[1])
    ids = np.pad(entry, ((0, 0), (0, fill)), constant_values=-1)
    far = np.pad(_distances(points, entry, queries), ((0, 0), (0, fill)), constant_values=np.inf)
    open_ = ids >= 0
    while True:
        waiting = np.where(open_, far, np.inf)
        take = np.argpartition(waiting, min(WIDE, waiting.shape[1] - 1), axis=1)[:, :WIDE]
        good = np.isfinite(np.take_along_axis(waiting, take, axis=1))
        if not good.any():
            order = np.argsort(far, axis=1, kind="stable")
            return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
        np.put_along_axis(open_, take, False, axis=1)
        expand = np.where(good, np.take_along_axis(ids, take, axis=1), -1)
        near = np.where(expand[:, :, None] >= 0, links[expand], -1).reshape(b, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows, near]] = -1
        seen[rows, near] = True
        ids = np.concatenate([ids, near], axis=1)
        far = np.concatenate([far, _distances(points, near, queries)], axis=1)
        open_ = np.concatenate([open_, near >= 0], axis=1)
        keep = np.argpartition(far, width - 1, axis=1)[:, :width]
        ids, far, open_ = (np.take_along_axis(x, keep, axis=1) for x in (ids, far, open_))
        ids[~np.isfinite(far)] = -1
        open_ &= ids >= 0


def _diverse(points: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those nearer to the node than to any chosen before; others fill up."""
    x = points[ids]
    square = np.einsum("bmd,bmd->bm", x, x)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, dtype=bool)
    closest = np.full(ids.shape, np.inf, dtype=far.dtype)  # to any chosen one
    for j in range(ids.shape[1]):
        ok = (ids[:, j] >= 0) & (far[:, j] < closest[:, j]) & (chosen.sum(axis=1) < most)
        chosen[:, j] = ok
        closest = np.where(ok[:, None], np.minimum(closest, between[:, j, :]), closest)
    rank = np.where(chosen, 0, 1) + np.where(ids < 0, 2, 0)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1)


class SmallWorld:
    """Layers of flat neighbour arrays over float32 points, higher nodes first."""

    def __init__(self, points: np.ndarray, seed: int = 11):
        n = len(points)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-height, kind="stable")
        self.points = np.ascontiguousarray(points[self.order], dtype=np.float32)
        tall = height[self.order]
        # layer i holds the first sizes[i] nodes; from the top down
        self.sizes = [int((tall >= level).sum()) for level in range(int(tall.max()) if n else 0, -1, -1)] if n else []
        self.layers: list[np.ndarray] = []
        for i, size in enumerate(self.sizes):
            self.layers.append(self._layer(size, i == len(self.sizes) - 1))

    def _entries(self, queries: np.ndarray, above: int) -> np.ndarray:
        """Each query's nearest node in the layers above."""
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for links, size in zip(self.layers[:above], self.sizes[:above], strict=True):
            entry = _beam(self.points, links, size, queries, entry, 4)[0][:, :1]
        return entry

    def _layer(self, size: int, ground: bool) -> np.ndarray:
        most = GROUND_LINKS if ground else LINKS
        above = len(self.layers)
        ready = self.sizes[above - 1] if above else 0
        links = np.full((size, most), -1, dtype=np.int64)
        done = 0
        while done < size:
            step = min(max(64, done), TOGETHER, size - done)
            if done < ready:
                step = min(step, ready - done)
            batch = np.arange(done, done + step)
            queries = self.points[batch]
            inside = ((queries[:, None, :] - queries[None, :, :]) ** 2).sum(axis=2) if step <= 64 else np.maximum((queries**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * queries @ queries.T, 0)
            np.fill_diagonal(inside, np.inf)
            close = np.argsort(inside, axis=1, kind="stable")[:, : min(step, most)]
            ids, far = batch[close], np.take_along_axis(inside, close, axis=1)
            ids[~np.isfinite(far)] = -1
            if done:
                entry = self._entries(queries, above) if done >= ready > 0 else np.zeros((step, 1), dtype=np.int64)
                found, gap = _beam(self.points, links, size, queries, entry, BUILD_BEAM)
                ids, far = np.concatenate([found, ids], axis=1), np.concatenate([gap, far], axis=1)
                order = np.argsort(far, axis=1, kind="stable")[:, :BUILD_BEAM]
                ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
            chosen = _diverse(self.points, ids, far, min(LINKS, most))
            links[batch, : chosen.shape[1]] = chosen
            self._link_back(links, batch, chosen)
            done += step
        return links

    def _link_back(self, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        most = links.shape[1]
        to, start = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        to, start = to[to >= 0], start[to >= 0]
        gap = self.points[to] - self.points[start]
        order = np.lexsort((np.einsum("bd,bd->b", gap, gap), to))
        to, start = to[order], start[order]
        nodes, first = np.unique(to, return_index=True)
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        fresh = np.full((len(nodes), most), -1, dtype=np.int64)
        kept = rank < most
        fresh[np.searchsorted(nodes, to[kept]), rank[kept]] = start[kept]
        for at in range(0, len(nodes), 1024):
            part = nodes[at : at + 1024]
            ids = np.concatenate([links[part], fresh[at : at + 1024]], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            far = _distances(self.points, ids, self.points[part])
            order = np.argsort(far, axis=1, kind="stable")
            width = max(most, int((ids >= 0).sum(axis=1).max()))
            order = order[:, :width]
            links[part] = _diverse(self.points, np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1), most)

    def search(self, queries: np.ndarray, width: int = SEARCH_BEAM) -> np.ndarray:
        """Indices of points near each query, -1 where there are fewer."""
        if not self.layers:
            return np.full((len(queries), width), -1, dtype=np.int64)
        out = []
        for at in range(0, len(queries), 256):
            part = queries[at : at + 256].astype(np.float32)
            found = _beam(self.points, self.layers[-1], self.sizes[-1], part, self._entries(part, len(self.layers) - 1), width)[0]
            out.append(np.where(found >= 0, self.order[found], -1))
        return np.concatenate(out)


def _merged_ids(a: list[int], b: list[int], most: int) -> list[int]:
    return sorted({*a, *b})[:most]


def _vectors(batch: pa.RecordBatch) -> list[bytes]:
    return [np.asarray(v, dtype="<f8").tobytes() for v in batch.column("vec").to_pylist()]


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query's k nearest; both tables are (vec_id, embedding)."""
    spark = vectors.sparkSession
    arrow_rows(spark)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter(usable(F.col("vec")) & F.col("vec_id").isNotNull())

    given = clean(vectors)
    sizes = given.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension, rows = (sizes[0].d, sizes[0].n) if sizes else (1, 0)
    shards = max(1, -(-rows // shard_rows))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, vec in zip(batch.column("vec_id").to_pylist(), _vectors(batch), strict=True):
                mine = held.setdefault(vec, [])
                if len(mine) <= k or vec_id < mine[-1]:
                    mine[:] = _merged_ids(mine, [vec_id], k + 1)
        items = list(held.items())
        for at in range(0, len(items), 2000):
            part = items[at : at + 2000]
            yield pa.RecordBatch.from_pydict({"vec": pa.array([v for v, _ in part], pa.binary()), "ids": pa.array([i for _, i in part], pa.list_(pa.int64()))})

    whole = F.size("vec") == dimension
    # each task's distinct vectors with their k + 1 smallest ids: what any query can need of them
    nodes = given.filter(whole).mapInArrow(grouped, "vec binary, ids array<long>")
    dealt = nodes.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec", "ids")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"vec": pa.array(_vectors(batch), pa.binary()), "ids": pa.array([[i] for i in batch.column("vec_id").to_pylist()], pa.list_(pa.int64()))})

    asked = clean(queries).filter(whole).mapInArrow(raw, "vec binary, ids array<long>")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec", "ids")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, graph, points, ids = None, {}, None, None, []
        for batch in batches:
            rows = list(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("vec").to_pylist(), batch.column("ids").to_pylist(), strict=True))
            at = 0
            while at < len(rows):
                if rows[at][0] != shard:
                    shard, held, graph = rows[at][0], {}, None
                stop = at
                while stop < len(rows) and rows[stop][:2] == (shard, rows[at][1]):
                    stop += 1
                part = rows[at:stop]
                if rows[at][1] == 0:
                    for _, _, vec, mine in part:
                        held[vec] = _merged_ids(held[vec], mine, k + 1) if vec in held else mine
                elif held:
                    if graph is None:
                        ordered = sorted(held.items(), key=lambda x: x[1])
                        points = np.frombuffer(b"".join(v for v, _ in ordered), dtype="<f8").reshape(len(ordered), -1)
                        ids = [i for _, i in ordered]
                        graph = SmallWorld(points.astype(np.float32))
                    wanted = np.frombuffer(b"".join(v for _, _, v, _ in part), dtype="<f8").reshape(len(part), -1)
                    found = graph.search(wanted, max(SEARCH_BEAM, 2 * k))
                    out = []
                    for (_, _, _, (query,)), vec, near in zip(part, wanted, found, strict=True):
                        near = near[near >= 0]
                        far = np.sqrt(((points[near] - vec) ** 2).sum(axis=1))
                        # an own row can be among the k + 1 nearest nodes
                        best = np.argsort(far, kind="stable")[: k + 1 + int((far <= np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)]).sum())]
                        hits = sorted((float(far[i]), v) for i in best for v in ids[near[i]] if v != query)[:k]
                        out += [(query, v, d) for d, v in hits]
                    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})
                at = stop

    both = dealt.unionAll(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind")
    found = checkpointed(both.mapInArrow(search, "query_id long, vec_id long, score double").distinct())
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of `embeddings` to each row whose vec_id is divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
