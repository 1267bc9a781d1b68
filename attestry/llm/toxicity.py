"""Toxicity from the nearest labelled examples.

Examples are a sample of labelled rows, at most PER_CLASS of each label, taken
in the order of a hash of the key. Their vectors hold every word of theirs: TF-IDF
weights, scaled by how far the word's presence goes with the label (FLOOR plus
the absolute correlation, so no word is ever without weight). A block-max inverted
index finds a text's nearest examples by exact cosine: the words' largest weights
in a block of examples bound the block's scores; the best-bounded blocks are scored
first, and then all whose bound reaches the k-th best score of those. Like
examples stand in one block, so that bounds are close. Votes are weighted by
nearness and by how many labelled rows an example stands for; monotone (isotonic)
regression on the examples' own leave-one-out votes calibrates them. The nearest
examples are the evidence.

Defined results: a null or empty text, or one without any word of the examples, has
no neighbours and gets the calibrated share of examples without words; with no
labelled rows every score is 0; ties go to the smaller key; texts count whole;
repeated rows are scored alike, and of examples that share a key each counts;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import arrow_rows, key_remainder, read_table

#: Most examples of each label.
PER_CLASS = 4000
#: What a word weighs that says nothing of the label, where one that decides it weighs 1 more.
FLOOR = 0.05
#: Neighbours that vote, examples in a block, and terms held as a matrix.
NEIGHBOURS, BLOCK, DENSE = 25, 128, 512
#: Texts whose nearest examples are found together.
TOGETHER = 64
#: Scores so close are equal.
_TIE = 1e-9
#: Votes of equal vectors that a worker remembers.
REMEMBERED = 50_000
#: Nearness is 1 / (distance + SOFT); the prior votes with so much weight.
SOFT, PRIOR_WEIGHT = 0.1, 0.5

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_LETTERS).split()


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the half-open ranges, one range after the other, and the ranges' sizes."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes), sizes


class BlockMaxIndex:
    """Postings of vectors (rows of terms and weights) by term, with each term's largest weight in each block.

    The `dense` terms of most postings are held as a matrix, whose products for a
    batch of queries are exact partial scores; their largest in a block is its bound.
    """

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        self.n, self.block, self.dense = n, block, dense
        self.blocks = -(-max(1, n) // block)
        order = np.lexsort((rows, terms))
        self.ids, self.weights = rows[order].astype(np.int32), weights[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.ready = False

    def _lay_out(self) -> None:
        """What the postings give, made where it is used and not sent."""
        if self.ready:
            return
        sizes = np.diff(self.first)
        self.row_of = np.full(len(sizes), -1)
        often = np.argsort(-sizes, kind="stable")[: self.dense]
        self.row_of[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n))
        at, n_at = _runs(self.first[often], self.first[often + 1])
        self.matrix[np.repeat(np.arange(len(often)), n_at), self.ids[at]] = self.weights[at]
        # a term's postings in one block stand together: where they begin, and the largest of them
        places = np.repeat(np.arange(len(sizes)), sizes) * self.blocks + self.ids // self.block
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.zeros(0, np.int64)
        self.part_first = np.append(starts, len(places))
        self.part_block = (places[starts] % self.blocks).astype(np.int32)
        self.part_most = np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        self.parts = np.searchsorted(places[starts], np.arange(len(sizes) + 1) * self.blocks)
        self.ready = True

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights) the vectors of the k largest dot products above 0 and all that tie, best first."""
        self._lay_out()
        left = np.zeros((len(queries), len(self.matrix)))
        for q, (terms, weights) in enumerate(queries):
            row = self.row_of[terms]
            left[q, row[row >= 0]] = weights[row >= 0]
        heads = left @ self.matrix
        starts = np.arange(0, self.n, self.block)
        return [self._one(head, starts, terms[few], weights[few], k, -1 if without is None else without[q]) for q, (head, (terms, weights)) in enumerate(zip(heads, queries, strict=True)) if (few := self.row_of[terms] < 0) is not None]

    def _one(self, head: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        if not self.n:
            return []
        parts, sizes = _runs(self.parts[terms], self.parts[terms + 1])
        block_of, weight = self.part_block[parts], np.repeat(weights, sizes)
        bound = np.maximum.reduceat(head, starts) + np.bincount(block_of, weight * self.part_most[parts], minlength=self.blocks)

        def scored(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows of the chosen blocks and their scores."""
            mine = np.zeros(self.blocks, dtype=bool)
            mine[chosen] = True
            held = mine[block_of]
            at, n_at = _runs(self.part_first[parts[held]], self.part_first[parts[held] + 1])
            tail = np.bincount(self.ids[at], np.repeat(weight[held], n_at) * self.weights[at], minlength=self.n)
            rows = np.flatnonzero(np.repeat(mine, self.block)[: self.n])
            rows = rows[rows != without]
            return rows, head[rows] + tail[rows]

        def least(scores: np.ndarray) -> float:
            return max(_TIE, np.partition(scores, len(scores) - k)[len(scores) - k] - _TIE) if len(scores) >= k else _TIE

        ahead = max(2, -(-(k + 1) // self.block))
        floor = least(scored(np.argsort(-bound, kind="stable")[:ahead])[1]) if self.blocks > ahead else _TIE
        rows, scores = scored(np.flatnonzero(bound >= floor - _TIE))
        found = np.flatnonzero(scores >= least(scores))
        return sorted(((s, i) for s, i in zip(np.round(scores[found], 12).tolist(), rows[found].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step values by pooling adjacent violators: (points, values)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # [sum of w*y, sum of w, first x, last x]
    for i in order:
        if pools and pools[-1][3] == x[i]:
            pools[-1][0] += w[i] * y[i]
            pools[-1][1] += w[i]
        else:
            pools.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    points = np.array([p for pool in pools for p in (pool[2], pool[3])])
    return points, np.array([v for pool in pools for v in [pool[0] / pool[1]] * 2])


def label_weights(rows_with: np.ndarray, toxic_with: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """TF-IDF's idf of each term times FLOOR plus the absolute correlation of its presence with the label."""
    a, b = toxic_with.astype(float), (rows_with - toxic_with).astype(float)
    c, d = n_toxic - a, n - n_toxic - b
    gap = np.maximum(np.abs(a * d - b * c) - n / 2, 0)  # Yates's correction
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    correlation = gap / np.sqrt(np.where(spread > 0, spread, np.inf))
    return (np.log((1 + n) / (1 + rows_with)) + 1) * (FLOOR + correlation)


def like_together(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, groups: int = 32) -> np.ndarray:
    """An order of the vectors in which like ones are neighbours: by the nearest of some of them, some rounds over.

    Only the bounds' closeness rests on it, never a result.
    """
    if n <= BLOCK:
        return np.arange(n)
    # vectors folded into 256 dimensions
    flat = np.zeros((n, 256))
    np.add.at(flat, (rows, (terms * 2654435761 >> 7) % 256), weights)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
    centres = flat[np.linspace(0, n - 1, groups).astype(int)]
    for _ in range(6):
        at = (flat @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, flat)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    # groups in the order of their likeness to the first, so that the blocks they share are like too
    return np.lexsort((np.arange(n), (centres @ centres[0])[at], at))


class NearestExamples:
    """Examples, their index and the calibration.

    `words` and `counts` are the examples' distinct words and their counts, one
    example after the other, `sizes` how many each example has.
    """

    def __init__(self, keys: np.ndarray, labels: np.ndarray, words: pa.Array, counts: np.ndarray, sizes: np.ndarray, of_class: tuple[int, int]):
        coded = words.dictionary_encode()
        terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary
        n, n_terms = len(keys), len(self.names)
        rows = np.repeat(np.arange(n), sizes)
        with_ = np.bincount(terms, minlength=n_terms)
        self.of_term = label_weights(with_, np.bincount(terms, labels[rows], minlength=n_terms), n, int(labels.sum()))
        weights = (1 + np.log(counts)) * self.of_term[terms]
        norm = np.sqrt(np.bincount(rows, weights * weights, minlength=n))
        weights /= norm[rows]
        place = np.argsort(like_together(rows, terms, weights, n))
        order = np.argsort(place)
        self.keys, self.labels, self.filled = keys[order], labels[order], norm[order] > 0
        self.index = BlockMaxIndex(place[rows], terms, weights, n, n_terms)
        here = np.bincount(labels, minlength=2)
        self.stands = np.array([of_class[c] / max(1, here[c]) for c in (0, 1)])
        self.prior = of_class[1] / max(1, sum(of_class))
        self.points, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        weight = self.stands[self.labels] * ~self.filled
        self.without_words = float((weight * self.labels).sum() + self.prior) / (weight.sum() + 1) if n else 0.0
        self.vocabulary: dict[bytes, int] | None = None
        self.voted: dict[bytes, tuple[float, list[int]]] = {}

    def calibrate(self, keys: list[int], raw: list[float], labels: list[int]) -> None:
        """Isotonic values of leave-one-out votes."""
        y = np.array(labels, dtype=np.int64)
        if len(keys):
            self.points, self.values = isotonic(np.array(raw), y.astype(float), self.stands[y])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and counts of a text."""
        if self.vocabulary is None:
            self.vocabulary = {w: i for i, w in enumerate(self.names.to_pylist())}
        counts = Counter(words_of(text))
        terms = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), dtype=np.int64, count=len(counts))
        order = np.argsort(terms)
        order = order[np.searchsorted(terms[order], 0) :]
        return terms[order], np.fromiter(counts.values(), dtype=np.int64, count=len(counts))[order]

    def votes(self, given: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, list[int]]]:
        """For each vector (terms, counts) the weighted share of toxic among the nearest, and the nearest."""
        queries = []
        for terms, counts in given:
            weights = (1 + np.log(counts)) * self.of_term[terms]
            queries.append((terms, weights / max(np.sqrt((weights * weights).sum()), 1e-300)))
        out = []
        for near in self.index.nearest(queries, NEIGHBOURS, without):
            near = sorted(near, key=lambda x: (-x[0], self.keys[x[1]]))[:NEIGHBOURS]
            yes, total = PRIOR_WEIGHT * self.prior, PRIOR_WEIGHT
            for similarity, i in near:
                weight = self.stands[self.labels[i]] / (1 - min(1.0, similarity) + SOFT)
                yes, total = yes + weight * self.labels[i], total + weight
            out.append((float(yes / total), [i for _, i in near]))
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Score and nearest keys of each text."""
        if len(self.voted) > REMEMBERED:
            self.voted.clear()
        vectors = [self.vector(t) for t in texts]
        keys = [hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest() for terms, counts in vectors]
        new = {key: v for key, v in zip(keys, vectors, strict=True) if key not in self.voted}
        for key, (terms, _), (raw, near) in zip(new, new.values(), self.votes(list(new.values())), strict=True):
            self.voted[key] = (float(np.interp(raw, self.points, self.values)), self.keys[near[:3]].tolist()) if len(terms) else (self.without_words, [])
        return [self.voted[key] for key in keys]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> NearestExamples:
    """Examples from `labels` (doc_id, toxic) and their texts in `docs` (doc_id, text)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    of_class = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # a share of each class by hash, a little over the bound, then exactly the bound in the order of the hash
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for c in (0, 1) for x in (c, min(1.0, 1.3 * per_class / max(1, of_class.get(c, 0))))])
    drawn = known.withColumn("place", place).filter(F.col("place") < share[F.col("toxic")] * float(1 << 30)).collect()
    chosen = []
    for c in (0, 1):
        chosen += sorted(((r.place, r.doc_id, r.toxic) for r in drawn if r.toxic == c))[:per_class]
    picked = spark.createDataFrame([(d, y) for _, d, y in chosen], "doc_id long, toxic int")
    # at most 2 * per_class keys; of rows that share one the smallest text is the example
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    examples = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": pa.array([list(r) for r in rows], pa.list_(pa.binary())), "counts": pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))})

    held = examples.mapInArrow(counted, "doc_id long, toxic int, words array<binary>, counts array<int>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    words, counts = held["words"].combine_chunks(), held["counts"].combine_chunks()
    model = NearestExamples(held["doc_id"].to_numpy(), held["toxic"].to_numpy().astype(np.int64), words.flatten(), counts.flatten().to_numpy(), np.diff(words.offsets.to_numpy()), (of_class.get(0, 0), of_class.get(1, 0)))
    del held, words, counts
    sent = spark.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        at = {key: i for i, key in enumerate(zip(m.keys.tolist(), m.labels.tolist(), strict=True))}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True))
            raw = []
            for some in range(0, len(rows), TOGETHER):
                part = rows[some : some + TOGETHER]
                raw += [r for r, _ in m.votes([m.vector(t) for *_, t in part], [at[(d, y)] for d, y, _ in part])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "raw": pa.array(raw, pa.float64())})

    votes = sorted(examples.mapInArrow(left_out, "doc_id long, toxic int, raw double").collect())  # at most 2 * per_class rows
    model.calibrate([r.doc_id for r in votes], [r.raw for r in votes], [r.toxic for r in votes])
    return model


def score(docs: DataFrame, model: NearestExamples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted, nearest (keys of the three nearest examples)."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [x for at in range(0, len(texts), TOGETHER) for x in m.scores(texts[at : at + TOGETHER])]
            scores = np.array([s for s, _ in got], dtype=float)
            yield pa.RecordBatch.from_pydict({id_col: batch.column("doc_id"), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "nearest": pa.array([e for _, e in got], pa.list_(pa.int64()))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, nearest array<long>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from labelled rows whose key's remainder by 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels").filter(key_remainder("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (key_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "nearest")
