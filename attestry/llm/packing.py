"""Vector best-fit packing of documents into fixed-size sequences.

A piece is a vector (tokens, 1 document, tokens^2 attention cost) and a bin has
a residual capacity in each. Pieces go longest first; each picks, among the bins
that still hold it in every dimension, the one of largest weighted dot product
of piece and residual, or of least weighted residual norm after placement.

Pieces of one length are equal vectors, so the plan is made over the histogram
of lengths: bins of equal residual form a class and a run of equal pieces is
placed into a run of a class's bins at once. The plan's size is bounded by the
sequence length, not by the corpus. A piece then finds its place by its length
and its ordinal among the pieces of that length, which is a running count inside
its input partition plus that partition's offset.

Defined results: a null or empty text is the end token alone; a document longer
than a sequence is cut into full pieces and a shorter last one; ties go to the
bin class opened first; very long texts are encoded whole; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import arrow_rows, checkpointed, read_table

#: Chunks whose ids a worker remembers.
REMEMBERED = 350_000
#: Bytes of text whose new chunks are encoded together.
GATHERED = 6_000_000
#: A control character that is a token by itself, between chunks that are encoded in one go.
MARK = b"\x1f"
#: ASCII signs; not the apostrophe, which the tokenizer's pattern takes with letters.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def plan_bins(histogram: dict[int, int], tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> np.ndarray:
    """Placement runs (length, first ordinal, count, first bin, offset), in order of length and ordinal.

    A run places `count` pieces of one length, from an ordinal on, one each into
    consecutive bins at one offset.
    """
    size = np.array([tokens, max_docs, max_cost], dtype=float)
    scale = np.array(weights, dtype=float)
    # open bin classes: residuals, first bin, number of bins, fill
    left = np.zeros((64, 3))
    first, number, fill = (np.zeros(64, dtype=np.int64) for _ in range(3))
    used, bins, runs = 0, 0, []

    def opened(residual: np.ndarray, at: int, n: int, filled: int) -> None:
        nonlocal left, first, number, fill, used
        if residual[0] < 1 or residual[1] < 1 or residual[2] < 1:
            return  # nothing fits any more
        same = np.flatnonzero((number[:used] == 0))
        k = same[0] if len(same) else used
        if k == len(left):
            left = np.vstack([left, np.zeros_like(left)])
            first, number, fill = (np.concatenate([x, np.zeros_like(x)]) for x in (first, number, fill))
        left[k], first[k], number[k], fill[k] = residual, at, n, filled
        used = max(used, k + 1)

    for length in sorted(histogram, reverse=True):
        item, count, ordinal = np.array([length, 1, length * length], dtype=float), histogram[length], 0
        if length > tokens or item[2] > max_cost:
            raise ValueError(f"a piece of {length} tokens exceeds an empty bin")
        while ordinal < count:
            fits = np.flatnonzero((number[:used] > 0) & (left[:used] >= item).all(axis=1))
            if len(fits):
                share = left[fits] / size
                value = -(scale * (share - item / size) ** 2).sum(axis=1) if rule == "norm" else (scale * share * (item / size)).sum(axis=1)
                k = fits[value.argmax()]
                n = int(min(number[k], count - ordinal))
                runs.append((length, ordinal, n, int(first[k]), int(fill[k])))
                residual, at, filled = left[k] - item, int(first[k]), int(fill[k]) + length
                first[k] += n
                number[k] -= n
                opened(residual, at, n, filled)
                ordinal += n
            else:
                # as many new bins as the rest would need if each took all that fit
                n = -(-(count - ordinal) // int((size // item).min()))
                opened(size, bins, n, 0)
                bins += n
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(own))}


class ChunkIds:
    """Ids of chunks without spaces, as bytes, remembered.

    A chunk of Latin letters is one word to the tokenizer's pattern, so those go
    through its model alone, many at once, and the ids that end words part them.
    A run of ASCII signs after such a chunk is one word of its own. Every other
    chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        #: Lower-cased strings that are tokens by themselves wherever they stand.
        self.added = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.lean = Tokenizer(self.whole.model)
        self.lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        (self.mark,) = self.whole.encode(MARK.decode(), add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}
        self.signs: dict[bytes, bytes] = {b"": b""}

    def has_added(self, lowered: bytes) -> bool:
        return any(a in lowered for a in self.added)

    def _alone(self, chunk: bytes) -> bytes:
        return np.array(self.whole.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, core: bytes) -> str | None:
        """The model's spelling of a chunk of Latin letters, None for other chunks."""
        if core.isalpha():
            return core.decode()
        word = core.decode()
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word and unicodedata.is_normalized("NFC", word):
            return word.lower().encode().decode("latin-1").translate(self.letters)
        return None

    def _encode_words(self, words: list[bytes], spelled) -> None:
        """Remember the ids of words of letters; those whose ids do not part as expected are left out."""
        for part in _parts(words):
            (found,) = self.lean.encode_batch_fast([spelled(part)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                whole = ids.tobytes()
                self.known.update(zip(part, [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def learn(self, chunks: set[bytes]) -> None:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = chunks.difference(known)
        plain = [chunk for chunk in new if chunk.isalpha()]
        rest = [(chunk, chunk.rstrip(SIGNS)) for chunk in new.difference(plain)]
        ascii_, other, odd = set(plain), {}, []
        for _, core in rest:
            if core.isalpha():
                if core not in known:
                    ascii_.add(core)
            elif core and core not in other:
                other[core] = self._word(core)
        self._encode_words(list(ascii_), lambda part: b" ".join(part).decode())
        self._encode_words([core for core, word in other.items() if word and core not in known], lambda part: " ".join(map(other.__getitem__, part)))
        if len(self.signs) > REMEMBERED:
            self.signs = {b"": b""}
        for chunk, core in rest:
            ids = known.get(core) if core.isalpha() or other.get(core) else None
            if ids is None:
                odd.append(chunk)
            elif len(core) < len(chunk):
                sign = chunk[len(core) :]
                if sign not in self.signs:
                    self.signs[sign] = self._alone(sign)
                known[chunk] = ids + self.signs[sign]
        odd += [chunk for chunk in plain if chunk not in known]
        marked = [c for c in odd if MARK in c]
        for chunk in marked:
            known[chunk] = self._alone(chunk)
        for part in _parts(list(set(odd).difference(marked))):
            (found,) = self.whole.encode_batch_fast([(b" " + MARK + b" ").join(part).decode()], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            cuts, whole = np.flatnonzero(ids == self.mark), ids.tobytes()
            for chunk, a, b in zip(part, np.append(0, 4 * (cuts + 1)).tolist(), np.append(4 * cuts, len(whole)).tolist(), strict=True):
                known[chunk] = whole[a:b]


def _parts(items: list, size: int = 2_000) -> Iterator[list]:
    return (items[at : at + size] for at in range(0, len(items), size))


_CHUNK_IDS: dict[str, ChunkIds] = {}


def _chunk_ids(path: str) -> ChunkIds:
    if path not in _CHUNK_IDS:
        _CHUNK_IDS[path] = ChunkIds(path)
    return _CHUNK_IDS[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, tokens: int, end_id: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, task, ordinal in its task.

    The tokenizer lower-cases, drops white space and never joins across it, so a
    text's ids are those of its chunks between ASCII white space in order, and each chunk
    is encoded once a worker. A text with one of the tokenizer's added tokens, whatever
    its case, is encoded in one piece, so that those are found as the tokenizer finds them.
    """
    arrow_rows(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        # millions of small objects without cycles: the collector would only walk them again and again
        gc.disable()
        memory = _chunk_ids(tokenizer_path)
        known = memory.known
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(tokens + 1, dtype=np.int64)

        def cut(ids_col: list[int], split: list[list[bytes] | bytes]) -> pa.RecordBatch:
            memory.learn(set().union(*(chunks for chunks in split if isinstance(chunks, list))))
            rows = []
            for doc_id, chunks in zip(ids_col, split, strict=True):
                ids = (b"".join(map(known.__getitem__, chunks)) if isinstance(chunks, list) else memory._alone(chunks)) + end
                for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    length = len(part) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(part), task, int(seen[length])))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal")
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

        held, split, size = [], [], 0
        for batch in batches:
            held += batch.column("doc_id").to_pylist()
            for t in batch.column("text").to_pylist():
                lowered = (t or b"").lower()
                split.append(t if memory.has_added(lowered) else lowered.split())
            size += batch.column("text").nbytes
            if size >= GATHERED:
                yield cut(held, split)
                held, split, size = [], [], 0
        if held:
            yield cut(held, split)
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, ordinal long")


def pack_documents(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """Pieces with sequence_id and offset; at most `tokens`, `max_docs` and `max_cost` a sequence."""
    pieces = checkpointed(cut_pieces(docs, tokenizer_path, tokens))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `tokens` rows
    histogram = {int(r.length): int(r.n) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_bins(histogram, tokens, max_docs or tokens, max_cost or tokens * tokens, rule=rule)
    sent = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        wide = int(plan[:, 1].max() + 1) if len(plan) else 1
        starts = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            length, ordinal = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            at = np.searchsorted(starts, length * wide + np.minimum(ordinal, wide - 1), side="right") - 1
            sequence = plan[at, 3] + ordinal - plan[at, 1]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(plan[at, 4], pa.int64())})

    placed = pieces.join(bases, ["task", "length"]).withColumn("ordinal", F.col("ordinal") + F.col("base"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ordinal").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what is left, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in sequences of at most 2048 tokens."""
    return pack_stage(spark, read_table(spark, sf_dir, "documents"), sf_dir)
