"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

A text is cut before white space that neither vocabulary joins to what stands before
it, so that both tokenizers have an end at every cut; what follows holds for a chunk
as for a text, and only distinct chunks are aligned. The tokens of an Arrow
partition's new chunks are interval tables in an in-process DuckDB: an ASOF join finds
for each token of the first vocabulary the first end of the second at or after its
own, a range condition keeps the overlapping pairs that end together, window sums over
those ends number the groups, and a second ASOF join puts the other tokens into them. A document's row puts its chunks' groups in a row and
adds their linked pairs up; these partial counts are merged by Spark to corpus-wide
ones, with which each document's pairs are joined again.

Defined results: null and empty texts, and those whose token bytes are not a space
and the text, have no tokens: zeros and an empty digest; each row is a document,
repeated rows, shared and null identifiers too; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, arrow_rows, read_table

#: Characters of text that are gathered before chunks are learned, chunks that a worker remembers, and token rows in one query.
GATHERED, REMEMBERED, QUERIED = 4_000_000, 400_000, 300_000
#: Chunks that are encoded and aligned together; a tokenizer's result takes some hundreds of bytes a token.
TOGETHER = 40_000

#: White space that starts a chunk, and other characters that some tokenizer may take for white space or join to what is before them.
_CUT, _UNSURE = " \n\t", "\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿"
_ANY, _SURE = f"[{_CUT}{_UNSURE}]", f"[^{_CUT}{_UNSURE}]"
_SPACES = frozenset(re.findall(_ANY, "".join(map(chr, range(0x10000)))))
_CHUNK = re.compile(f"{_ANY}*{_SURE}+(?:[{_UNSURE}]{_ANY}*{_SURE}+)*(?:[{_UNSURE}]{_ANY}*\\Z)?|{_ANY}+")

_ALIGN = """
WITH near AS (SELECT a.*, b.id AS other, b.start AS other_start, b.stop AS other_stop FROM a_tokens a ASOF LEFT JOIN b_tokens b ON b.stop >= a.stop),
marked AS (SELECT w, pos, id, start, other, (other_stop = stop AND other_start < stop AND start < other_stop) AS linked FROM near),
grouped AS (
  SELECT *, coalesce(sum(linked::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, coalesce(lag(linked) OVER (ORDER BY pos), true) AS opens
  FROM marked),
others AS (
  SELECT s.w, s.g, b.pos, b.id, coalesce(lead(s.g) OVER (ORDER BY b.pos) <> s.g, true) AS closes
  FROM b_tokens b ASOF JOIN (SELECT w, g, start FROM grouped WHERE opens) s ON b.start >= s.start)
SELECT w, text, pair FROM (
  SELECT w, 2 * g AS part, pos, id || CASE WHEN linked THEN '|' ELSE ',' END AS text, CASE WHEN linked THEN (id::BIGINT << 32) | other END AS pair FROM grouped
  UNION ALL SELECT w, 2 * g + 1, pos, id || CASE WHEN closes THEN ';' ELSE ',' END, NULL FROM others)
ORDER BY part, pos
"""


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself where it prints, else the next letter from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Two tokenizers, the bytes of their tokens, and the aligned chunks that are remembered."""

    def __init__(self, byte_level: str, pieces: str):
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        letters = _byte_letters()
        self.first_bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in self.first.get_vocab(with_added_tokens=False).items()}
        self.first_lengths = np.array([len(self.first_bytes.get(i, b"")) for i in range(max(self.first_bytes) + 1)])
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.second_bytes = [bytes([int(t[3:5], 16)]) if self.second.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.second_lengths = np.array([len(t) for t in self.second_bytes])
        if any(len(t) > 1 and (" " in t.replace("▁", " ").lstrip(" ") or "\n" in t or "\t" in t) for i, t in enumerate(names) if not self.second.is_byte(i)):
            raise ValueError("a piece joins white space to what is before it: texts cannot be cut there")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Start the remembered chunks anew: their numbers, groups as text, counts of tokens and groups (-1: bytes differ), and linked pairs."""
        self.known.clear()
        self.groups: list[str] = []
        self.counts = np.zeros((0, 3), dtype=np.int64)
        self.pairs, self.pairs_at, self.pair_of = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [c for c in chunks if c not in self.known]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(new), TOGETHER):
            self._learn(new[at : at + TOGETHER])
        if new:
            counts, pairs, sizes = zip(*self.parts, strict=True)
            self.counts = np.concatenate([self.counts, *counts])
            # pairs are few: each has a number, which the chunks hold
            fresh = np.concatenate(pairs)
            self.pair_of = np.union1d(old := self.pair_of, fresh)
            self.pairs = np.concatenate([np.searchsorted(self.pair_of, old)[self.pairs], np.searchsorted(self.pair_of, fresh)])
            self.pairs_at = np.concatenate([self.pairs_at, self.pairs_at[-1] + np.cumsum(np.concatenate(sizes))])

    def _learn(self, new: list[str]) -> None:
        """Align some chunks; ids of all are flat arrays, each chunk's from one place to the next."""
        raw = [c.encode() for c in new]
        a, a_at = self._first_ids(new, np.array([len(r) for r in raw]))
        # the tokenizer puts a space before what it is given, unless that is empty: the chunk's own, or one that a line end keeps apart
        spaced = [len(c) > 1 and c[0] == " " for c in new]
        runs = self.second.encode([c[1:] if own else "\n" + c for c, own in zip(new, spaced, strict=True)], num_threads=1)
        runs = [ids if own else ids[2:] for ids, own in zip(runs, spaced, strict=True)]
        b, b_at = _flat(runs)
        whole = self._spelt(a, a_at, self.first_bytes, raw) & self._spelt(b, b_at, self.second_bytes, raw)
        good = np.flatnonzero(whole)
        if len(good) < len(new):
            (a, a_at), (b, b_at) = (_some(x, at, good) for x, at in ((a, a_at), (b, b_at)))
        texts, pairs, n_groups = self._aligned(a, a_at, b, b_at)
        counts = np.full((len(new), 3), -1, dtype=np.int64)
        counts[good] = np.stack([np.diff(a_at), np.diff(b_at), n_groups], axis=1)
        sizes = np.zeros(len(new), dtype=np.int64)
        sizes[good] = n_groups
        at = len(self.groups)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        left = iter(texts)
        self.groups += texts if len(good) == len(new) else [next(left) if ok else "" for ok in whole.tolist()]
        self.parts.append((counts, pairs, sizes))

    def _first_ids(self, chunks: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks under the first vocabulary; those that end in no white space are encoded as one text and cut at their bytes."""
        joins = np.array([c[-1] not in _SPACES for c in chunks], dtype=bool)
        ids = np.array(self.first.encode("".join(c for c, j in zip(chunks, joins.tolist(), strict=True) if j), add_special_tokens=False).ids, dtype=np.int64)
        stops = np.searchsorted(np.cumsum(self.first_lengths[ids]), np.cumsum(lengths[joins])) + 1
        if joins.all():
            return ids, np.append(0, stops)
        cut = iter(np.split(ids, stops)[:-1])
        return _flat([next(cut).tolist() if j else self.first.encode(c, add_special_tokens=False).ids for c, j in zip(chunks, joins.tolist(), strict=True)])

    @staticmethod
    def _spelt(ids: np.ndarray, at: np.ndarray, of: list[bytes] | dict[int, bytes], raw: list[bytes]) -> np.ndarray:
        """Whether each chunk's ids spell its bytes."""
        parts = list(map(of.__getitem__, ids.tolist()))
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.append(0, np.cumsum(lengths))[at]
        if (np.diff(ends) == np.array([len(r) for r in raw])).all() and b"".join(parts) == b"".join(raw):
            return np.ones(len(raw), dtype=bool)
        return np.array([b"".join(parts[p:q]) == r for p, q, r in zip(at[:-1].tolist(), at[1:].tolist(), raw, strict=True)], dtype=bool)

    def _aligned(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each chunk the groups as text, the linked pairs of all in order, and how many each has; long ones are cut where tokens end together."""
        size, n = np.diff(a_at) + np.diff(b_at), len(a_at) - 1
        of = np.arange(n)
        if n and size.max() > QUERIED:
            x_ends, y_ends = np.cumsum(self.first_lengths[a]), np.cumsum(self.second_lengths[b])
            _, x, y = np.intersect1d(x_ends, y_ends, assume_unique=True, return_indices=True)
            # every end of a chunk, and of the others one in each stretch of so many tokens
            starts = np.append(True, np.diff((x + y) // (QUERIED // 2)) > 0) | np.isin(x + 1, a_at)
            of = np.searchsorted(a_at, x[starts], side="right") - 1
            a_at, b_at = np.append(0, x[starts] + 1), np.append(0, y[starts] + 1)
        texts, pairs, counts = [], [np.zeros(0, dtype=np.int64)], []
        batch = (a_at[1:] + b_at[1:]) // QUERIED
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(batch) > 0)), len(of)) if len(of) else np.zeros(1, dtype=np.int64)
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            text, linked, stops = self._query(a[a_at[p] : a_at[q]], a_at[p : q + 1] - a_at[p], b[b_at[p] : b_at[q]], b_at[p : q + 1] - b_at[p])
            texts += text
            pairs.append(linked)
            counts.append(np.diff(stops))
        made = np.concatenate([np.zeros(0, dtype=np.int64), *counts])
        if len(of) > n:
            whole: list[list[str]] = [[] for _ in range(n)]
            for i, text in zip(of.tolist(), texts, strict=True):
                whole[i].append(text)
            texts, made = [";".join(w) for w in whole], np.bincount(of, weights=made, minlength=n).astype(np.int64)
        return texts, np.concatenate(pairs), made

    def _query(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups of each run of tokens as text; linked pairs of all, and where each run's begin."""
        for name, ids, at, of in (("a_tokens", a, a_at, self.first_lengths), ("b_tokens", b, b_at, self.second_lengths)):
            stop = np.cumsum(of[ids])
            start = np.concatenate([[0], stop[:-1]])
            w = np.repeat(np.arange(len(at) - 1), np.diff(at))
            self.con.register(name, pa.table({"w": w, "pos": np.arange(len(ids)), "id": ids.astype(np.int32), "start": start, "stop": stop}))
        found = self.con.sql(_ALIGN).to_arrow_table().combine_chunks()
        w, runs = found["w"].to_numpy(), np.arange(len(a_at))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(w, runs).astype(np.int32)), found["text"].combine_chunks()), "")
        linked = found["pair"].is_valid().to_numpy()
        return pc.utf8_rtrim(texts, ";").to_pylist(), found["pair"].drop_null().to_numpy(), np.searchsorted(w[linked], runs)


def _flat(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs one after the other, and where each begins."""
    at = np.append(0, np.cumsum(np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))))
    return np.fromiter(chain.from_iterable(runs), dtype=np.int64, count=int(at[-1])), at


def _some(flat: np.ndarray, at: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only these runs."""
    places, lengths = _expanded(at, runs)
    return flat[places], np.append(0, np.cumsum(lengths))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_for(byte_level: str, pieces: str) -> Aligner:
    """The aligner of two files, made once in each Python worker."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


def _expanded(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of these rows, one row after the other, and how many each has."""
    lengths = at[rows + 1] - at[rows]
    return np.arange(lengths.sum()) + np.repeat(at[rows] - np.cumsum(lengths) + lengths, lengths), lengths


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size < GATHERED):
                size += len(texts[stop] or "")
                stop += 1
            yield batch.slice(at, stop - at), texts[at:stop]
            at = stop


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Of each row of `docs` (doc_id, text): its counts of tokens, groups and links, its groups' digest, and its linked pairs with how often each is.

    A pair is the first vocabulary's id times 2^32 and the second's. `row` tells rows apart.
    """
    arrow_rows(docs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # millions of small objects without cycles: the collector would only walk them again and again
        gc.disable()
        aligner = aligner_for(byte_level, pieces)
        for batch, texts in _gathered(batches):
            cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
            aligner.learn(set().union(*cut))
            lengths = np.array([len(c) for c in cut])
            numbers = [list(map(aligner.known.__getitem__, cs)) for cs in cut]
            chunk = np.fromiter(chain.from_iterable(numbers), dtype=np.int64, count=int(lengths.sum()))
            doc = np.repeat(np.arange(len(texts)), lengths)
            bad = np.zeros(len(texts), dtype=bool)
            bad[doc[aligner.counts[chunk, 0] < 0]] = True
            chunk, doc = chunk[~bad[doc]], doc[~bad[doc]]
            sums = [np.bincount(doc, weights=aligner.counts[chunk, i], minlength=len(texts)).astype(np.int64) for i in range(3)]
            digests, groups = [], aligner.groups
            for mine, wrong in zip(numbers, bad.tolist(), strict=True):
                text = "" if wrong else ";".join(map(groups.__getitem__, mine))
                digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            # each document's pairs in order, and how often each is there
            places, n = _expanded(aligner.pairs_at, chunk)
            key = np.repeat(doc, n) * len(aligner.pair_of) + aligner.pairs[places]
            key.sort()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            often, key = np.diff(np.append(starts, len(key))), key[starts]
            pair, of = (aligner.pair_of[key % len(aligner.pair_of)], key // len(aligner.pair_of)) if len(key) else (key, key)
            stops = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(stops), values)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[2],
                "groups_sha256": digests, "pairs": lists(pa.array(pair)), "times": lists(pa.array(often.astype(np.int32))),
            })
        gc.enable()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _ROW)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links hold each pair, and whether no pair of its second id has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links"))
    second = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # at most as many rows as the first vocabulary has ids
    return pairs.withColumn("best", F.col("links") == F.max("links").over(second))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Each row's links that hold its second id's most frequent pair, and the sum of its links' counts."""
    pairs = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    joined = pairs.join(counts, "pair")
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every whole text of `documents` under the 50k byte-level and the 32k piece vocabulary."""
    import public_tokenizers

    scratch = Scratch()
    aligned = scratch.written(align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
    counts = scratch.written(link_counts(aligned))
    sums = scored(aligned, counts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = aligned.drop("pairs", "times").join(sums, "row", "left")
    return scratch.result(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
