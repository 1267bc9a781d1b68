"""LM scoring by prediction by partial matching over bytes.

The model is a byte-context trie. Symbols are the 256 bytes and the end of a text.
A cell of the trie is a context of up to ORDER symbols and the symbol after it, with
its count over all training documents; nothing is left out, at any size. The trie is
a table by level, never in one place: a level's chances come from those of the next
shorter contexts by a join on (context, symbol) and sums over the at most SYMBOLS
cells of each context.

A symbol seen c times in a context of n has weight 2c - 1 of 2n. A symbol unseen
there costs the context's escape, its distinct symbols of 2n, and is coded in
the next shorter context with the longer one's symbols excluded; contexts are
nested, so each level excludes what the level above has seen. Below the empty
context all symbols are equal. Every (context, symbol) that the scored texts hold
gets its chance so, and a text's code length is a sum of look-ups: the cells of most
uses, at most HELD_CELLS, are in every worker, the others are joined. A text is
modelled as its tokens joined by one space and an end, the same events as those
of the unigram base score.

Defined results: null text counts as empty, which is the end alone; texts are
scored whole; repeated rows are scored alike; a null key stays null; with no training
documents the base is that of no counts and the model is uniform; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.common import arrow_rows, checkpointed, key_remainder, read_table

#: Bytes and the end, which is symbol 0; bits of a symbol in a cell's number.
SYMBOLS, BITS = 257, 9
#: Symbols of the longest context.
ORDER = 5
#: Most tokens and most cells that every worker holds; all others are joined.
HELD_TOKENS, HELD_CELLS = 150_000, 1_000_000
#: Symbols that are worked on at once: texts together while they are short, a longer one in parts.
PART = 1_000_000


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def token_parts(text: str | None, size: int = PART) -> Iterator[list[bytes]]:
    """The tokens of a text, in one list, or those of a longer text by some `size` bytes, cut at white space."""
    if len(text or "") < size // 4:
        yield tokens_of(text)
        return
    data = (text or "").encode().lower().translate(bytes(32 if 9 <= b <= 13 else b for b in range(256)))
    at = 0
    while at < len(data):
        cut = data.rfind(b" ", at, at + size) if at + size < len(data) else len(data)
        if cut < at:
            cut = data.find(b" ", at + size)
            cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut + 1


def modelled(text: str | None) -> bytes:
    """The tokens joined by one space."""
    return b" ".join(b" ".join(part) for part in token_parts(text) if part)


def _numbers(s: np.ndarray, order: int) -> np.ndarray:
    """Every symbol from the place `order` on with the `order` symbols before it."""
    n = len(s) - order
    cell = s[:n].copy()
    for i in range(1, order + 1):
        cell <<= np.uint64(BITS)
        cell |= s[i : i + n]
    return cell


def cells_of(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """For every symbol of each text and its end, its context and itself as one number, the symbol in the last bits."""
    # ends stand between the texts, `order` of them, so that contexts do not cross; only the first is coded
    gap = b"\0" * order
    s = np.frombuffer(gap + gap.join(texts) + b"\0", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = order + np.cumsum(lengths + order) - lengths - order
    for i in range(order):
        s[begins - 1 - i] = 0
    s[-1] = 0
    cell = _numbers(s, order)
    if len(texts) > 1 and order > 1:
        keep = np.ones(len(cell), dtype=bool)
        ends = begins[:-1] + lengths[:-1] - order
        for i in range(1, order):
            keep[ends + i] = False
        cell = cell[keep]
    return cell


def _cells_from(text: bytes, at: int, n: int, order: int) -> np.ndarray:
    """Cells of `n` symbols of a text and its end, from the place `at` on."""
    known = min(at, order)
    some = np.frombuffer(text[at - known : at + n], dtype=np.uint8)
    s = np.zeros(order + n, dtype=np.uint64)
    s[order - known : order - known + len(some)] = some
    s[order - known : order - known + len(some)] += np.uint64(1)
    return _numbers(s, order)


def in_parts(texts: Iterable[bytes], order: int = ORDER, size: int = PART) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(place of a text, symbols of it and of those after it, their cells), some `size` symbols at once."""
    held, first, n = [], 0, 0
    for i, text in enumerate(texts):
        if held and n + len(text) >= size:
            yield first, [len(t) + 1 for t in held], cells_of(held, order)
            held, n = [], 0
        if len(text) >= size:
            for at in range(0, len(text) + 1, size):
                some = min(size, len(text) + 1 - at)
                yield i, [some], _cells_from(text, at, some, order)
            continue
        first = first if held else i
        held.append(text)
        n += len(text) + 1
    if held:
        yield first, [len(t) + 1 for t in held], cells_of(held, order)


class _Slots:
    """An open-addressing table from numbers to rows of floats, looked up for whole arrays."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(1.5 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.EMPTY, dtype=np.uint64)
        self.rows = np.zeros((1 << bits, rows.shape[1]))
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == self.EMPTY
            # of those that want one free slot, the last writer has it
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.rows[at[placed]] = rows[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not there."""
        at = self._home(keys)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        left = np.flatnonzero((got != keys) & (got != self.EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got = self.keys[at]
            hit = got == keys[left]
            out[left[hit]] = at[hit]
            go = ~hit & (got != self.EMPTY)
            left, at = left[go], at[go]
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts, and the ends as a token of a space and a word."""
    words: Counter = Counter()

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})

    for batch in batches:
        for text in batch.column("text").to_pylist():
            for tokens in token_parts(text):
                words.update(tokens)
                if len(words) > 500_000:
                    yield packed()
                    words.clear()
            words[b" end"] += 1
    yield packed()


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the texts with their counts, in the documents learned from and in all."""
    cells, learned, uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh: dict[bool, list[np.ndarray]] = {True: [], False: []}

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"cell": pa.array(cells.astype(np.int64)), "n": pa.array(learned), "uses": pa.array(uses)})

    def merged() -> None:
        nonlocal cells, learned, uses
        parts, known, used = [cells], [learned], [uses]
        for is_learned, lists in fresh.items():
            if lists:
                new, n = np.unique(np.concatenate(lists), return_counts=True)
                parts.append(new)
                known.append(n if is_learned else np.zeros_like(n))
                used.append(n)
                lists.clear()
        both = np.concatenate(parts)
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        cells = both[first]
        learned, uses = (np.add.reduceat(np.concatenate(x)[order], first) if len(first) else np.zeros(0, np.int64) for x in (known, used))

    size = 0
    for batch in batches:
        flags = [bool(f) for f in batch.column("learn").to_pylist()]
        texts = batch.column("text")
        for is_learned in (True, False):
            some = (modelled(t.as_py()) for t, f in zip(texts, flags, strict=True) if f is is_learned)
            for _, _, found in in_parts(some):
                fresh[is_learned].append(found)
                size += len(found)
                if size > 6_000_000:
                    merged()
                    size = 0
                    if len(cells) > 4_000_000:
                        yield packed()
                        cells, learned, uses = cells[:0], learned[:0], uses[:0]
    merged()
    yield packed()


def chances(cells: DataFrame, order: int = ORDER) -> DataFrame:
    """(cell, uses, chance) for every row of `cells` (cell, n, uses), the cells of `order` with those of all training texts.

    A level's rows carry weight w, chance f after an escape from here, chance p as
    the first context asked, and their context's whole weight and distinct symbols.
    """
    no_escape = F.col("distinct") >= SYMBOLS

    def with_weights(table: DataFrame) -> DataFrame:
        here = Window.partitionBy("context")  # at most SYMBOLS rows each
        seen = F.col("n") > 0
        w = F.when(seen, 2.0 * F.col("n") - 1).otherwise(0.0)
        return table.withColumn("context", F.shiftrightunsigned("cell", BITS)).withColumn("w", w).withColumns({"whole": F.sum("w").over(here), "distinct": F.sum(seen.cast("double")).over(here)} | ({"excluded": F.sum(F.when(seen, F.col("up.w")).otherwise(0.0)).over(here)} if "up" in table.columns else {}))

    def with_chance(table: DataFrame, above: Column) -> DataFrame:
        """p from the weights and f; `above` where the context was never seen."""
        escape = F.when(no_escape, 0.0).otherwise(F.col("distinct"))
        total = F.col("whole") + escape
        p = F.when(F.col("whole") == 0, above).when(F.col("w") > 0, F.col("w") / total).otherwise(escape / total * F.col("f"))
        return table.withColumn("p", p)

    def level(k: int) -> DataFrame:
        if k == order:
            return cells
        return cells.groupBy(F.col("cell").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("cell")).agg(F.sum("n").alias("n"))

    rows = with_weights(level(0)).withColumn("f", 1.0 / F.greatest(SYMBOLS - F.col("distinct"), F.lit(1.0)))
    rows = with_chance(rows, F.lit(1.0 / SYMBOLS))
    for k in range(1, order + 1):
        up = rows.select(F.col("cell").alias("short"), F.struct("w", "f", "p", "whole", "distinct").alias("up"))
        below = level(k).withColumn("short", F.col("cell").bitwiseAND(F.lit((1 << BITS * k) - 1)))
        rows = with_weights(below.join(up, "short"))
        new = F.when(F.col("up.distinct") >= SYMBOLS, 0.0).otherwise(F.col("up.distinct") - F.col("distinct"))
        scale = F.greatest(F.col("up.whole") - F.col("excluded") + new, F.lit(1.0))
        f = F.when(F.col("up.w") > 0, F.col("up.w") / scale).otherwise(F.when(new > 0, new / scale).otherwise(1.0) * F.col("up.f"))
        rows = with_chance(rows.withColumn("f", f), F.col("up.p"))
        if k == 2:
            rows = checkpointed(rows.select("cell", "w", "f", "p", "whole", "distinct"))
    return rows.select("cell", "uses", F.col("p").alias("chance"))


def train(docs: DataFrame, learn: Column | None = None) -> dict:
    """Token counts and trie cells, tables both, of the `docs` (column text) for which `learn` holds, all by default.

    Cells of the other documents are there too, with no count, so that `score` of the
    same documents need not ask for them again.
    """
    arrow_rows(docs.sparkSession)
    given = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn") if learn is not None else F.lit(True).alias("learn"))
    counted = checkpointed(given.filter("learn").select("text").mapInArrow(_count_words, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    ends = sum(int(r.n) for r in counted.filter(F.col("token") == F.lit(b" end")).collect())
    words = counted.filter(F.col("token") != F.lit(b" end"))
    held, least, sizes = _most(words, "n", HELD_TOKENS)
    cells = checkpointed(given.mapInArrow(_count_cells, "cell long, n long, uses long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")))
    return {"words": words, "held": dict(zip(held["token"].to_pylist(), held["n"].to_pylist(), strict=True)), "least": least, "ends": ends, "total": sum(n for _, n in sizes.values()) + ends, "distinct": sum(t for t, _ in sizes.values()) + (ends > 0), "cells": cells}


def _most(table: DataFrame, count: str, room: int) -> tuple[pa.Table, int, dict[int, tuple[int, int]]]:
    """Rows of the largest counts, whole powers of two, at most `room` of them; the least power that is there; rows and sums by power."""
    power = F.floor(F.log2(count))
    sizes = {int(r["power"]): (int(r["rows"]), int(r["total"])) for r in table.groupBy(power.alias("power")).agg(F.count("*").alias("rows"), F.sum(count).alias("total")).collect()}
    least = 64
    while least > 0 and room >= sizes.get(least - 1, (0, 0))[0]:
        least -= 1
        room -= sizes.get(least, (0, 0))[0]
    return table.filter(power >= least).toArrow(), least, sizes  # at most `room` rows


_BUILT: dict[str, tuple[_Slots, dict[bytes, float]]] = {}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", same: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    `same`: the documents are among those that `train` was given.
    """
    arrow_rows(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cells = model["cells"]
    if not same:
        asked = given.select("text", F.lit(False).alias("learn")).mapInArrow(_count_cells, "cell long, n long, uses long")
        cells = cells.withColumn("uses", F.lit(0).cast("long")).unionByName(asked).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))
    asked = checkpointed(chances(cells).filter("uses > 0").select("cell", "uses", F.log10("chance").alias("log")))
    held, least, _ = _most(asked, "uses", HELD_CELLS)
    scale = model["total"] + 0.5 * (model["distinct"] + 1)
    sent = docs.sparkSession.sparkContext.broadcast((model["held"], model["ends"], held["cell"].to_numpy().astype(np.uint64), held["log"].to_numpy()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        counts, ends, numbers, values = sent.value
        if name not in _BUILT:
            # a worker lays out one model's tables, once
            _BUILT.clear()
            _BUILT[name] = (_Slots(numbers, values[:, None]), {t: float(np.log10((n + 0.5) / scale)) for t, n in counts.items()})
        slots, logs = _BUILT[name]
        end_log = float(np.log10((ends + 0.5) / scale))
        kinds = (("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("times", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()))

        def other_cells(rest: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            """Rows of cells that are not held here, of the rows `of`."""
            order = np.lexsort((rest, of))
            of, rest = of[order], rest[order]
            start = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (rest[1:] != rest[:-1])))
            n = len(start)
            # a key of a space, a letter and the cell's number: no token
            keys = np.empty((n, 10), dtype=np.uint8)
            keys[:, 0], keys[:, 1] = 32, 99
            keys[:, 2:] = rest[start].astype(">u8").view(np.uint8).reshape(n, 8)
            columns = {"row": pa.array(of[start]), "doc_id": pa.nulls(n, pa.int64()), "key": pa.FixedSizeBinaryArray.from_buffers(pa.binary(10), n, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary()), "times": pa.array(np.diff(np.append(start, len(rest)))), "known": pa.nulls(n, pa.int64()), "base": pa.nulls(n, pa.float64()), "bits": pa.nulls(n, pa.float64())}
            return pa.RecordBatch.from_pydict(columns)

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})

        for batch in batches:
            texts = batch.column("text")
            bits = np.zeros(len(texts))
            for first, lengths, cells in in_parts(modelled(t.as_py()) for t in texts):
                slot = slots.find(cells)
                there = slot >= 0
                bits[first : first + len(lengths)] += np.add.reduceat(np.where(there, slots.rows[slot, 0], 0.0), np.cumsum([0, *lengths[:-1]]))
                if not there.all():
                    yield other_cells(cells[~there], np.repeat(np.arange(row + first, row + first + len(lengths)), lengths)[~there])
            out = []
            for doc_id, text, log in zip(batch.column("doc_id").to_pylist(), texts, bits.tolist(), strict=True):
                known, base, length = int(ends > 0), end_log, 1
                for tokens in token_parts(text.as_py()):
                    length += len(tokens)
                    for token, n in Counter(tokens).items():
                        value = logs.get(token)
                        if value is None:
                            out.append((row, None, token, n, None, None, None))
                        else:
                            known += n
                            base += n * value
                    if len(out) > 200_000:
                        yield packed(out)
                        out = []
                # a space and the row's number: no token, so it joins nothing and goes to no common place
                out.append((row, doc_id, b" %d" % row, length, known, base, log))
                row += 1
            yield packed(out)

    parts = given.mapInArrow(run, "row long, doc_id long, key binary, times long, known long, base double, bits double")
    rare_words = model["words"].filter(F.floor(F.log2("n")) < model["least"]).select(F.col("token").alias("key"), "n", F.lit(None).cast("double").alias("log"))
    rare_cells = asked.filter(F.floor(F.log2("uses")) < least).select(F.concat(F.lit(b" c"), F.unhex(F.lpad(F.hex("cell"), 16, "0"))).alias("key"), F.lit(None).cast("long").alias("n"), "log")
    joined = parts.join(rare_words.unionByName(rare_cells), "key", "left")
    is_row, is_cell = F.col("bits").isNotNull(), F.col("log").isNotNull()
    n = F.coalesce("n", F.lit(0))
    word = ~is_row & ~is_cell
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias(id_col),
        F.sum(F.when(is_row, F.col("times"))).alias("n_tokens"),
        F.sum(F.when(is_row, F.col("known")).when(word & (n > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.when(is_row, F.col("base")).when(word, F.col("times") * F.log10((n + 0.5) / F.lit(float(scale))))).alias("base_score"),
        F.sum(F.when(is_row, F.col("bits")).when(is_cell, F.col("times") * F.col("log"))).alias("score"),
    )
    return sums.select(id_col, "n_tokens", "n_known", F.lit(int(model["total"])).cast("long").alias("train_tokens"), "base_score", "score")


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learned from those whose key's remainder by 5 is not 1."""
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, key_remainder("doc_id", 5) != 1), same=True)
    return out.select("doc_id", (key_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
