"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

A partition's pieces (matches of the tokenizer's pattern) become token-position
rows in an in-process DuckDB table. A recursive query joins each adjacent pair
with the merge table, contracts every piece's leftmost pair of minimum rank and
stops once no piece has a pair left. Decoding joins token rows with the
vocabulary and puts a run together by an ordered aggregate. Both act on the
distinct pieces only: a text's ids are its pieces' ids in order, and a text's
bytes are its pieces' bytes in order.

A piece over LONG bytes is first taken apart. Tokens only grow, so two neighbours that
no token of the vocabulary has inside it, one after the other, never meet: the piece
falls into segments there, each contracted by the recursive query as a word is. While a
segment is too long for that, arrays of its tokens contract the pairs of the least rank
from the left, as many at once as leave no pair of that rank or a lower one that would
be next. Memory grows with the piece's bytes, not with its steps: what a query makes is
bounded (see the README for times).

Defined results: a null text counts as empty; an empty text has no ids and the
digest of no bytes; repeated rows give repeated results; other columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestry.llm.common import arrow_rows, read_table

#: Pieces whose ids a worker remembers between batches.
REMEMBERED = 250_000
#: Bytes of text that are gathered before a query runs.
GATHERED = 12_000_000
#: Bytes of pieces in one query, and the least of a long piece.
QUERIED, LONG = 800_000, 300
#: Tokens of a segment that a query contracts, rows that such a query makes, and steps between looks for segments.
SEGMENT, MADE, STEPS = 64, 1_500_000, 16
#: Rank of a pair that is no token.
NONE = 1 << 40

_ENCODE = """
WITH RECURSIVE live(w, pos, tok, nxt, npos, step) AS (
    SELECT w, pos, tok, nxt, npos, 0 FROM start_rows
  UNION ALL
    SELECT a.w, a.pos,
           (CASE WHEN a.pos = b.rpos THEN b.merged ELSE a.tok END)::INT,
           (CASE WHEN a.npos = b.lpos THEN b.merged ELSE a.nxt END)::INT,
           (CASE WHEN a.npos = b.lpos THEN b.rpos ELSE a.npos END)::INT,
           a.step + 1
    FROM live a JOIN (
        SELECT w, (best.rank)::INT AS merged, best.lpos AS lpos, best.rpos AS rpos
        FROM (SELECT l.w, min({'rank': m.rank, 'lpos': l.pos, 'rpos': l.npos}) AS best
              FROM live l JOIN merges m ON m.pair = (l.tok::BIGINT << 32) | l.nxt
              GROUP BY l.w)) b ON a.w = b.w
    WHERE a.pos <> b.lpos)
SELECT w, pos, tok FROM live JOIN (SELECT w, max(step) AS step FROM live GROUP BY w) USING (w, step)
"""
#: Both ways at once: token rows in order, and joined with the vocabulary, their letters in order.
_ROUND = "SELECT w, list(tok ORDER BY pos) AS ids, string_agg(v.letters, '' ORDER BY pos) AS letters FROM (" + _ENCODE + ") JOIN vocabulary v ON v.id = tok GROUP BY w ORDER BY w"
_DECODE = """
SELECT w, string_agg(v.letters, '' ORDER BY t.pos) AS letters
FROM token_rows t JOIN vocabulary v ON v.id = t.tok GROUP BY w ORDER BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BpeTables:
    """The merge table and the vocabulary in an in-process DuckDB."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        found = [
            (ranks[token[:cut]] << 32 | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.pairs, first = np.unique(np.array([p for p, _ in found], dtype=np.int64), return_index=True)
        self.pair_ranks = np.array([r for _, r in found], dtype=np.int64)[first]
        self.inside: set[bytes] = set()
        # rows are bounded, so nothing needs a folder of the machine
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        pairs = pa.table({"pair": pa.array([p for p, _ in found], pa.int64()), "rank": pa.array([r for _, r in found], pa.int64())})
        # a byte is held as the character of its code point, since string_agg takes no blobs
        words = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "letters": pa.array([t.decode("latin-1") for t in ranks])})
        for name, table in (("merges", pairs), ("vocabulary", words)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; a piece that is itself a token is that token."""
        out: list[list[int] | None] = [[rank] if (rank := self.ranks.get(p)) is not None else ([] if not p else None) for p in pieces]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, (raw, _) in zip(left, self.round_trip([pieces[i] for i in left]), strict=True):
            out[i] = np.frombuffer(raw, dtype="<u4").tolist()
        return out

    def _rows(self, pieces: list[bytes]) -> pa.Table:
        """Token-position rows of pieces that are not empty."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        tok = self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        pos = np.arange(len(tok)) - np.repeat(ends - lengths, lengths)
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[ends - 1] = -1
        return pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": tok, "nxt": nxt, "npos": (pos + 1).astype(np.int32)})

    def _over(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.con.register(name, rows)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they are no token together."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def _apart(self, tok: np.ndarray) -> np.ndarray:
        """Whether each token and the next can never be in one: no token has their bytes inside it."""
        if not self.inside:
            self.inside = {t[i:j] for t in self.ranks for i in range(len(t) - 1) for j in range(i + 2, len(t) + 1)}
        key, of = np.unique((tok[:-1] << 32) | tok[1:], return_inverse=True)
        apart = [self.token_bytes[k >> 32] + self.token_bytes[k & 0xFFFFFFFF] not in self.inside for k in key.tolist()]
        return np.array(apart, dtype=bool)[of]

    def _contracted(self, tok: np.ndarray) -> tuple[np.ndarray, bool]:
        """`tok` after some steps, and whether any pair is left. A step takes pairs of the least rank, in the order in which single merges would."""
        rank = self._ranks(tok[:-1], tok[1:])
        for _ in range(STEPS):
            least = int(rank.min()) if len(rank) else NONE
            if least == NONE:
                return tok, False
            hits = np.flatnonzero(rank == least)
            # of hits that share tokens every other one is taken
            run = np.flatnonzero(np.append(True, np.diff(hits) > 1))
            hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0]
            before = np.where(hits > 0, tok[hits - 1], -1)
            before[1:][hits[1:] == hits[:-1] + 2] = least  # the hit before is merged by then
            after = np.where(hits + 2 < len(tok), tok[np.minimum(hits + 2, len(tok) - 1)], -1)
            merged = np.full(len(hits), least)
            early = np.minimum(np.where(before >= 0, self._ranks(before, merged), NONE), np.where(after >= 0, self._ranks(merged, after), NONE)) <= least
            if early.any():
                hits = hits[: int(early.argmax()) + 1]
            keep = np.ones(len(tok), dtype=bool)
            keep[hits + 1] = False
            tok = tok.copy()
            tok[hits] = least
            tok, rank = tok[keep], np.append(rank, NONE)[keep]
            at = hits - np.arange(len(hits))  # places of the new tokens
            for near in (at - 1, at):
                near = near[(near >= 0) & (near < len(tok) - 1)]
                rank[near] = self._ranks(tok[near], tok[near + 1])
            rank[-1] = NONE
            rank = rank[:-1]
        return tok, True

    def _encode_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        tok, more = self.byte_rank[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64), True
        while more:
            starts = np.append(0, np.flatnonzero(self._apart(tok)) + 1)
            lengths = np.diff(np.append(starts, len(tok)))
            if lengths.max() <= SEGMENT:
                return self._segments(tok, starts, lengths)
            tok, more = self._contracted(tok)
        return tok.tolist()

    def _segments(self, tok: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[int]:
        """Ids of segments in order, so many in a query as make no more rows in all their steps than MADE."""
        part = np.cumsum(lengths * lengths) // (2 * MADE)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(part) > 0)), len(starts))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = tok[starts[a] : starts[b] if b < len(starts) else len(tok)].astype(np.int32)
            w = np.repeat(np.arange(b - a, dtype=np.int32), lengths[a:b])
            nxt = np.append(mine[1:], np.int32(-1))
            nxt[np.append(w[1:] != w[:-1], True)] = -1
            pos = np.arange(len(mine), dtype=np.int32)
            rows = pa.table({"w": w, "pos": pos, "tok": mine, "nxt": nxt, "npos": pos + 1})
            out += self._over("start_rows", rows, _ENCODE + "ORDER BY w, pos")["tok"].to_pylist()
        return out

    def round_trip(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each piece's ids as little-endian bytes, and what those ids decode to; pieces are not empty."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(pieces)
        for i, piece in enumerate(pieces):
            if len(piece) > LONG:
                ids = self._encode_long(piece)
                parts = [self.decode([ids[at : at + QUERIED // 4]])[0] for at in range(0, len(ids), QUERIED // 4)]
                out[i] = (np.array(ids, dtype="<u4").tobytes(), b"".join(parts))
        short, size, part = [i for i, done in enumerate(out) if done is None], 0, []
        for at, i in enumerate(short):
            part.append(i)
            size += len(pieces[i])
            if size >= QUERIED or at == len(short) - 1:
                found = self._over("start_rows", self._rows([pieces[k] for k in part]), _ROUND)
                ids = found["ids"].combine_chunks()
                raw = ids.values.to_numpy().astype("<u4").tobytes()
                stops = (4 * ids.offsets.to_numpy()).tolist()
                for k, a, b, x in zip(part, stops[:-1], stops[1:], found["letters"].to_pylist(), strict=True):
                    out[k] = (raw[a:b], x.encode("latin-1"))
                part, size = [], 0
        return out

    def decode(self, runs: list[list[int]]) -> list[bytes]:
        """Bytes of each run of ids."""
        lengths = np.array([len(r) for r in runs], dtype=np.int64)
        tok = np.fromiter((t for r in runs for t in r), dtype=np.int32, count=int(lengths.sum()))
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({"w": np.repeat(np.arange(len(runs), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": tok})
        found = self._over("token_rows", rows, _DECODE)
        out = [b""] * len(runs)
        for w, letters in zip(found["w"].to_pylist(), found["letters"].to_pylist(), strict=True):
            out[w] = letters.encode("latin-1")
        return out


_TABLES: dict[str, BpeTables] = {}


def tables_for(path: str) -> BpeTables:
    """The tables of one vocabulary file, made once in each Python worker."""
    if path not in _TABLES:
        _TABLES[path] = BpeTables(load_ranks(path))
    return _TABLES[path]


class _Remembered:
    """Ids and decoded bytes by piece, forgotten when there are too many."""

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self.ids: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.back.clear()
        new = []
        for piece in pieces:
            if piece not in self.ids:
                rank = self.tables.ranks.get(piece.encode())
                if rank is None:
                    new.append(piece)
                else:
                    self.ids[piece] = rank.to_bytes(4, "little")
                    self.back[piece] = self.tables.token_bytes[rank]
        for piece, (ids, back) in zip(new, self.tables.round_trip([p.encode() for p in new]), strict=True):
            self.ids[piece] = ids
            self.back[piece] = back


_MEMORY: dict[str, _Remembered] = {}


def _gathered(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    held, texts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        texts += [t or "" for t in batch.column(text_col).to_pylist()]
        size += batch.column(text_col).nbytes
        if size >= GATHERED:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids of every whole text: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    `vocabulary` is the path of a tiktoken rank file that every executor has;
    `pattern` splits a text into the pieces that merges never cross.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        # millions of small objects without cycles: the collector would only walk them again and again
        gc.disable()
        find = regex.compile(pattern).findall
        if vocabulary not in _MEMORY:
            _MEMORY[vocabulary] = _Remembered(tables_for(vocabulary))
        memory = _MEMORY[vocabulary]
        for held, texts in _gathered(batches, text_col):
            split = [find(t) for t in texts]
            memory.learn(set().union(*split))
            rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            ids_out = []
            for pieces in split:
                ids = b"".join(map(memory.ids.__getitem__, pieces))
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(b"".join(map(memory.back.__getitem__, pieces))).hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
            table = {id_col: pa.concat_arrays([b.column(id_col) for b in held]), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "ids_sha256": rows["ids_sha256"], "decoded_sha256": rows["decoded_sha256"]}
            if with_ids:
                table["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(table)
        gc.enable()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every row's ids: id, decoded (binary). Null or no ids give no bytes."""
    arrow_rows(encoded.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_for(vocabulary)
        for batch in batches:
            runs = [r or [] for r in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "decoded": pa.array(tables.decode(runs), pa.binary())})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of `documents` with the public 50k byte-level vocabulary."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
