"""Search and alignment operators against brute force and SQL, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from attestry.llm import alignment, impacts, threshold

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# impact-ordered search


def slow_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def slow_ranking(docs, items, k):
    terms = [(doc, Counter(slow_terms(text))) for doc, text in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, n_all = sum(n > 0 for n in sizes), sum(sizes)
    out = []
    for item, text in items:
        found = []
        asked = set(slow_terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t in asked if (df := sum(t in c for _, c in terms))}
        for (doc, c), n in zip(terms, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // (n_all or 1)
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -score) for i, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["École", "naïve", "日本", "ÀB", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, r.choice([" ", "-", ". ", "\n"]).join(r.choices(words, weights, k=r.randint(1, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "-- !"), (None, docs[0][1]), (None, "w1 w2"), (7, docs[7][1]), (403, docs[9][1]), (404, "W3 w3 É é " * 30_000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(25)] + [(30, None), (31, "?"), (32, "nowhere"), (None, "w1"), (None, "w2 w3"), (5, "w0 W0 w0")]
    return docs, items


@pytest.mark.parametrize(("shard", "held", "stretch"), [(2_000_000, 200_000, 4096), (500, 60, 16)])
@pytest.mark.parametrize("k", [5, 50])
def test_ranking_equals_brute_force(spark, corpus, monkeypatch, shard, held, stretch, k):
    docs, items = corpus
    for name, value in (("SHARD", shard), ("HELD_TERMS", held), ("STRETCH", stretch)):
        monkeypatch.setattr(impacts, name, value)
    a = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], "doc_id long, text string, score int, query int, terms string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(impacts.rank_documents(a, b, k))
    assert sorted(map(repr, got)) == sorted(map(repr, slow_ranking(docs, items, k)))


def test_ranking_of_empty_tables(spark, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], "doc_id long, text string")
    assert impacts.rank_documents(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert impacts.rank_documents(spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_score_at_a_time_stops_early():
    """One rare term of high impact decides; the postings of the common one are not all read, and scores are whole."""
    r = np.random.default_rng(2)
    n = 60_000
    terms = np.concatenate([np.zeros(n, dtype=np.int64), np.ones(10, dtype=np.int64)])
    docs = np.concatenate([np.arange(n), np.arange(10)])
    value = np.concatenate([r.integers(1, 100, n), r.integers(10_000, 10_100, 10)])
    order = np.argsort(docs, kind="stable")
    shard = impacts.Shard(np.stack([np.zeros(n, dtype=np.int64), np.arange(n)], axis=1), np.bincount(docs), terms[order], value[order], 2)
    read = []
    spread = impacts._spread

    def counted(a, b):
        out = spread(a, b)
        read.append(len(out))
        return out

    impacts._spread = counted
    try:
        places, score = shard.search(np.array([0, 1]), 10, 0)
    finally:
        impacts._spread = spread
    total = np.bincount(docs, weights=value).astype(int)
    assert sorted(places.tolist()) == list(range(10)) and (score == total[places]).all()
    assert sum(read) < n // 4


def test_long_text_is_split_in_parts(monkeypatch):
    text = "Ab cd-é " * 999
    monkeypatch.setattr(impacts, "PART", 10)
    assert impacts.term_counts(text.encode()) == Counter({b"ab": 999, b"cd": 999, "é".encode(): 999})
    assert impacts.term_counts(("x" * 500).encode()) == Counter({b"x" * 500: 1})


# threshold algorithm


def slow_products(vectors, k, queries):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in whole if i in queries}):
        held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        scores = sorted((-held(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in whole if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("shard", [65_536, 7])
@pytest.mark.parametrize("kind", ["plain", "large"])
def test_products_equal_brute_force(spark, monkeypatch, shard, kind):
    monkeypatch.setattr(threshold, "SHARD", shard)
    monkeypatch.setattr(threshold, "BLOCK", 4)
    r = np.random.default_rng(4)
    d = 6
    vectors = [(i, (r.integers(-3, 4, d) / 2).tolist()) for i in range(120)]
    vectors += [(200 + i, vectors[10][1]) for i in range(40)] + [(10, vectors[10][1])] * 15 + [(20, [0.0] * d), (20, [0.5] * d), (300, [0.0] * d)]
    if kind == "large":
        vectors += [(400, [3e15, -2e14, 1.5, 0.0, 0.0, 1e17]), (401, [1e300, 0.0, 0.0, 0.0, 0.0, -1e250]), (402, [-1e300, 1.0, 0.0, 0.0, 0.0, 5.0])]
    odd = [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3, [float("nan")] * d), (4, [float("inf")] * d), (5, [1.0, 2.0]), (None, [1.0] * d), (6, [])]
    table = spark.createDataFrame([(i, v, 1.0, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, score double, vec string").repartition(3)
    got = rows_of(threshold.highest_products(table, table.filter("vec_id % 10 = 0"), 8))
    expected = slow_products(vectors, 8, {i for i, _ in vectors if i % 10 == 0})
    assert sorted(got) == sorted(expected)


def test_products_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(rows_of(threshold.highest_products(table, table))) == [(0, 1, 1, 512 * 1024 - 1024 * 2048), (1, 1, 0, 512 * 1024 - 1024 * 2048)]
    assert threshold.highest_products(table.filter("vec_id < 0"), table.filter("vec_id < 0")).count() == 0
    assert threshold.highest_products(table, table.filter("vec_id < 0")).count() == 0


def test_threshold_stops_before_all_nodes_are_met():
    r = np.random.default_rng(5)
    points = np.floor(r.normal(0, 20, (5000, 4)))
    points[:20] += 4000
    shard = threshold._shard(np.arange(5000), points, 10)
    best = threshold._Best(10)
    met = shard.search(np.full(4, 1000.0), -1, best)
    assert met < 500
    assert best.score.tolist() == sorted((points @ np.full(4, 1000.0)).tolist(), reverse=True)[:10]


# alignment


def slow_alignment(aligner, text):
    """Tokens of the whole text, groups and links by the plain definition; None where there are no tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = aligner.first.encode(" " + text, add_special_tokens=False).ids, aligner.second.encode(text)
    sides = []
    for ids, of in ((a, aligner.first_bytes), (b, aligner.second_bytes)):
        spelt = [of[i] for i in ids]
        if b"".join(spelt) != raw:
            return None
        ends, at = [], 0
        for s in spelt:
            at += len(s)
            ends.append(at)
        sides.append(list(zip(ids, ends, strict=True)))
    shared = {e for _, e in sides[0]} & {e for _, e in sides[1]}
    groups = []
    for side in sides:
        runs, run = [], []
        for i, e in side:
            run.append(i)
            if e in shared:
                runs.append(run)
                run = []
        groups.append(runs)
    said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*groups, strict=True))
    return len(a), len(b), said, [(i, j) for i, e in sides[0] for j, f in sides[1] if e == f] if len(a) < 300 else [(x[-1], y[-1]) for x, y in zip(*groups, strict=True)]


def odd_texts():
    r = random.Random(1)
    letters = "ab .,;!?\n\n\t\r  '\"0123éü日本▁\xa0 \x1c\x85  ​<>|xyz(){}"
    out = [None, "", "a", " ", "\n", "  lead", "trail  ", "x" * 3000, "don't 12 34\r\n\r\nfoo();\r\n  bar", "hello <|endoftext|> </s> <0x41> <s>", "▁", "a\x00b", "😀 é\n\n\n日本"]
    out += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(250)]
    out += ["".join(r.choice("ab \r;") for _ in range(12)) for _ in range(60)] + [" ".join(r.choice(["the", "of", "cat's", "Straße,", "niño."]) for _ in range(200)) for _ in range(20)]
    return out + out[20:40]


@pytest.mark.parametrize(("gathered", "queried", "remembered"), [(6_000_000, 300_000, 500_000), (100, 8, 50)])
def test_alignment_equals_brute_force(spark, monkeypatch, gathered, queried, remembered):
    aligner = alignment.Aligner(BYTES, PIECES)
    texts = odd_texts()
    for name, value in (("GATHERED", gathered), ("QUERIED", queried), ("REMEMBERED", remembered)):
        monkeypatch.setattr(alignment, name, value)
    slow = [slow_alignment(aligner, t) for t in texts]
    for start in range(0, len(texts), 40):
        part = [t for t in texts[start : start + 40] if t]
        cut = [alignment._CHUNK.findall(" " + t) for t in part]
        aligner.learn(set().union(*cut))
        for t, chunks, expected in zip(part, cut, [s for s, t in zip(slow[start : start + 40], texts[start : start + 40], strict=True) if t], strict=True):
            at = [aligner.known[c] for c in chunks]
            if expected is None:
                assert (aligner.counts[at, 0] < 0).any()
                continue
            pairs = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for i in at for p in aligner.pair_of[aligner.pairs[aligner.pairs_at[i] : aligner.pairs_at[i + 1]]]]
            assert (*aligner.counts[at].sum(axis=0)[:2], ";".join(aligner.groups[i] for i in at), pairs) == expected, repr(t)


def test_corpus_wide_counts(spark, tmp_path, monkeypatch):
    aligner = alignment.Aligner(BYTES, PIECES)
    texts = odd_texts()
    table = spark.createDataFrame([(None if i == 5 else 3 if i in (6, 7) else i, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string, row int").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(alignment.op12_token_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    slow = [slow_alignment(aligner, t) for t in texts]
    counts = Counter(p for s in slow if s for p in s[3])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = []
    for i, s in enumerate(slow):
        doc = None if i == 5 else 3 if i in (6, 7) else i
        if s is None:
            expected.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            expected.append((doc, s[0], s[1], len(s[3]), len(s[3]), sum(counts[p] == most[p[1]] for p in s[3]), sum(counts[p] for p in s[3]), hashlib.sha256(s[2].encode()).hexdigest()))
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    empty = table.limit(0).select("doc_id", "text")
    assert alignment.align(empty, BYTES, PIECES).count() == 0


def test_joining_pieces_are_refused(monkeypatch):
    """A vocabulary with a piece that runs on over white space cannot be cut there."""
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b" if i == 400 else plain(self, i))
    with pytest.raises(ValueError, match="white space"):
        alignment.Aligner(BYTES, PIECES)


@pytest.mark.parametrize(("query", "sql", "tables"), [(impacts.op11_impact_search, impacts.OP11_SQL, ["documents", "benchmark"]), (threshold.op13_threshold_topk, threshold.OP13_SQL, ["embeddings"])])
def test_queries_equal_sql(spark, query, sql, tables):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert sorted(rows_of(query(spark, data))) == sorted(con.sql(sql).fetchall())
