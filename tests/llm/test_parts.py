"""Long texts in parts, and language ID against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from attestry.llm import langid, ppm

SAID = ["", "a", " \n", "one two  three\x0bfour", "x" * 50, "é ß " * 9, "\0 \x01\tq", "word " * 30 + "last"]


@pytest.mark.parametrize("size", [1, 3, 7, 20, 1000])
@pytest.mark.parametrize("order", [1, 5])
def test_parts_hold_the_same_tokens_and_cells(size, order):
    for text in [None, *SAID]:
        assert [t for part in ppm.token_parts(text, size) for t in part] == ppm.tokens_of(text)
    texts = [ppm.modelled(t) for t in SAID]
    assert texts == [b" ".join(ppm.tokens_of(t)) for t in SAID]
    got: dict[int, list] = {}
    for first, lengths, cells in ppm.in_parts(iter(texts), order, size):
        assert sum(lengths) == len(cells)
        for i, part in enumerate(np.split(cells, np.cumsum(lengths)[:-1])):
            got.setdefault(first + i, []).append(part)
    for i, text in enumerate(texts):
        assert np.concatenate(got[i]).tolist() == ppm.cells_of([text], order).tolist()


def test_a_text_longer_than_a_part(spark):
    """Scores of a text in parts are sums over its own cells and tokens, whatever else is in the table."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    long = " ".join(r.choice(words) for _ in range(350_000))
    assert len(long.encode()) > ppm.PART
    rows = spark.createDataFrame([(1, long), (2, " ".join(words)), (3, None)], "doc_id long, text string")
    model = ppm.train(rows.filter("doc_id <> 1"))
    counts = Counter(ppm.tokens_of(" ".join(words)))
    total, distinct = sum(counts.values()) + 2, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    got = {x.doc_id: x for x in ppm.score(rows, model).collect()}
    tokens = ppm.tokens_of(long)
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens) == (350_001, 350_001, total)
    assert math.isclose(got[1].base_score, log(2) + sum(log(counts[t]) * n for t, n in Counter(tokens).items()), rel_tol=1e-9)
    asked, uses = np.unique(ppm.cells_of([b" ".join(tokens)]), return_counts=True)
    own = spark.createDataFrame([(int(c), 0, int(n)) for c, n in zip(asked.astype(np.int64), uses, strict=True)], "cell long, n long, uses long")
    cells = own.unionByName(model["cells"].selectExpr("cell", "n", "0L as uses")).groupBy("cell").sum("n", "uses").toDF("cell", "n", "uses")
    want = sum(x.uses * math.log10(x.chance) for x in ppm.chances(cells).filter("uses > 0").collect())
    assert math.isclose(got[1].score, want, rel_tol=1e-9)


def slow_buckets(text: str) -> list[int]:
    shown = " " + text.lower() + " "
    data = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in shown.encode())
    out = []
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        x = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
        out.append((x ^ x >> 15) % langid.BUCKETS)
    return out


def slow_languages(learned: list[tuple], texts: list) -> list[tuple[str, float]]:
    """Language and score of each text: one trigram, one bit and one language at a time."""
    counts: dict[str, Counter] = {}
    for text, lang in learned:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slow_buckets(text))
    langs = sorted(counts)
    code = langid.codewords(len(langs))
    everything = sum(counts.values(), Counter())
    whole = sum(everything.values()) + langid.BUCKETS
    chance = lambda lang, b: (counts[lang][b] + langid.SMOOTHING * (everything[b] + 1) / whole) / (sum(counts[lang].values()) + langid.SMOOTHING)
    weights, clear = [], []
    for bit in range(code.shape[1]):
        sides = [[x for x, w in zip(langs, code, strict=True) if w[bit] == sign] for sign in (1, -1)]
        mean = lambda side, b: sum(chance(x, b) for x in side) / len(side)
        weights.append({b: math.log(mean(sides[0], b) / mean(sides[1], b)) for b in everything})
    for x, word in zip(langs, code, strict=True):
        apart = [max(word[bit] * sum(chance(x, b) * w for b, w in weights[bit].items()), 1e-6) for bit in range(len(word))]
        clear.append([a / sum(apart) for a in apart])
    out = []
    for text in texts:
        if text is None or not any(ch.isalpha() for ch in text):
            out.append(("und", 0.0))
            continue
        grams = slow_buckets(text)
        margins = [langid.MARGIN_SCALE * sum(w.get(b, 0.0) for b in grams) / len(grams) for w in weights]
        losses = [sum(t * math.log1p(math.exp(-m * w)) for t, m, w in zip(clear[i], margins, code[i], strict=True)) for i in range(len(langs))]
        least = min(losses)
        shares = [math.exp(-langid.SHARPNESS * (x - least)) for x in losses]
        best = next(i for i, x in enumerate(losses) if x <= least + 1e-9)
        out.append((langs[best], shares[best] / sum(shares)))
    return out


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    some = [(x.doc_id, x.text, x.lang) for x in docs[:120]]
    some += [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !", "de"), (1003, "abc", None), (1004, "Ω" * 40, None), some[3]]
    learned = [x for x in some if x[0] % 3 != 1]
    model = langid.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame(some, "doc_id long, text string, lang string"), model).collect()
    want = slow_languages([x[1:] for x in learned], [x[1] for x in some])
    assert len(got) == len(some)
    told = dict(zip([x[0] for x in some], want, strict=True))
    assert told[1004] == (min(model["langs"]), pytest.approx(1 / len(model["langs"])))  # no trigram of it is known
    for r in got:
        assert r.lang_pred == told[r.doc_id][0] and math.isclose(r.score, told[r.doc_id][1], abs_tol=1e-4), r.doc_id


@pytest.mark.parametrize("part", [1, 2, 5, 100])
def test_trigrams_in_parts(part):
    weights = np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    for text in ["", "a", "Ab1é", "the thing " * 20]:
        assert np.concatenate(list(langid.trigram_buckets(text, part))).tolist() == slow_buckets(text)
        assert np.allclose(langid.mean_weights(text, weights, part), langid.mean_weights(text, weights))
