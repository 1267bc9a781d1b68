"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary n-gram classifier per
bit, a smoothed log-likelihood ratio of hashed byte trigrams, predicts that bit;
its n-gram counts are summed over all training rows. Loss-weighted decoding
charges each language the logistic loss of its bits, weighted by how clearly the
bit's classifier separates that language, and takes the least loss. A small gap
to the next language flags ambiguity.

Defined results: null text or no letter gives `und` with score 0 and no
ambiguity; with no training rows everything is `und`; very long texts count
whole; equal texts get equal results; ties go to the smaller language name;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import arrow_rows, key_remainder, read_table

#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: Added to each bucket's count in proportion to its share over all languages.
SMOOTHING = 200.0
#: Margins are mean log ratios times this.
MARGIN_SCALE = 12.0
#: Sharpness of the score over losses.
SHARPNESS = 8.0
#: Gap of loss to the second language below which a text is ambiguous.
AMBIGUOUS_GAP = 0.05
#: Losses no further apart are equal.
TIED = 1e-9
#: An ambiguous text is rejected below so many times the score of chance.
NO_BETTER = 1.5
#: Codewords are exhaustive up to so many languages, random and longer beyond.
EXHAUSTIVE = 5
#: Bytes of a text whose trigrams are held at once.
PART = 1 << 20

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(n: int) -> np.ndarray:
    """An n x bits matrix of +1/-1 whose rows are far apart and whose columns differ."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        bits = 2 ** (n - 1) - 1
        columns = [[1 if (c >> r) & 1 else -1 for r in range(n)] for c in range(1, bits + 1)]
        return np.array(columns, dtype=float).T
    rng, length, best, apart = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, length))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gaps = code.shape[1] - code @ code.T
        np.fill_diagonal(gaps, np.inf)
        if gaps.min() > apart:
            best, apart = code, gaps.min()
    return best


def trigram_buckets(text: str, part: int = PART) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased text, non-letters as spaces, at most `part` at once."""
    shown = b" " + text.lower().encode().translate(_LETTERS) + b" "
    for at in range(0, max(len(shown) - 2, 1), part):
        a = np.frombuffer(shown[at : at + part + 2], dtype=np.uint8).astype(np.uint32)
        mixed = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
        yield (mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)


def mean_weights(text: str, weights: np.ndarray, part: int = PART) -> np.ndarray:
    """Mean over the text's trigrams of each bit's weight."""
    total, n = np.zeros(weights.shape[1]), 0
    for buckets in trigram_buckets(text, part):
        total += weights[buckets].sum(axis=0, dtype=np.float64)
        n += len(buckets)
    return total / max(n, 1)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The classifiers, from trigram counts over all of `rows` that have both columns."""
    arrow_rows(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                for buckets in trigram_buckets(text):
                    seen[lang] += np.bincount(buckets, minlength=BUCKETS)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used)), "bucket": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})

    given = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counted = given.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    named = counted["lang"].to_pylist()
    langs = sorted(set(named))
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((len(langs), BUCKETS))
    table[[place[x] for x in named], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    code = codewords(len(langs))
    if not langs:
        return {"langs": [], "code": code, "weights": np.zeros((BUCKETS, 1), np.float32), "trust": code}
    shares = table.sum(axis=0) + 1.0
    shares /= shares.sum()
    chance = (table + SMOOTHING * shares) / (table.sum(axis=1, keepdims=True) + SMOOTHING)
    up, down = (code == 1).astype(float), (code == -1).astype(float)
    mean = lambda side: (side.T @ chance) / np.maximum(side.sum(axis=0), 1)[:, None]
    weights = np.log(mean(up) / mean(down)).T if len(langs) > 1 else np.ones((BUCKETS, 1))
    weights[table.sum(axis=0) == 0] = 0  # what no language has says nothing
    # how clearly each bit sets each language apart, on the training counts themselves
    clear = np.maximum(code * (chance @ weights), 1e-6)
    return {"langs": langs, "code": code, "weights": weights.astype(np.float32), "trust": clear / clear.sum(axis=1, keepdims=True)}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, score and ambiguity for rows of bit margins."""
    loss = np.logaddexp(0.0, -margins[:, None, :] * model["code"][None, :, :])
    loss = (loss * model["trust"][None, :, :]).sum(axis=2)
    order = np.sort(loss, axis=1)
    chance = np.exp(-SHARPNESS * (loss - order[:, :1]))
    chance /= chance.sum(axis=1, keepdims=True)
    best = (loss <= order[:, :1] + TIED).argmax(axis=1)  # the first of equal ones
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, chance[np.arange(len(best)), best], gap < AMBIGUOUS_GAP


def predict(docs: DataFrame, model: dict, text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score", "ambiguous", "rejected")) -> DataFrame:
    """`docs` with the language, score, ambiguity and rejection added under `names` (columns of those names are replaced).

    Rejected are texts without a letter, and ambiguous ones whose best language scores
    less than NO_BETTER times what chance gives: no bit's classifier knows them.
    """
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            known = [bool(m["langs"]) and t is not None and letter(t) is not None for t in texts]
            langs, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            rejected = np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            if len(at):
                margins = np.stack([mean_weights(texts[i], m["weights"]) for i in at]) * MARGIN_SCALE
                best, chance, close = decode(margins, m)
                for i, k in zip(at, best, strict=True):
                    langs[i] = m["langs"][k]
                scores[at], unsure[at], rejected[at] = chance, close, close & (chance * len(m["langs"]) < NO_BETTER)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores), pa.array(unsure), pa.array(rejected)], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, " + ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "boolean", "boolean"), strict=True)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose key's remainder by 3 is not 1."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(key_remainder("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", "text", (key_remainder("doc_id", 3) == 1).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


#: Names that a table hardly has, so that its own columns stay.
_HIDDEN = ("language of the text", "score of the language", "language is ambiguous", "language is rejected")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the decoder rejects go; the others stay as they are.

    Defined results: null, empty and letterless texts go; where no row has a language
    there is nothing to learn from and all rows stay; an empty table stays empty;
    columns of any name, `score` and `lang_pred` among them, keep their values; very
    long texts count whole; repeated rows go or stay together, null keys like others.
    """
    model = fit(docs)
    if not model["langs"]:
        return docs
    return predict(docs, model, names=_HIDDEN).filter(~F.col(_HIDDEN[3])).select(docs.columns)
