"""Quantiles, resamples and models against numpy and closed forms."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import aggregates, draws, sampling, scoring, stats
from attestry.operators.quantiles import exact_quantiles
from attestry.plans.catalog import QUERIES


@pytest.mark.parametrize("bins", [1024, 128])
def test_quantiles_equal_numpy(spark, bins):
    r = random.Random(3)
    groups = {
        "ties": [2.0] * 300 + [5.0] * 40, "one": [7.5], "none": [None, float("nan")], "two": [1.0, 4.0], "wide": [-1e308, 1e308, 0.0, 5e-324, 1.0], "odd": [r.random() ** 9 for _ in range(400)],
        None: [float(x) for x in range(101)], "endless": [-math.inf, 1.0, 2.0, 3.0, math.inf, 2.5, 2.6],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = {x.g: (x.n, x.q) for x in exact_quantiles(df, "v", shares, "g", bins=bins).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for g, (n, q) in got.items():
        values = sorted(v for v in groups[g] if v is not None and v == v)
        assert n == len(values)
        for s, x in zip(shares, q, strict=True):
            place = s * (n - 1)
            low, high = values[math.floor(place)], values[math.ceil(place)]
            want = low if low == high else low + (high - low) * (place - math.floor(place))
            assert x == want or abs(x - want) <= 1e-12 * abs(want) or x != x and want != want, (g, s)
    whole = exact_quantiles(df.filter("g = 'odd'"), "v", [0.5], bins=bins).first()
    assert whole.n == 400 and abs(whole.q[0] - np.median(groups["odd"])) < 1e-15
    assert exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    summary = {x.g: x for x in aggregates.percentiles(df, "v", "g").collect()}
    assert summary["none"].p50 is None and summary["ties"].p95 == 5.0 and len(summary) == len(groups)


def test_quota_sample(spark):
    """Quotas are met, spread over the thirds by size, the same whatever the order of rows."""
    rows = [(i, "ab"[i % 3 == 0], i) for i in range(90)] + [(200 + i, "c", 5) for i in range(2)]
    df = spark.createDataFrame(rows, "id long, g string, size long")
    picked = sampling.quota_sample(df, "g", "size", "id", {"a": 7, "b": 6, "c": 5}, "s").collect()
    again = sampling.quota_sample(df.orderBy(F.desc("id")).repartition(5), "g", "size", "id", {"a": 7, "b": 6, "c": 5}, "s").collect()
    assert sorted(x.id for x in picked) == sorted(x.id for x in again)
    count = lambda g, t: sum(x.g == g and x.tercile == t for x in picked)
    assert [count("a", t) for t in ("short", "medium", "long")] == [3, 2, 2] and [count("b", t) for t in ("short", "medium", "long")] == [2, 2, 2]
    assert sum(x.g == "c" for x in picked) == 2  # a stratum of fewer rows than its quota gives all
    cuts = np.quantile([s for _, _, s in rows], [1 / 3, 2 / 3])
    assert all(x.tercile == ("short" if x.size <= cuts[0] else "medium" if x.size <= cuts[1] else "long") for x in picked)
    rank = lambda i: __import__("hashlib").sha256(f"s:{i}".encode()).hexdigest()
    shorts = sorted((i for i, g, s in rows if g == "a" and s <= cuts[0]), key=rank)
    assert sorted(x.id for x in picked if x.g == "a" and x.tercile == "short") == sorted(shorts[:3])


@pytest.mark.parametrize("size", [65_536, 40, 7])
def test_every_resample_has_all_draws(spark, size):
    values = [(i * 3, float(i % 5), float(i % 2)) for i in range(230)]
    df = spark.createDataFrame(values, "id long, v double, w double").repartition(4)
    got = scoring.bootstrap(df, ["v", "w"], "id", 400, 11, size=size).collect()
    assert sorted(x.resample for x in got) == list(range(400)) and {x.draws for x in got} == {230}
    means = np.array([x.v for x in got])
    deviation = np.std([v for _, v, _ in values]) / math.sqrt(230)
    assert abs(means.mean() - np.mean([v for _, v, _ in values])) < 4 * deviation / 20 and 0.85 < means.std() / deviation < 1.15
    again = scoring.bootstrap(df.orderBy("id"), ["v", "w"], "id", 400, 11, size=size).collect()
    assert sorted(got) == sorted(again)
    assert sorted(got) != sorted(scoring.bootstrap(df, ["v", "w"], "id", 400, 12, size=size).collect())


def test_draws_of_ranges_are_binomial():
    """Ranges share each resample's draws out, as the multinomial does."""
    n, size, resamples = 1000, 300, 4000
    parts = np.array([scoring.draws_of(n, size, at, 5, resamples) for at in range(4)])
    assert (parts.sum(axis=0) == n).all()
    for part, rows in zip(parts, (300, 300, 300, 100), strict=True):
        share = rows / n
        assert abs(part.mean() - rows) < 5 * math.sqrt(n * share * (1 - share) / resamples)
        assert 0.9 < part.var() / (n * share * (1 - share)) < 1.1


def digests(seed, b, at, n):
    """n words of digests in turn, one text at a time."""
    words = b"".join(hashlib.md5(b"%d:%d:%d:%d" % (seed, b, at, w), usedforsecurity=False).digest() for w in range(-(-n // 4)))
    return np.frombuffer(words, dtype=">u4")[:n]


@pytest.mark.parametrize(("seed", "at", "most", "resamples"), [(20260705, 0, 399, range(0, 1300, 7)), (3, 12, 41, range(5)), (2**63, 10**8 + 7, 1003, range(99_998, 100_003)), (5, 1, 1, range(30)), (7, 2, 66_100, range(8, 12))])
def test_words_are_those_of_the_digests(seed, at, most, resamples):
    resamples, seen = np.array(resamples), []
    counts = np.random.default_rng(1).integers(max(0, most - 200), most + 1, len(resamples))
    for some, words in draws.digest_words(seed, resamples, at, counts):
        got = np.stack(words, axis=2).reshape(len(words[0]), -1)
        for row, b, n in zip(got, resamples[some], counts[some], strict=True):
            assert (row[:n] == digests(seed, int(b), at, int(n))).all()
            seen.append(b)
    assert seen == list(resamples)


def test_words_cost_a_fraction_of_single_digests():
    start = time.thread_time()
    for b in range(1000, 1010):
        digests(20260705, b, 3, 65_536)
    single, start = time.thread_time() - start, time.thread_time()
    for _ in draws.digest_words(20260705, np.arange(1000, 1010), 3, np.full(10, 65_536)):
        pass
    assert time.thread_time() - start < single / 2


def test_resamples_of_ranges_equal_plain_draws(spark):
    """Draws that differ between resamples and ranges, counted out one digest at a time."""
    n, size, resamples = 230, 40, 30
    rows = [(i * 3, float(i * i % 17), float(i % 2)) for i in range(n)]
    got = {x.resample: (x.v, x.w) for x in scoring.bootstrap(spark.createDataFrame(rows, "id long, v double, w double").repartition(3), ["v", "w"], "id", resamples, 11, size=size).collect()}
    parts = [scoring.draws_of(n, size, at, 11, resamples) for at in range(-(-n // size))]
    for b in range(resamples):
        drawn = []
        for at, part in enumerate(parts):
            own = rows[at * size : (at + 1) * size]
            drawn += [own[int(w) * len(own) >> 32] for w in digests(11, b, at, int(part[b]))]
        assert len(drawn) == n and got[b] == (sum(x[1] for x in drawn) / n, sum(x[2] for x in drawn) / n)


def test_each_interval_draws_its_own_value(spark, monkeypatch):
    drawn, bootstrap = [], scoring.bootstrap
    monkeypatch.setattr(scoring, "bootstrap", lambda df, values, *a: drawn.append(values) or bootstrap(df, values, *a))
    rows = [QUERIES[q](spark, "/root/testdata/sf0.001").collect() for q in ("bootstrap_ci", "paired_bootstrap")]
    assert drawn == [["hit"], ["gap"]] and [len(r) for r in rows] == [1, 1]


def test_degenerate_resamples(spark):
    one = spark.createDataFrame([(1, 1.0)], "id long, v double")
    assert [(x.v, x.draws) for x in scoring.bootstrap(one, ["v"], "id", 5, 1).collect()] == [(1.0, 1)] * 5
    assert scoring.bootstrap(one.limit(0), ["v"], "id", 5, 1).count() == 0


def people(n=900, seed=6):
    r = np.random.default_rng(seed)
    ai = r.random(n) < 0.6
    funding = np.round(r.normal(0, 1, n), 3)
    era = np.where(r.random(n) < 0.5, "NEW", "OLD").astype(object)
    era[:20] = "unknown"
    rad = np.where(ai, r.choice(["RAD-H", "RAD-M", "RAD-L"], n), "RAD-NA")
    category = r.choice(list("aaaabbbccdef"), n)
    group = np.where(r.random(n) < 0.4, "core", "applied")
    eta = -1 + 0.8 * ai + 0.3 * funding + 0.5 * (rad == "RAD-H") - 0.4 * (era == "OLD")
    died = (r.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return list(zip(died.tolist(), ai.tolist(), [None if i % 97 == 5 else f for i, f in enumerate(funding.tolist())], era.tolist(), category.tolist(), rad.tolist(), group.tolist(), strict=True))


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    share = y.mean()
    ll, null = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), len(y) * (share * math.log(share) + (1 - share) * math.log(1 - share))
    return beta, np.sqrt(np.diag(np.linalg.inv(h))), 1 - ll / null


def test_three_models_equal_numpy(spark):
    rows = people()
    df = spark.createDataFrame(rows, "died int, ai boolean, fund double, era string, vertical string, rad string, grp string").repartition(4)
    got: dict = {}
    for x in stats.death_models(df, "died", "ai", "fund", "era", "vertical", "rad", "grp", top=3).collect():
        assert x.available
        got.setdefault(x.model, []).append(x)
    known = [r for r in rows if r[3] != "unknown" and r[2] is not None]
    native = [r for r in known if r[1]]
    column = lambda data, f: np.array([float(f(r)) for r in data])
    top = "abc"
    designs = {
        "model1": (known, {"ai_native": lambda r: r[1], "log_funding": lambda r: r[2], "era[OLD]": lambda r: r[3] == "OLD", "category[a]": lambda r: r[4] == "a", "category[b]": lambda r: r[4] == "b", "category[c]": lambda r: r[4] == "c"}),
        "model2": (native, {"rad[RAD-H]": lambda r: r[5] == "RAD-H", "rad[RAD-M]": lambda r: r[5] == "RAD-M", "grp[core]": lambda r: r[6] == "core", "log_funding": lambda r: r[2], "era[OLD]": lambda r: r[3] == "OLD"}),
        "model3": (native, {"rad[RAD-H]": lambda r: r[5] == "RAD-H", "rad[RAD-M]": lambda r: r[5] == "RAD-M", "log_funding": lambda r: r[2], "rad[RAD-H]:log_funding": lambda r: (r[5] == "RAD-H") * r[2], "rad[RAD-M]:log_funding": lambda r: (r[5] == "RAD-M") * r[2], "era[OLD]": lambda r: r[3] == "OLD"}),
    }
    # the first level in order is the base; of the categories that is "Other", by which all but the three most frequent go
    for model, (data, terms) in designs.items():
        x = np.stack([np.ones(len(data)), *[column(data, f) for f in terms.values()]], axis=1)
        beta, error, r2 = newton(x, column(data, lambda r: r[0]))
        assert [t.term for t in got[model]] == ["intercept", *terms], model
        for t, b, e in zip(got[model], beta, error, strict=True):
            assert t.n == len(data) and abs(t.coefficient - b) < 1e-7 and abs(t.std_error - e) < 1e-7 and abs(t.pseudo_r2 - r2) < 1e-9
            assert math.isclose(t.low, math.exp(b - 1.959963984540054 * e), rel_tol=1e-6) and math.isclose(t.high, math.exp(b + 1.959963984540054 * e), rel_tol=1e-6)
            assert abs(t.p_value - math.erfc(abs(b / e) / math.sqrt(2))) < 1e-7
    assert set(top) < {r[4] for r in rows}


def test_models_that_are_not_available(spark):
    few = spark.createDataFrame([(1, 0.0), (0, 1.0)] * 10, "y int, x double")
    whole = spark.createDataFrame([(i % 2, float(i)) for i in range(60)], "y int, x double")
    apart = spark.createDataFrame([(int(i > 30), float(i)) for i in range(60)], "y int, x double")
    x = F.col("x")
    problem = lambda df, terms, **k: stats.logit_models(df, "y", {"m": stats.Design(F.lit(True), terms)}, **k).first()
    assert problem(few, [("x", x)]).problem == "insufficient variation" and problem(whole.filter("y = 1"), [("x", x)]).problem == "insufficient variation"
    assert problem(whole, [("x", x), ("twice", 2 * x)]).problem == "singular matrix"
    assert problem(apart, [("x", x)]).problem in ("singular matrix", "no convergence")
    nearly = spark.createDataFrame([(int(i % 25 != 0), float(i % 2)) for i in range(200)] + [(1, 5.0)] * 3 + [(0, 5.0)], "y int, x double")
    sparse = [("five", (x == 5).cast("double"))]
    assert problem(nearly, sparse).available and problem(nearly, sparse, stable=("m",), widest=1.0).problem == "unstable confidence intervals"
    assert stats.logistic(few, "y", ["x"]).count() == 0
