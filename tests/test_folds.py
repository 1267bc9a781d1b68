"""Folds by composed functions and exact places against plain Python, on keys of every size."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import ranks, sampling, scoring
from attestry.streaming import journal, limits

KINDS = ["pass_a", "completed", "error", "retry", "strange", None]


def events(n=3000, seed=4):
    r = random.Random(seed)
    # one company has two thirds of all events, one a single event, one no name
    return [(r.choices([1, 2, 3, None], [60, 20, 10, 10])[0] if i else 9, i * 7 + 3, r.choices(KINDS, [2, 1, 9, 9, 1, 1])[0] if i % 500 else "pass_a", r.choice([True, True, False, None])) for i in range(n)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(events(), "company long, line_no long, kind string, retriable boolean").repartition(5, "line_no").cache()


SIZES = [{}, {"few": 50, "run": 40, "together": 3}, {"few": 1000, "run": 1, "together": 300}]


@pytest.mark.parametrize("sizes", SIZES)
def test_replay_equals_the_plain_fold(log, sizes):
    expected: dict = {}
    for company, line, kind, can in events():
        expected[company] = journal.fold(expected.get(company, journal.START), kind, line, bool(can))
    assert {r[0]: tuple(r)[1:] for r in journal.replay(log, **sizes).collect()} == expected


@pytest.mark.parametrize("sizes", SIZES)
def test_faults_are_counted_where_they_are(spark, log, sizes):
    manifest = spark.createDataFrame([(1,), (2,), (9,), (77,)], "company long")
    state: dict = {}
    expected: dict = {}
    for company, line, kind, can in events():
        if company not in (1, 2, 9):
            fault = "unknown company"
        else:
            a, done, error, may, _, _ = before = state.get(company, journal.START)
            state[company] = journal.fold(before, kind, line, bool(can))
            if state[company][5] == before[5]:
                continue
            fault = {"pass_a": "first stage twice", "completed": "completed before first stage" if a is None else "completed twice", "error": "failure after completion", "retry": "retry without failure" if error is None else "retry of terminal failure"}.get(kind, "unknown kind")
        n, first = expected.get(fault, (0, line))
        expected[fault] = (n + 1, first)
    found = journal.faults(log, manifest, **sizes)
    assert {r.fault: (r.n, r.first_line) for r in found.collect()} == expected
    worst = min(expected.items(), key=lambda x: x[1][1])
    with pytest.raises(ValueError, match=f"line {worst[1][1]}: {worst[0]}"):
        journal.require_sound(found)
    journal.require_sound(found.filter("n < 0"))


@pytest.mark.parametrize("sizes", SIZES)
def test_smoothed_mean(spark, sizes):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2]), i, r.choice([None, r.random() * 100])) for i in range(900)] + [(5, 1000, None), (6, 1001, 4.0), (6, None, 9.0)]
    expected: dict = {}
    for key, line, v in rows:
        if line is not None:
            n, mean = expected.get(key, (0, None))
            expected[key] = (n + 1, mean if v is None else v if mean is None else mean + 0.2 * (v - mean))
    got = {x[0]: (x[1], x[2]) for x in limits.smoothed(spark.createDataFrame(rows, "k long, at long, v double"), "k", "at", "v", **sizes).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k][0] == n and (mean is None and got[k][1] is None or abs(got[k][1] - mean) < 1e-9) for k, (n, mean) in expected.items())
    assert limits.smoothed(spark.createDataFrame([], "k long, at long, v double"), "k", "at", "v").count() == 0


def test_no_group_holds_a_large_key(log):
    """With few rows a group, no plan gathers a whole company."""
    plan = journal.replay(log, few=50, run=40, together=3)._jdf.queryExecution().toString()
    assert "_at" in plan and "BatchEvalPython" not in plan and "FlatMapGroups" not in plan


def test_places(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 1, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    least = lambda x: (x is not None, x if x is not None else 0)
    order = sorted(rows, key=lambda x: (least(x[2]), x[0]))
    assert {x.id: x.place for x in ranks.placed(df, "v", "id").collect()} == {x[0]: n for n, x in enumerate(order)}
    down = sorted(rows, key=lambda x: x[0], reverse=True)
    assert {x.id: x.place for x in ranks.placed(df, F.desc("id")).collect()} == {x[0]: n for n, x in enumerate(down)}
    seen: dict = {}
    expected = {}
    for i, g, _ in sorted(order, key=lambda x: x[0]):
        expected[i] = seen.get(g, 0)
        seen[g] = expected[i] + 1
    assert {x.id: x.place for x in ranks.placed_by(df, "g", "id").collect()} == expected
    assert ranks.placed(df.limit(0), "id").count() == 0


def test_turns_of_three_sources(spark):
    rows = [(i, "abbbc"[i % 5]) for i in range(103)]
    queues = {s: [i for i, x in rows if x == s] for s in "abc"}
    expected, place = {}, 0
    while any(queues.values()):
        heads = [(s != "b", q[0], s) for s, q in queues.items() if q]
        for _, i, s in sorted(heads):
            place += 1
            expected[i] = place
            queues[s].pop(0)
    got = ranks.in_turn(spark.createDataFrame(rows, "id long, src string"), "src", "id", "b")
    assert {x.id: x.place for x in got.collect()} == expected


def test_no_single_task_orders_a_table(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 2 == 0).alias("ok"), F.lit("s").alias("src"))
    for df in (scoring.selective_curve(rows, "v", "ok", "id"), scoring.spread_summary(rows, "v", 3), sampling.length_spread(rows, "v", "id", 5, "p"), sampling.interleave(rows, "src", "id", "s")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())], [id" not in plan
        assert not any("Window [" in line and line.rstrip().endswith("]") and "], [" not in line for line in plan.splitlines())
    curve = scoring.selective_curve(rows, "v", "ok", "id").orderBy("k").collect()
    ordered = sorted(range(200), key=lambda i: (-(i % 7), i))
    assert [(x.k, x.accuracy) for x in curve] == [(k, sum(i % 2 == 0 for i in ordered[:k]) / k) for k in range(20, 201, 20)]
    assert tuple(scoring.spread_summary(rows, "v", 3).first())[:2] == (200, 0) and scoring.spread_summary(rows, "v", 3).first().upper_median == sorted(i % 7 for i in range(200))[100]
    empty = scoring.spread_summary(rows.limit(0), "v", 3).first()
    assert empty.n == 0 and empty.upper_median is None
