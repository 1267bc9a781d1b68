"""Known answers of token traces and recorded responses."""

import math

import pytest
from pyspark.sql import functions as F

from attestry.functions import responses as R
from attestry.functions import traces


def token(text, logprob=0.0, top=(), raw=None):
    return (text, raw, logprob, [(t, p) for t, p in top])


HEAD, TAIL = '{"a":{"ai_native":0},"é":"\\"ai_native\\":0","ai_native":', ',"n":2}'


def around(entry, head=HEAD, tail=TAIL):
    return (head + entry[0] + tail, [token(head), entry, token(tail)])


CASES = {
    "both_candidates": around(token("1", math.log(0.8), [("1", math.log(0.8)), ("0", math.log(0.1))])),
    "fused_tokens_add_up": around(token("1", math.log(0.5), [("1", math.log(0.5)), (" 1", math.log(0.3)), ("0,", math.log(0.2))])),
    "masked_opponent_is_censored": around(token("0", math.log(0.98), [("0", math.log(0.98)), ("1", traces.MASKED)])),
    "too_wide": around(token("0", math.log(0.6), [("0", math.log(0.6))])),
    "own_token_not_among_candidates": around(token("1", math.log(0.6), [("0", math.log(0.4))])),
    "bytes_given": ('{"ai_native":1}', [token('{"ai_native":'), token("?", 0.0, [("1", math.log(0.9)), ("0", math.log(0.1))], [0x31]), token("}")]),
    "bytes_differ": ('{"ai_native":1}', [token('{"ai_native": '), token("1"), token("}")]),
    "no_key": ('{"x":{"ai_native":1}}', [token('{"x":{"ai_native":1}}')]),
    "no_integer": ('{"ai_native":"1"}', [token('{"ai_native":"1"}')]),
    "no_digit": around(token("7")),
    "no_logprobs": ('{"ai_native":1}', []),
    "masked_own": around(token("1", traces.MASKED, [("0", math.log(0.4))])),
    "null_text": (None, None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, *v) for k, v in CASES.items()], f"name string, text string, trace {traces.TRACE}")
    return {r.name: r for r in traces.with_confidence(rows, "text", "trace", "ai_native").collect()}


@pytest.mark.parametrize(
    ("name", "digit", "sampled", "valid"),
    [("both_candidates", 1, 0.8 / 0.9, 0.9), ("fused_tokens_add_up", 1, 0.8, 1.0), ("masked_opponent_is_censored", 0, 0.98 / 0.99, 0.99), ("own_token_not_among_candidates", 1, 0.6, 1.0)],
)
def test_confidence(found, name, digit, sampled, valid):
    r = found[name]
    assert r.problem is None and r.ai_native == digit and r.decision_token_index == 1
    assert r.sampled_probability == pytest.approx(sampled, abs=1e-9)
    assert r.valid_mass == pytest.approx(valid, abs=1e-9)
    assert r.p_one == pytest.approx(sampled if digit else 1 - sampled, abs=1e-9)


@pytest.mark.parametrize(
    ("name", "problem"),
    [("too_wide", "too_wide"), ("bytes_differ", "bytes_differ"), ("no_key", "no_key"), ("no_integer", "no_key"), ("no_digit", "no_digit"), ("no_logprobs", "no_logprobs"), ("masked_own", "no_mass"), ("null_text", "no_logprobs"), ("bytes_given", "no_digit")],
)
def test_no_confidence(found, name, problem):
    assert found[name].problem == problem and found[name].sampled_probability is None


def test_durations_and_counts(spark):
    rows = spark.createDataFrame([("1m30s",), ("250ms",), ("-3",), ("2h",), ("soon",), (None,), ("1.5",)], "s string")
    assert [r[0] for r in rows.select(R.duration_seconds(F.col("s"))).collect()] == [90.0, 0.25, 0.0, 7200.0, None, None, 1.5]
    counts = spark.createDataFrame([("1,200",), ("-1",), ("x",), (None,), ("3.9",)], "s string")
    assert [r[0] for r in counts.select(R.count_header(F.col("s"))).collect()] == [1200, None, None, None, 3]


def test_elapsed(spark):
    rows = spark.createDataFrame([(None,), (2.5,), (61.0,), (3725.0,), (-4.0,)], "s double")
    assert [r[0] for r in rows.select(R.elapsed(F.col("s"))).collect()] == ["not available", "2s", "1m 1s", "1h 2m", "0s"]


def test_usable_and_credits(spark):
    rows = spark.createDataFrame([([(" ",), ("x",)], '{"cost":"1.5"}'), ([(" ",), (None,)], '{"a":1,"b":2}'), ([], "{}"), (None, None)], "results array<struct<raw_content:string>>, usage string")
    assert [tuple(r) for r in rows.select(R.has_usable(F.col("results")), R.usage_credits(F.col("usage"))).collect()] == [(True, 1.5), (False, 3.0), (False, 0.0), (False, 0.0)]
