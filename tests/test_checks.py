"""Schema checks, publication, sliding windows over spells, and archive adapters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import text, validated
from attestry.operators import ranks
from attestry.sources import files, publication
from attestry.streaming import limits

SCHEMA = {
    "type": "object",
    "properties": {
        "verdict": {"type": "integer", "enum": [0, 1]}, "why": {"type": "string", "max_words": 3}, "score": {"type": ["number", "null"], "minimum": 1, "maximum": 5},
        "sources": {"type": "array", "items": {"type": "object", "properties": {"url": {"type": "string"}, "page": {"type": "integer"}}, "required": ["url"]}}, "ok": {"type": "boolean"},
    },
    "required": ["verdict", "why", "sources"],
}
GOOD = {"verdict": 1, "why": "a b c", "sources": [{"url": "u", "page": 2}, {"url": "v"}]}

CASES = [
    (GOOD, None), (GOOD | {"score": None, "ok": False}, None), (GOOD | {"score": 2.5}, None), (GOOD | {"sources": []}, None),
    (None, "$: no JSON"), ("", "$: no JSON"), ("{", "$: no JSON"), ('{"a":1} x', "$: no JSON"), ('{"a":1},{"b":2}', "$: no JSON"), ([GOOD], "$: no object"), ("3", "$: no object"), ("null", "$: no object"),
    ({"verdict": 1, "sources": []}, "$.why: missing"), (GOOD | {"zz": 1, "aa": 2}, "$.aa: unknown"), (GOOD | {"verdict": "1"}, "$.verdict: no integer"), (GOOD | {"verdict": 1.5}, "$.verdict: no integer"),
    (GOOD | {"verdict": 2}, "$.verdict: no allowed value"), (GOOD | {"verdict": None}, "$.verdict: no integer"), (GOOD | {"verdict": True}, "$.verdict: no integer"), (GOOD | {"why": "a b c d"}, "$.why: over 3 words"),
    (GOOD | {"score": 0}, "$.score: under 1"), (GOOD | {"score": 5.01}, "$.score: over 5"), (GOOD | {"score": "3"}, "$.score: no number or null"), (GOOD | {"ok": 1}, "$.ok: no boolean"),
    (GOOD | {"sources": {}}, "$.sources: no array"), (GOOD | {"sources": [{"url": "u"}, {"page": 1}]}, "$.sources[1].url: missing"), (GOOD | {"sources": [{"url": "u", "page": "x"}, 3]}, "$.sources[0].page: no integer"),
    (GOOD | {"sources": [{"url": "u", "x": 1}]}, "$.sources[0].x: unknown"), (GOOD | {"sources": [None]}, "$.sources[0]: no object"),
]


def test_first_faults(spark):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x), fault) for i, (x, fault) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, want string")
    got = validated.checked(df, "t", SCHEMA, "verdict int, why string").orderBy("i").collect()
    assert [(r.i, r.fault) for r in got] == [(r.i, r.want) for r in got]
    assert got[0].value.verdict == 1 and all(r.value is None for r in got if r.fault)
    open_ = SCHEMA | {"extra": True}
    assert validated.checked(df.filter("t like '%zz%'"), "t", open_, "verdict int").first().fault is None
    with pytest.raises(Exception, match="invalid: .*missing"):
        validated.checked(df.filter("want = '$.why: missing'"), "t", SCHEMA, "verdict int", strict=True).collect()
    assert validated.checked(df.limit(0), "t", SCHEMA, "verdict int").count() == 0


STATE = "company long, pass_a_line long, completed_line long, error_line long, error_retriable boolean"


def test_publication_of_a_run(spark, tmp_path):
    manifest = spark.createDataFrame([(1,), (2,), (3,), (4,)], "company long")
    state = [(1, 1, 5, None, None), (2, 2, None, 7, True), (3, 3, None, None, None), (9, 1, 2, None, None)]
    results = spark.createDataFrame([(i, f"r{i}") for i in range(1, 10)], "company long, result string")
    folder = str(tmp_path / "run")
    assert publication.current_version(spark, folder) is None
    with pytest.raises(ValueError, match="nothing is published"):
        publication.published(spark, folder, "final", "company long")
    assert publication.publish_state(manifest, spark.createDataFrame(state, STATE), results, "company", folder, {"sha": "x"}) is False
    read = lambda name, schema: sorted(map(tuple, publication.published(spark, folder, name, schema).collect()), key=repr)
    assert read("in_progress", "company long, result string") == [(1, "r1")]
    assert read("failures", "company long, stage string, state string, error_line long, reason string") == [(2, "pass_b", "pass_a_only", 7, None), (3, "pass_b", "pass_a_only", None, "not_completed"), (4, "pass_a", "not_started", None, "not_completed")]
    facts = publication.summary(spark, folder)
    assert (facts["sha"], facts["manifest_rows"], facts["completed"], facts["incomplete"], facts["rows"]) == ("x", 4, 1, 3, {"in_progress": 1, "failures": 3})
    with pytest.raises(Exception):  # noqa: B017  no final rows before all are complete
        read("final", "company long")
    whole = spark.createDataFrame([(i, 1, 2, None, None) for i in range(1, 5)], STATE)
    assert publication.publish_state(manifest, whole, results, "company", folder, {}) is True
    assert read("final", "company long") == [(1,), (2,), (3,), (4,)] and read("failures", "company long") == []
    # back to an incomplete state: the final rows go with their version
    publication.publish_state(manifest, spark.createDataFrame(state, STATE), results, "company", folder, {}, stopped=True)
    assert len(list((tmp_path / "run" / "versions").iterdir())) == 2 and "final" not in publication.summary(spark, folder)["rows"]
    assert {r[4] for r in read("failures", "company long, stage string, state string, error_line long, reason string")} == {None, "shutdown"}


@pytest.mark.parametrize("step", [0, 1])
def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    """Killed while it writes artefacts, before its summary, or before the pointer moves."""
    folder = str(tmp_path)
    one, two = (spark.createDataFrame([(i,)], "v long") for i in (1, 2))
    publication.publish(spark, folder, {"a": one, "b": one}, {"n": 1})
    replace, calls = files.replace_file, []

    def dies(*args):
        calls.append(args)
        if len(calls) > step:
            raise KeyboardInterrupt
        replace(*args)

    monkeypatch.setattr(files, "replace_file", dies)
    with pytest.raises(KeyboardInterrupt):
        publication.publish(spark, folder, {"a": two, "b": two}, {"n": 2})
    with pytest.raises(Exception, match="broken"):
        publication.publish(spark, folder, {"a": two, "b": two.select(F.raise_error(F.lit("broken")).alias("v"))}, {"n": 2})
    monkeypatch.undo()
    assert publication.summary(spark, folder)["n"] == 1
    assert [publication.published(spark, folder, x, "v long").first().v for x in "ab"] == [1, 1]
    publication.publish(spark, folder, {"a": two, "b": two}, {"n": 2})
    assert [publication.published(spark, folder, x, "v long").first().v for x in "ab"] == [2, 2]


@pytest.mark.parametrize("windows", [1, 4])
def test_trailing_windows(spark, windows):
    r = random.Random(7)
    rows = [(i, r.choice("aaaab") if i % 50 else None, r.choice([None, *range(-50, 400)]), r.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v long").repartition(5)
    got = {x.id: (x.n, x.t) for x in limits.trailing(df, "s", 60, {"n": F.count("*"), "t": F.sum("v")}, "k", windows=windows).collect()}
    for i, k, s, _ in rows:
        near = [v for _, k2, s2, v in rows if k2 == k and s is not None and s2 is not None and s - 60 < s2 <= s]
        assert got[i] == ((len(near), sum(near)) if s is not None else (None, None)), i


def test_running_places_and_least_values(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, r.randint(0, 1000)])) for i in range(400)]
    got = {x.id: (x.place, x.least) for x in ranks.running(spark.createDataFrame(rows, "id long, g string, v long").repartition(6), "g", "id", F.col("v")).collect()}
    seen: dict = {}
    for i, g, v in rows:
        n, least = seen.get(g, (0, None))
        seen[g] = (n + 1, v if least is None else least if v is None else min(v, least))
        assert got[i] == seen[g]


def test_archived_pages_read_as_live_ones(spark):
    lines = "# We build AI agents\nOur site https://acme.example/a is here\nJust words"
    stored = "12 captures\nAbout this capture\n# We build AI agents\nOur site https://web.archive.org/web/20230314000000if_/https:/acme.example/a is here\nThe Wayback Machine - x\nJust words"
    live = spark.createDataFrame([(1, "https://acme.example/", lines), (2, "https://b.example/", None)], "id long, url string, raw string")
    kept = live.select("id", "url", text.signal_lines(F.col("raw")).alias("lines"))
    old = spark.createDataFrame([(1, "https://web.archive.org/web/20230314000000if_/https://acme.example/", stored), (2, "https://web.archive.org/web/20230314000000if_/https://b.example/", None)], "id long, url string, raw string")
    found = text.archived_evidence(old, "url", "raw", html=False)
    assert text.parity(kept, found, "id", "url", "lines").count() == 0
    changed = found.withColumn("url", F.when(F.col("id") == 1, "https://c.example/").otherwise(F.col("url"))).filter("id = 1")
    report = {(x.id, x.column): (x.first, x.second) for x in text.parity(kept, changed, "id", "url", "lines").collect()}
    assert report[1, "url"] == ('{"v":"https://acme.example/"}', '{"v":"https://c.example/"}') and report[2, "url"][1] == '{"v":null}' and (1, "lines") not in report


def test_scope_pattern(spark):
    pattern = spark.createDataFrame([("https://www.a-b.example/x",), ("",), (None,)], "u string").select(text.scope_pattern(F.col("u")).alias("p")).collect()
    assert pattern[0].p == r"/web/\d+[a-z_]*/https?:/+(?:www\.)?a\-b\.example.*" and pattern[1].p == pattern[2].p == ""
