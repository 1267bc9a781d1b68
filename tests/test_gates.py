"""Gates before a run, pairing of runs, and archives of runs."""

import json

import pytest
from pyspark.sql import functions as F

from attestry.functions import dates, numbers, text
from attestry.operators import archive, joins, ranks, scoring
from attestry.sources import gates, sinks
from attestry.streaming import limits


def test_settings_may_not_change(spark, tmp_path):
    for run, settings in (("a", {"model": "m", "n_rows": 5, "keys": {"x": 1}}), ("b", {"model": "m", "n_rows": 6})):
        (tmp_path / run).mkdir()
        (tmp_path / run / "config.json").write_text(json.dumps(settings))
    runs = gates.run_settings(spark, f"{tmp_path}/*/config.json").orderBy("run_id")
    assert [(r.run_id, r.settings["n_rows"]) for r in runs.collect()] == [("a", "5"), ("b", "6")]
    now = runs.withColumn("now", F.create_map(F.lit("model"), F.lit("m"), F.lit("n_rows"), F.lit("5"), F.lit("new"), F.lit("1")))
    found = gates.changed_settings(now, "settings", "now", ["model", "n_rows", "new"], "run_id")
    assert sorted(map(tuple, found.collect())) == [("a", "new", None, "1"), ("b", "n_rows", "6", "5"), ("b", "new", None, "1")]
    with pytest.raises(ValueError, match="n_rows, new changed"):
        gates.require_same_settings(found)
    gates.require_same_settings(gates.changed_settings(now, "settings", "now", ["model"], "run_id"))


def test_smoke_gate(spark):
    schema = "run_id string, settings map<string,string>, n_rows int, n_completed int, n_errors int, has_final boolean, finished_at string"
    good = {"kind": "smoke", "parent": "p", "print": "f"}
    runs = [("old", good, 3, 3, 0, True, "2024-01-01"), ("new", good, 3, 3, 0, True, "2024-01-02"), ("full", good | {"kind": "full"}, 3, 3, 0, True, "2024-01-03"), ("other", good | {"parent": "q"}, 3, 3, 0, True, "2024-01-04"), ("short", good, 3, 2, 0, True, "2024-01-05"), ("failed", good, 3, 3, 1, True, "2024-01-06"), ("open", good, 3, 3, 0, False, "2024-01-07"), ("bare", None, 3, 3, 0, True, "2024-01-08")]
    found = gates.matching_smokes(spark.createDataFrame(runs, schema), {"parent": "p", "print": "f"}, 3)
    assert [r.run_id for r in found.collect()] == ["new", "old"]


def test_preflight(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id\n1\n")
    report = gates.preflight(spark, 3, [f"{tmp_path}/in.csv"], str(tmp_path), 1)
    assert all(r.ok for r in report.collect())
    gates.require_ready(report)
    with pytest.raises(ValueError, match=r"pending rows \(0\), free bytes .*, input .*gone"):
        gates.require_ready(gates.preflight(spark, 0, [f"{tmp_path}/gone*"], str(tmp_path), 1 << 60))


def test_finished_ids(spark):
    log = [("a", 1, True, None), ("a", 2, False, True), ("b", 1, False, True), ("b", 2, False, False), ("c", 1, False, False), ("c", 2, False, True), ("d", 1, None, None)]
    found = gates.finished_ids(spark.createDataFrame(log, "k string, at int, ok boolean, again boolean"), "k", "at", F.col("ok"), F.col("again"))
    assert sorted(map(tuple, found.collect())) == [("a", True), ("b", False), ("d", False)]


def test_ids_that_are_missing(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    joins.require_ids(df, [2, 1], "id")
    with pytest.raises(ValueError, match=r"missing id: \[9, 7\]"):
        joins.require_ids(df, [9, 1, 7], "id")
    with pytest.raises(Exception, match="lookup: no v"):
        joins.required(df, "v", "lookup").collect()
    assert joins.required(df.filter("id = 1"), "v", "lookup").first().v == "x"


def test_runs_are_paired(spark):
    gold = spark.createDataFrame([(i, str(i % 2)) for i in range(10)], "id int, gold string")
    a = spark.createDataFrame([(i, "1") for i in range(12)], "id int, pred string")
    b = spark.createDataFrame([(i, None if i == 3 else str(i % 2)) for i in range(10)], "id int, pred string")
    r = scoring.paired_accuracy(scoring.paired(gold, a, b, "id", "gold", "pred")).first()
    assert (r.n, r.run, r.baseline, r.only_run, r.only_baseline) == (10, 0.5, 0.9, 1, 5) and abs(r.delta + 0.4) < 1e-12
    for bad in (b.filter("id <> 4"), b.unionAll(b.filter("id = 4"))):
        with pytest.raises(Exception, match="not paired at 4"):
            scoring.paired(gold, a, bad, "id", "gold", "pred").collect()


def test_archived_runs_are_numbered(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "scored.json").write_text("{}")
    store = tmp_path / "archive"
    assert [sinks.archive_run(spark, str(tmp_path / "run"), str(store)) for _ in range(2)] == [1, 2]
    (store / "7").mkdir()
    assert sinks.archive_run(spark, str(tmp_path / "run"), str(store)) == 8 and (store / "8" / "scored.json").read_text() == "{}"
    assert not [p for p in store.iterdir() if not p.name.isdigit() and not p.name.endswith(".crc")]


def test_fingerprints_of_columns(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "v string")
    one = [r[0] for r in rows.select(archive.request_fingerprint({"z": "1", "v": F.col("v")})).collect()]
    other = [r[0] for r in rows.select(archive.request_fingerprint({"v": F.col("v"), "z": "1"})).collect()]
    assert one == other and one[0] != one[1]


def test_sums_before_and_the_credit_gate(spark):
    rows = [(i, None if i % 11 == 3 else i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "at long, cost long").repartition(6)
    got = {r.at: (r.place, r.total) for r in ranks.summed_before(df, "at", F.col("cost")).collect()}
    total = 0
    for i, v in rows:
        assert got[i] == (i, total)
        total += v or 0
    for budget in (-1, 0, 5, 200, 10_000):
        spent, started = 0, []
        for n, (i, v) in enumerate(rows):
            if spent + (spent / n if n else 0) > budget:
                break
            started.append(i)
            spent += v or 0
        assert sorted(r.at for r in limits.credit_gate(df, "at", "cost", budget).collect()) == started
    assert limits.credit_gate(df.limit(0), "at", "cost", 1).count() == 0


def test_iso_times_in_any_session(spark):
    said = ["2024-03-01T12:00:00Z", "2024-03-01T12:00:00+02:00", "2024-03-01T12:00:00-0530", "2024-03-01 12:00:00.25", "2024-03-01T12:00", "2024-03-01", "12:00", "x", "", None, "2024-02-30T00:00:00Z"]
    want = [1709294400.0, 1709287200.0, 1709314200.0, 1709294400.25, 1709294400.0, *[None] * 6]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for place in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", place)
            got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", (F.unix_micros(dates.iso_time(F.col("s"))) / 1e6).alias("t")).orderBy("i").collect()
            assert [r.t for r in got] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_prompts_and_confidence_texts(spark):
    assert text.prompt("a {family_block} b", "x") == "a x b"
    for bad in ("a b", "{family_block} {family_block}"):
        with pytest.raises(ValueError, match="template"):
            text.prompt(bad, "x")
    rows = spark.createDataFrame([(0.5,), (None,), (1.0,)], "c double")
    assert [r[0] for r in rows.select(numbers.confidence_text(F.col("c"))).collect()] == ["0.5", "", "1.0"]
    for bad in (1.01, float("nan"), -0.1):
        with pytest.raises(Exception, match="confidence"):
            spark.createDataFrame([(bad,)], "c double").select(numbers.confidence_text(F.col("c"))).collect()
