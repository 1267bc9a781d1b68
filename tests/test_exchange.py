"""Manifests that vouch for their rows, cells that come back as they were, reports on runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from attestry import contracts as C
from attestry.functions import text
from attestry.operators import reports
from attestry.sources import files, manifests, sinks

ROW = "id long, name string, source string"


@pytest.fixture
def manifest(spark, tmp_path):
    rows = spark.createDataFrame([(5, "e", "live"), (1, 'a "quoted"\nname', "live"), (3, None, "dead"), (9, "x", None)], ROW)
    return manifests.write_manifest(rows, "id", "source", str(tmp_path))


def damaged(path, change):
    """Every line of the manifest through `change`; sums beside the files go."""
    for name in os.listdir(path):
        whole = os.path.join(path, name)
        if name.endswith(".crc"):
            os.remove(whole)
        elif name.startswith("part-"):
            with open(whole) as f:
                lines = [change(json.loads(x)) for x in f.read().splitlines() if x]
            with open(whole, "w") as f:
                f.write("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines if x is not None))


def test_manifest_round_trip(spark, manifest, tmp_path):
    got = manifests.load_manifest(spark, manifest, ROW, "source").orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(0, 1, 'a "quoted"\nname', "live"), (1, 3, None, "dead"), (2, 5, "e", "live"), (3, 9, "x", None)]
    again = spark.createDataFrame([(9, "x", None), (3, None, "dead"), (5, "e", "live"), (1, 'a "quoted"\nname', "live")], ROW)
    assert manifests.write_manifest(again, "id", "source", str(tmp_path)) == manifest
    empty = manifests.write_manifest(again.limit(0), "id", "source", str(tmp_path))
    assert manifests.load_manifest(spark, empty, ROW, "source").count() == 0
    with pytest.raises(ValueError, match="null or repeated id: 3"):
        manifests.write_manifest(again.union(again.filter("id = 3")), "id", "source", str(tmp_path))


CHANGES = [
    ("row_count", lambda x: None if x.get("id") == 5 else x),
    ("source_counts", lambda x: x | {"source": "dead"} if x.get("id") == 5 else x),
    ("rows_sha256", lambda x: x | {"name": "other"} if x.get("id") == 5 else x),
    ("rows_sha256", lambda x: x | {"ordinal": 7} if x.get("id") == 5 else x),
    ("manifest_sha256", lambda x: x | {"manifest_sha256": "0" * 64} if x["record_type"] == "manifest" else x),
    ("one header", lambda x: None if x["record_type"] == "manifest" else x),
    ("this version", lambda x: x | {"manifest_version": 2} if x["record_type"] == "manifest" else x),
    ("no record of a manifest", lambda x: x | {"record_type": "note"} if x.get("id") == 5 else x),
]


@pytest.mark.parametrize(("fault", "change"), CHANGES)
def test_damaged_manifests_fail(spark, manifest, fault, change):
    damaged(manifest, change)
    with pytest.raises(ValueError, match=fault):
        manifests.load_manifest(spark, manifest, ROW, "source")


def test_cells_come_back_as_they_were(spark, tmp_path):
    cells = ["", " a ", '"', '""', 'x"y', "a,b", "two\nlines", "\\", '\\"', "\t", "a\\", "né"]
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "id string, note string")
    for part in ("a", "b"):
        sinks.append_csv(rows.filter(F.col("id") % 2 == int(part == "b")), ["id", "note", "more"], f"{tmp_path}/t")
    for read in (files.csv_contract(spark, f"{tmp_path}/t", ["id", "note", "more"], "id"), files.csv_strings(spark, f"{tmp_path}/t", ["id", "note", "more"])):
        assert {(r.id, r.note, r.more) for r in read.collect()} == {(str(i), c, "") for i, c in enumerate(cells)}


def test_dashboard_of_few_rows(spark):
    rows = spark.createDataFrame([("1A", "RAD-H", "GENAI-ERA", True, 1), ("1A", "RAD-L", "GENAI-ERA", True, 4), ("0A", "RAD-NA", "PRE-GENAI", False, 3), ("?", None, None, None, None)], "s string, l string, e string, y boolean, c int")
    domains = ("s", C.SUBCLASSES), ("l", C.RADS), ("e", C.ERAS)
    got = {(r.metric, r.first, r.second): r.value for r in reports.dashboard(rows, *domains, "y", "c").collect()}
    assert got["rows", "", ""] == 4 and got["yes_pct", "", ""] == 50 and got["low_confidence", "", ""] == 1
    assert got["subclass", "1A", ""] == 2 and got["subclass", "1B", ""] == 0 and got["heatmap", "1A", "RAD-L"] == 1
    assert got["yes_pct_by_era", "GENAI-ERA", ""] == 100 and got["yes_pct_by_era", "PRE-GENAI", ""] == 0
    assert [got["confidence_by_subclass", "1A", q] for q in ("q1", "median", "q3", "mean", "count")] == [1.75, 2.5, 3.25, 2.5, 2]
    assert got["confidence_by_subclass", "", "median"] == 3 and ("confidence_by_subclass", "?", "mean") not in got
    none = {(r.metric, r.first, r.second): r.value for r in reports.dashboard(rows.limit(0), *domains, "y", "c").collect()}
    assert none["rows", "", ""] == 0 and none["yes_pct", "", ""] is None and not any(k[0] == "confidence" for k in none)


def test_reports_on_a_run(spark):
    plan = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "id int, valid boolean")
    out = spark.createDataFrame([("success", 1.0), ("thin", None), (None, 2.0), ("error", 0.5)], "status string, credits double")
    row = reports.run_report(plan, plan.filter("id = 4").union(plan.filter("id = 4")), out, "id", F.col("valid"), "status", "credits").first()
    assert (row.skipped_existing, row.skipped_invalid, row.attempted, row.completed, row.empty_results, row.failed, row.credits) == (1, 2, 4, 1, 1, 2, 3.5)
    log = spark.createDataFrame([("a", True, None, "success"), ("a", True, None, "success"), ("b", False, False, "error"), ("c", False, True, "error"), (" ", True, None, "thin_evidence"), ("d", None, None, "success"), (None, True, None, "other")], "id string, ok boolean, retryable boolean, status string")
    assert tuple(reports.resume_tallies(log, "id", "ok", "retryable", "status").first()) == (2, 1, 2, 2)


def test_names_of_runs(spark):
    rows = spark.createDataFrame([("2026_small_HIGH_r12",), ("x_r1_y",), ("",), (None,)], "r string")
    got = rows.select(text.run_effort(F.col("r")), text.run_repeat(F.col("r")), text.run_model(F.col("r"), ["small"])).collect()
    assert [tuple(r) for r in got] == [("high", 12, "small"), (None, None, ""), (None, None, ""), (None, None, "")]
    named = lambda key: spark.createDataFrame([(key,)], "k string").select(text.custom_id(F.col("k"), "c-")).first()[0]
    assert named(" a b ") == "c-a-b"
    with pytest.raises(Exception, match="blank key"):
        named("nan")


def test_scope_of_odd_hosts(spark):
    rows = spark.createDataFrame([("http://a(b)+c.example:80/x",)], "u string")
    pattern = text.scope_pattern(F.col("u"))
    assert rows.select(F.regexp_like(text.archive_url(F.col("u"), F.lit("2023")), pattern)).first()[0]
    assert not rows.select(F.regexp_like(F.lit("/web/2023/http://a(b)+c-example:80/x"), pattern)).first()[0]
