"""Folders of runs, appending sinks and the command line."""

import json
import os

import pytest

from attestry.__main__ import main
from attestry.sources import runs, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_scored_reports_newest_first(spark, tmp_path):
    for i, run in enumerate(["old", "new"]):
        os.utime(put(tmp_path / run / "scored.json", json.dumps({"model": "small", "ece": i / 10})), (i + 1e9, i + 1e9))
    schemas = "model string, ece double", "model string, effort string"
    assert [r.run_id for r in runs.scored_reports(spark, str(tmp_path), *schemas).collect()] == ["new", "old"]
    put(tmp_path / "old" / "config.json", '{"model":"large","effort":"low"}')
    found = runs.scored_reports(spark, str(tmp_path), *schemas).collect()
    assert [(r.run_id, r.model, r.effort, r.ece) for r in found] == [("new", "small", None, 0.1), ("old", "large", "low", 0.0)]


@pytest.mark.parametrize(("text", "want"), [('{"instances":[{"n":2,"identity":"b"},{"n":1},{"n":"3"},{"x":1},7]}', [1, 2]), ("{broken", []), ("[1]", []), (None, [])])
def test_registry(spark, tmp_path, text, want):
    path = tmp_path / "instances.json"
    if text is not None:
        path.write_text(text)
    assert [r.n for r in runs.registry(spark, str(path), "n int, identity string").collect()] == want


def test_newest_manifest(spark, tmp_path):
    row = '{"record_type":"row","id":1}\n'
    for i, (name, n) in enumerate([("a", 1), ("b", 1), ("c", 9)]):
        os.utime(put(tmp_path / f"manifest_{name}.jsonl", f'{{"record_type":"manifest","n_rows":{n}}}\n{row}'), (1e9 + i, 1e9 + i))
    glob = str(tmp_path / "manifest_*.jsonl")
    assert runs.newest_manifest(spark, glob, "n_rows long", "id long").endswith("manifest_b.jsonl")
    with pytest.raises(ValueError, match="no manifest"):
        runs.newest_manifest(spark, str(tmp_path / "none_*"), "n_rows long", "id long")


def test_journal_stream_appends_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    os.mkdir(source)
    for batch in range(2):
        with open(f"{source}/{batch}.json", "w") as f:
            f.write(json.dumps({"company": batch, "kind": "pass_a"}) + "\n")
        events = spark.readStream.schema("company long, kind string").json(source)
        sinks.journal_stream(events, out, mark).awaitTermination(120)
    assert sorted(r.company for r in spark.read.schema("company long").json(out).collect()) == [0, 1]


def test_final_only_when_complete(spark, tmp_path):
    rows = spark.range(3)
    assert sinks.publish_run(rows, 3, str(tmp_path)) and (tmp_path / "final").exists()
    assert not sinks.publish_run(rows, 4, str(tmp_path)) and not (tmp_path / "final").exists()


def test_appends(spark, tmp_path):
    for _ in range(2):
        sinks.append_json(spark.range(2), f"{tmp_path}/log")
        sinks.append_csv(spark.range(2), ["id", "note"], f"{tmp_path}/table")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    assert spark.read.csv(f"{tmp_path}/table", header=True).columns == ["id", "note"]


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "trace_confidence" in capsys.readouterr().out
    assert main(["sql", "value_counts"]) == 0 and "GROUP BY" in capsys.readouterr().out
    assert main(["run", "value_counts", "/root/testdata/sf0.001", "--out", f"{tmp_path}/rows"]) == 0
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 7


@pytest.mark.parametrize("bad", ["", "../x", "a/b", ".hidden"])
def test_run_id(bad):
    assert runs.valid_run_id("r-1.2_x") == "r-1.2_x"
    with pytest.raises(ValueError):
        runs.valid_run_id(bad)
