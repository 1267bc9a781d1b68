"""Known answers of cleaning, dates, readers and the journal."""

import json
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.functions import dates, numbers, text
from attestry.operators import archive, stats
from attestry.sources import files, sinks
from attestry.streaming import journal


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def _cohort_cases():
    """Days around the boundary in every accepted form, months and years around it, and what is no date."""
    for day, era in ((date(2023, 3, 14) + timedelta(n), "GENAI-ERA" if n >= 0 else "PRE-GENAI") for n in (-400, -1, 0, 1, 400)):
        for form in ("%Y-%m-%d", "%d%b%Y", "%d-%b-%Y", "%m/%d/%Y", "%d-%b-%y"):
            yield day.strftime(form), era
    for text_, era in (("2023-03", "GENAI-ERA"), ("2023-02", "PRE-GENAI"), ("2022-12", "PRE-GENAI"), ("2024", "GENAI-ERA"), ("2023", "PRE-GENAI")):
        yield f"  {text_} ", era
    for junk in (None, "", " ", "none", "2023-00", "2023-14", "31/31/2024", "spring 2024"):
        yield junk, "PRE-GENAI"


@pytest.mark.parametrize(("given", "want"), list(_cohort_cases()))
def test_cohort(spark, given, want):
    assert one(spark, given, dates.cohort_of) == want


@pytest.mark.parametrize(("given", "want"), [("01nov2016", "2016-11"), ("2020-05", "2020-05"), ("about 1999", "1999"), ("", "Unknown"), ("soon", "soon")])
def test_founded_month(spark, given, want):
    assert one(spark, given, dates.founded_month) == want


@pytest.mark.parametrize(("given", "want"), [("1m30s", 90.0), ("250ms", 0.25), ("1,200", 1200.0), ("2h", 7200.0), ("soon", None)])
def test_duration(spark, given, want):
    assert one(spark, given, dates.duration_seconds) == want


def test_lines(spark):
    page = "  Home \n\nOur  platform helps.\nour platform helps!\n![x](a.png)\n[Go](http://x)\nPrivacy Policy\n+1 (555) 010-9999\nWe sell data"
    got = one(spark, page, lambda c: text.first_seen(text.signal_lines(c)))
    assert got == ["Our platform helps.", "We sell data"]


def test_budget_puts_signal_first_and_stops(spark):
    got = one(spark, "\n".join(["x" * 30] * 2 + ["# head", "y" * 90]), lambda c: text.within_budget(F.split(c, "\n"), 50))
    assert got == ["# head", "x" * 30]


def test_archive_chrome_and_hosts(spark):
    assert one(spark, "12 captures\nTimestamps\n| Jan | Feb |\nReal https://web.archive.org/web/2020if_/https:/a.com", text.without_archive_chrome) == "Real https://a.com"
    assert one(spark, "WWW.Example.com/x", text.host_of) == "example.com"
    assert one(spark, "a.github.io", text.is_shared_host) is True


def test_wilson_and_buckets(spark):
    low, high = numbers.wilson(F.col("x"), F.lit(10))
    r = spark.createDataFrame([(5,)], "x int").select(low.alias("l"), high.alias("h")).first()
    assert abs(r.l - 23.6593) < 1e-3 and abs(r.h - 76.3407) < 1e-3
    from attestry.contracts import FUNDING_BUCKETS

    assert [one(spark, v, lambda c: numbers.bucket_of(c, FUNDING_BUCKETS), "double") for v in (None, -1.0, 0.5, 1.0, 1e6, 1e6 + 1, 2e8)] == ["unknown", "unknown", "unknown", "<$1M", "<$1M", "$1-10M", "$100M+"]


def test_lenient_csv_and_strict_json(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('id,t\n1,"a, b"\n2,\n3,x,too,many\n4\n')
    assert sorted(map(tuple, files.csv_strings(spark, str(csv), ["id", "t"]).collect())) == [("1", "a, b"), ("2", ""), ("4", "")]
    good = tmp_path / "j.jsonl"
    good.write_text('{"a": 1}\n{"a": 2}\n{"a":')
    assert [r.a for r in files.json_strict(spark, str(good), "a int").orderBy("line_no").collect()] == [1, 2]
    assert [r.a for r in files.journal_lines(spark, str(good), "a int").orderBy("line_no").collect()] == [1, 2]
    bad = tmp_path / "k.jsonl"
    bad.write_text('{"a": 1}\nnope\n{"a": 2}\n')
    with pytest.raises(ValueError):
        files.json_strict(spark, str(bad), "a int")


def test_contract_and_digest(spark):
    df = spark.createDataFrame([(1, "b", None)], "k int, b string, a string")
    assert sinks.contract(df, ["a", "b", "c"]).collect() == [("", "b", "")]
    with pytest.raises(ValueError):
        sinks.contract(df, ["zz"], fill=False)
    rows = spark.range(100).select("id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    assert sinks.rows_digest(rows, "d", "id") == sinks.rows_digest(rows.repartition(7), "d", "id")


def test_stream_equals_replay(spark, tmp_path):
    events = [(1, 1, "pass_a", False), (1, 2, "error", True), (1, 3, "retry", False), (1, 4, "completed", False), (2, 5, "completed", False), (2, 6, "error", False), (3, 7, "error", True)]
    kinds = "company long, line_no long, kind string, retriable boolean"
    batch = {r.company: r for r in journal.replay(spark.createDataFrame(events, kinds)).collect()}
    assert batch[1].completed_line == 4 and batch[1].n_retries == 1 and batch[2].n_illegal == 1 and batch[3].error_retriable
    for i, part in enumerate((events[:3], events[3:])):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("company", "line_no", "kind", "retriable"), e))) for e in part))
        os.utime(tmp_path / f"{i}.json", (1000 + i, 1000 + i))  # the log's order
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    last = {}
    q = journal.replay_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "_cp")).foreachBatch(lambda df, _: last.update({r.company: r for r in df.collect()})).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in batch.items()}


def test_evidence_of_a_page(spark):
    """Furniture goes, repeats go, signal lines come first once the budget is short."""
    html = "<head><title>T</title></head><script>var x</script><nav>Home</nav><h1># We build AI agents</h1><p>Our office is in Oslo</p><div>our OFFICE is in Oslo!</div><p>a@b.org</p><p>Just words here</p><p>Our machine learning platform &amp; tools</p><p>Just words here</p>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>Home</p>")], "page_id long, html string")
    all_lines = ["# We build AI agents", "Our office is in Oslo", "Just words here", "Our machine learning platform & tools"]
    got = {r.page_id: r.lines for r in text.evidence_lines(pages, "html").select("page_id", "lines").collect()}
    assert got == {1: all_lines, 2: [], 3: []}
    # 21 and 38 characters for the signal lines, 22 for the first other, 16 for the second
    for budget, want in ((200, all_lines), (81, [all_lines[0], all_lines[3], all_lines[1]]), (80, [all_lines[0], all_lines[3]]), (40, [all_lines[0]]), (20, [])):
        lines = {r.page_id: r.lines for r in text.evidence_lines(pages, "html", budget).select("page_id", "lines").collect()}[1]
        assert lines == want, budget


def test_damaged_journal_fails_and_a_tail_heals(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"id":1}\n{"id":\n{"id":3}\n')
    with pytest.raises(Exception, match="damaged journal line 2"):
        files.journal_lines(spark, str(path), "id long").collect()
    path.write_text('{"id":1}\n\n{"id":2}\n{"id":3')
    assert [r.id for r in files.journal_lines(spark, str(path), "id long").collect()] == [1, 2]
    assert files.heal_journal(spark, str(path)) == 7 and path.read_text() == '{"id":1}\n\n{"id":2}\n'
    assert files.heal_journal(spark, str(path)) == 0


def test_contract_rows_are_numbered_by_record(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,note\n' + "".join(f'{i},"a{chr(10)}b"\n' for i in range(300)))
    rows = files.csv_contract(spark, str(path), ["id", "note"], "id").collect()
    assert [(int(r.id) + 2, r.note) for r in rows] == [(r.source_row_number, "a\nb") for r in rows]
    for bad, why in (("id\n1\n", "missing"), ("id,note,note\n1,2,3\n", "repeated"), ("id,note\n1,a\n1,b\n", "repeated id"), ("id,note\n ,a\n", "blank")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=why):
            files.csv_contract(spark, str(path), ["id", "note"], "id")


def test_archive_dates(spark):
    rows = spark.createDataFrame([("a", "20210203040506", 2), ("a", "20200101000000", 1), ("b", "", 1), ("b", "20200101000000", 2)], "id string, at string, line int")
    assert files.archive_dates(rows.filter("id = 'a'"), "id", "at", "line").collect()[0].snapshot_date == "2020-01-01"
    with pytest.raises(Exception, match="no snapshot time: b"):
        files.archive_dates(rows, "id", "at", "line").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\nbroken\n{"a":2}\n')
    assert sorted(r.a for r in files.json_lenient(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    for stem, a in (("one", 1), ("one_a", 2), ("two", 3)):
        (tmp_path / f"{stem}.json").write_text(json.dumps({"a": a}))
    assert {r.key: r.a for r in files.json_folder(spark, f"{tmp_path}/*.json", "a int").collect()} == {"one": 2, "two": 3}
    (tmp_path / "m.jsonl").write_text('{"record_type":"manifest","n":2}\n{"record_type":"row","a":1}\n{"record_type":"row","a":2}\n')
    head, rows = files.header_and_rows(spark, str(tmp_path / "m.jsonl"), "n int", "a int")
    assert head.first().n == 2 and [r.a for r in rows.orderBy("line_no").collect()] == [1, 2]
    assert files.digests(spark, str(tmp_path / "two.json")).first().sha256 == __import__("hashlib").sha256(b'{"a": 3}').hexdigest()
    typed = files.typed(spark.createDataFrame([("20200102030405", "1.5"), ("x", "y")], "t string, n string"), ["t"], ["n"]).collect()
    assert (str(typed[0].t), typed[0].n, typed[1].t, typed[1].n) == ("2020-01-02 03:04:05", 1.5, None, None)


def test_guards(spark, tmp_path):
    rows = spark.createDataFrame([(1, ""), (2, None)], "id int, label string")
    sinks.refuse_overwrite(rows, ["label"])
    with pytest.raises(ValueError, match="refusing"):
        sinks.refuse_overwrite(rows.withColumn("label", F.lit("x")), ["label"])
    first = sinks.write_addressed(rows, "abc", str(tmp_path))
    assert sinks.write_addressed(rows.limit(0), "abc", str(tmp_path)) == first and spark.read.parquet(first).count() == 2
    for n in (3, 1):
        sinks.replace_folder(spark.range(n), f"{tmp_path}/log")
        assert spark.read.json(f"{tmp_path}/log").count() == n
    assert not os.path.exists(tmp_path / "log.old") and not os.path.exists(tmp_path / "log.new")


def test_strict_schema():
    given = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}}}}}
    out = archive.strict_schema(given)
    assert out["additionalProperties"] is False and out["required"] == ["a"]
    assert out["properties"]["a"]["items"] == {"type": "object", "properties": {"b": {"type": "string"}}, "additionalProperties": False, "required": ["b"]}
    assert "required" not in given


@pytest.mark.parametrize(("z", "want"), [(0.0, 1.0), (1.0, 0.31731050786), (1.959963985, 0.05), (-2.575829304, 0.01), (5.0, 5.7330314e-07)])
def test_two_sided_p(spark, z, want):
    assert one(spark, z, stats.two_sided_p, "double") == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize(("x", "dof", "want"), [(3.841458821, 1, 0.05), (9.210340372, 2, 0.01), (0.0, 3, 1.0), (18.30703805, 10, 0.05), (2.0, 2, 0.36787944117)])
def test_chi_square_tail(spark, x, dof, want):
    row = spark.createDataFrame([(x, float(dof))], "x double, k double").select(stats.chi_square_tail("x", "k").alias("p")).first()
    assert row.p == pytest.approx(want, rel=1e-6)


def test_step_up(spark):
    """Benjamini-Hochberg: all ranks up to the last p under its line, even where an earlier one is over."""
    p = [0.001, 0.02, 0.021, 0.03, 0.9]
    got = {r.p: r for r in stats.step_up(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    flag = next(c for c in got[0.9].asDict() if isinstance(got[0.9][c], bool))
    assert [got[x][flag] for x in p] == [True, True, True, True, False]


def test_retry_requests_are_the_active_errors(spark):
    from attestry.operators import reports

    events = [(1, 1, "error", True), (2, 2, "error", False), (3, 3, "error", True), (3, 4, "retry", True), (4, 5, "pass_a", True), (4, 6, "error", True), (4, 7, "completed", True), (5, 8, "error", True), (5, 9, "pass_a", True), (6, 10, "pass_a", True), (6, 11, "error", True)]
    state = journal.replay(spark.createDataFrame(events, "company long, line_no long, kind string, retriable boolean"))
    assert sorted(tuple(r) for r in reports.retry_requests(state, "company", "error_line", "error_retriable").collect()) == [(1, 1), (6, 11)]
