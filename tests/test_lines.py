"""Readers by blocks: many tasks for one file, exact numbers, and files that must fail."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from attestry.sources import files, lines


@pytest.fixture
def small_blocks(spark):
    for name, value in (("maxPartitionBytes", "300"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield spark
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def cells(seed, odd):
    r = random.Random(seed)
    kinds = ["a", "", "b,c", "x" * 40, "é日"] + ['q"q', "two\nlines", "\n\n", "end\r\nof"] * odd
    return [[str(i), r.choice(kinds), r.choice(kinds)] for i in range(120)]


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_contract_rows_of_one_file_in_many_tasks(small_blocks, tmp_path, odd, end):
    rows = cells(2, odd)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", 'na"me,x', "note"])
    for i, row in enumerate(rows):
        writer.writerow(row)
        if i % 9 == 0:
            out.write(end)  # blank lines are no records
    path = tmp_path / "a.csv"
    path.write_bytes(("\ufeff" + out.getvalue()).encode())
    assert lines._raw(small_blocks, str(path)).rdd.getNumPartitions() > 5
    got = files.csv_contract(small_blocks, str(path), ["note", "id", 'na"me,x'], "id").orderBy("source_row_number").collect()
    assert [[r.id, r['na"me,x'], r.note] for r in got] == rows
    assert [r.source_row_number for r in got] == list(range(2, 122))


def test_missing_cells_and_open_quotes_fail(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,note\n1,a\n\n2,,extra\n3\n")
    assert [tuple(r) for r in files.csv_contract(spark, str(path), ["id"], "id").orderBy("id").collect()] == [("1", 2), ("2", 3), ("3", 4)]
    with pytest.raises(Exception, match="row 4 has no value for 'note'"):
        files.csv_contract(spark, str(path), ["id", "note"], "id").collect()
    path.write_text('id,note\n1,a\n2,"b\n')
    with pytest.raises(Exception, match="row 3: the file ends inside quotes"):
        files.csv_contract(spark, str(path), ["id", "note"], "id").collect()
    before = files.file_stamps(spark, str(path))
    files.require_unchanged(spark, str(path), before)
    path.write_text("id,note\n1,a\n")
    with pytest.raises(ValueError, match="changed"):
        files.require_unchanged(spark, str(path), before)


def test_line_numbers_of_several_files(small_blocks, tmp_path):
    r = random.Random(3)
    texts = {f"{i}.txt": [("w" * r.randint(0, 30)) for _ in range(60)] for i in range(3)}
    for i, (name, rows) in enumerate(texts.items()):
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if i else ""))
    got: dict = {}
    for row in lines.physical_lines(small_blocks, f"{tmp_path}/*.txt").orderBy("line_no").collect():
        got.setdefault(row.file.rsplit("/", 1)[1], []).append((row.line_no, row.value, row.is_last, row.is_closed))
    for i, (name, rows) in enumerate(texts.items()):
        # an empty last line without its line feed is no line
        rows = rows[:-1] if not i and rows[-1] == "" else rows
        assert got[name] == [(n, v, n == len(rows) - 1, n < len(rows) - 1 or bool(i)) for n, v in enumerate(rows)]


def test_journal_of_many_blocks(small_blocks, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("".join(f'{{"id": {i}, "t": "{"x" * (i % 50)}"}}\n' for i in range(200)) + '{"id": 200}')
    got = files.journal_lines(small_blocks, str(path), "id int, t string").orderBy("line_no").collect()
    assert [(r.line_no, r.id) for r in got] == [(i, i) for i in range(200)]
    assert files.heal_journal(small_blocks, str(path)) == len('{"id": 200}') and path.read_text().endswith("}\n")
    path.write_text('{"id": 1}\n{"id": "x"}\n{"id": null}\n')
    with pytest.raises(Exception, match="damaged journal line 2: id has another type"):
        files.journal_lines(small_blocks, str(path), "id int").collect()
    with pytest.raises(ValueError, match="line 2: id has another type"):
        files.json_strict(small_blocks, str(path), "id int")
    path.write_text('{"id": 1}\n{"id": null}\n[1]')
    assert [r.id for r in files.json_strict(small_blocks, str(path), "id int").orderBy("line_no").collect()] == [1, None]
    path.write_text("")
    assert lines.physical_lines(small_blocks, str(path)).count() == 0 and files.heal_journal(small_blocks, str(path)) == 0


def test_numbers_of_filtered_rows(small_blocks, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n\n" for i in range(300)))
    got = lines.quoted_records(small_blocks, f"{tmp_path}/a.txt").filter(F.col("record_no") != F.col("value").cast("long")).count()
    assert got == 0


@pytest.mark.parametrize("batch", [10_000, 3])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_blocks_and_batches(small_blocks, tmp_path, end, batch):
    """Records within a block, over the border of two and over many, one that begins or ends where a block does, and an open one."""
    r = random.Random(5)
    kinds = ["a", "", 'q"q', "two\nlines", "\n\n", "end\r\nof", "é日", "x" * 200, "\n".join("y" * 30 for _ in range(30)), '"\n' * 30]
    want = {}
    for name in ("a.csv", "c.csv"):
        rows = [[str(i), r.choice(kinds), r.choice(kinds)] for i in range(30)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        for i, row in enumerate(rows):
            writer.writerow(row)
            out.write(end * (i % 7 == 0))
        (tmp_path / name).write_bytes(out.getvalue().encode() + (b'30,"open\n\n1' if name == "c.csv" else b""))
        want[name] = [*rows, ["30", "open\n\n1"]] if name == "c.csv" else rows
    small_blocks.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    got: dict = {}
    try:
        for row in lines.quoted_records(small_blocks, f"{tmp_path}/*.csv").orderBy("record_no").collect():
            got.setdefault(row.file.rsplit("/", 1)[1], []).append(row)
    finally:
        small_blocks.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, rows in want.items():
        assert [x.record_no for x in got[name]] == list(range(len(rows)))
        assert [next(csv.reader(io.StringIO(x.value, newline=""))) for x in got[name]] == rows
        assert [x.is_whole for x in got[name]] == [True] * 30 + [False] * (len(rows) - 30)


def test_texts_of_records_are_not_shuffled(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f'{i},"two\nlines"\n' for i in range(60)))
    records = lines.quoted_records(small_blocks, f"{tmp_path}/a.csv")
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert records.count() == 60 and "hashpartitioning" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
