import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.errors import LoadError, UnsupportedFileTypeError
from tallyframe.functions.local import local_table
from tallyframe.operators import audit, dedupe
from tallyframe.operators.rules import Rule
from tallyframe.plans.specs import Step
from tallyframe.plans.workflow import run_workflow_folder
from tallyframe.session import shared_folder
from tallyframe.sources import delimited, files, parquet, records, reports, snapshots, workbook
from tallyframe.sources.files import POSITION_COLUMNS
from tallyframe.sources.consolidation import consolidate_folder, file_summary
from tallyframe.streaming import folder as stream_folder


@pytest.fixture
def write(tmp_path):
    def build(name, text):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)

    return build


def typed(df):
    return [(n, t) for n, t in df.dtypes if not n.startswith("_")]


def test_types_and_missing_tokens(spark, write, rows):
    path = write(
        "a.csv",
        "n,x,flag,text,when,none,big\n"
        "1,1.5,True,abc,2024-01-01,,99999999999999999999\n"
        " 2 ,NA,false,N/A,2024-02-01,NULL,5\n"
        "nan,1e3,,None,,n/a,7\n",
    )
    df = delimited.read_delimited(spark, path)
    assert typed(df) == [
        ("n", "bigint"), ("x", "double"), ("flag", "boolean"), ("text", "string"),
        ("when", "string"), ("none", "double"), ("big", "string"),
    ]
    assert rows(df, "n", "x", "flag", "text") == [
        (None, 1000.0, None, None), (1, 1.5, True, "abc"), (2, None, False, None),
    ]


def test_tabs_blank_lines_quotes_and_line_breaks(spark, write, rows):
    path = write("a.tsv", 'id\tnote\n1\t"two\nlines"\n\n2\t"say ""hi"", ok"\n')
    df = delimited.read_delimited(spark, path)
    assert rows(df, "id", "note") == [(1, "two\nlines"), (2, 'say "hi", ok')]


def test_headers_are_tidied(spark, write):
    path = write("a.csv", "﻿id,,name,name,name\n1,2,a,b,c\n")
    assert [n for n, _ in typed(delimited.read_delimited(spark, path))] == [
        "id", "Unnamed: 1", "name", "name.1", "name.2",
    ]


def test_given_types_and_raw_text(spark, write):
    path = write("a.csv", "id,v\n1,x\n2,5\n")
    raw = delimited.read_delimited(spark, path, infer=False)
    assert typed(raw) == [("id", "string"), ("v", "string")]
    from pyspark.sql.types import LongType

    assert [r.v for r in delimited.read_delimited(spark, path, types={"v": LongType()}).collect()] == [None, 5]


def test_broken_lines_can_be_kept(spark, write):
    path = write("a.csv", "a,b\n1,2\n1,2,3\n4\n")
    df = delimited.read_delimited(spark, path, corrupt_column="_bad", infer=False)
    assert sorted(r._bad for r in df.where("_bad IS NOT NULL").collect()) == ["1,2,3", "4"]


def test_errors(spark, write, tmp_path):
    with pytest.raises(UnsupportedFileTypeError):
        delimited.read_delimited(spark, write("a.pdf", "x"))
    with pytest.raises(LoadError):
        delimited.read_delimited(spark, write("empty.csv", ""))
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, str(tmp_path / "none.csv"))


def test_row_numbers_follow_the_file(spark, write):
    path = write("a.csv", "id\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = files.number_rows(delimited.read_delimited(spark, path))
        assert df.where("id <> row_no").isEmpty() and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folder(spark, write, tmp_path, rows):
    write("a.csv", "id,v\n1,x\n2,y\n")
    write("b b.csv", "id,v\n3,z\n")
    write("c.csv", "other\n1\n")
    write("d.tsv", "id\tv\n4\tq\n")
    write("empty.csv", "")
    write("skip.txt", "nothing")
    (tmp_path / "sub").mkdir()
    write("sub/deep.csv", "id,v\n9,9\n")
    tables, log = delimited.read_folder(spark, str(tmp_path))
    assert sorted((header, df.count()) for header, df in tables) == [
        (("id", "v"), 4), (("other",), 1),
    ]
    assert tables[0][0] == ("id", "v")
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    assert rows(log, name, "status", "rows", "columns") == [
        ("a.csv", "ok", 2, 2), ("b%20b.csv", "ok", 1, 2), ("c.csv", "ok", 1, 1),
        ("d.tsv", "ok", 1, 2), ("empty.csv", "failed", None, None), ("skip.txt", "skipped", None, None),
    ]


def test_folder_consolidation_and_workflow(spark, write, tmp_path, rows):
    write("a.csv", "id,v\n1,x\n1,x\n2,y\n")
    write("b.csv", "id,v\n1,x\n")
    write("c.csv", "other\n1\n")
    write("empty.csv", "")
    stamped, log = consolidate_folder(spark, str(tmp_path), "now")
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    assert stamped.columns == ["id", "v", "__source_file__", "__source_sheet__", "__import_timestamp__"]
    assert stamped.count() == 4
    assert rows(log, name, "consolidated") == [
        ("a.csv", True), ("b.csv", True), ("c.csv", False), ("empty.csv", False),
    ]
    chain = [
        Step("remove_duplicates", {"columns": ["id"]}),
        Step("column_map", {"mappings": [{"source": "id", "destination": "ID"}], "keep_unmapped": True}),
    ]
    results, report = run_workflow_folder(spark, str(tmp_path), chain)
    file = F.regexp_extract("source", r"([^/]+)$", 1)
    assert rows(report.drop("detail").withColumn("source", file)) == [
        ("a.csv", 3, 2, "OK"), ("b.csv", 1, 1, "OK"), ("c.csv", 1, 1, "FAILED_STEP"), ("empty.csv", 0, 0, "ERROR"),
    ]
    details = {r[0]: r.detail for r in report.select(file, "detail").collect()}
    assert details["a.csv"] == "remove_duplicates: Removed 1 row(s); column_map: Result has 2 column(s)"
    assert results[0].columns == ["ID", "_source_file", "v"] and results[0].count() == 3


def test_file_summary(spark, write):
    path = write("a.csv", "id,v\n1,x\n1,x\n2,\n")
    found = {r.Property: r.Value for r in file_summary(spark, path, delimited.read_delimited(spark, path)).collect()}
    assert found.pop("Last Modified") != "-"
    assert found == {
        "File Name": "a.csv", "Active Sheet": "Sheet1", "Sheet Count": "1", "File Size": "16 B",
        "Row Count": "3", "Column Count": "2", "Duplicate Rows": "1", "Blank Cells": "1", "Fill Rate": "83.3",
    }


def test_parquet_positions_identify_rows_of_several_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100, numPartitions=1).write.parquet(path)
    spark.range(50, numPartitions=1).write.mode("append").parquet(path)
    df = parquet.read_parquet(spark, path, positions=True)
    assert df.columns == ["id", *POSITION_COLUMNS]
    assert df.where("_position <> id").isEmpty()
    assert df.select(*POSITION_COLUMNS).distinct().count() == 150
    flagged = dedupe.mark_duplicates(df, ["id"], POSITION_COLUMNS)
    assert flagged.where("is_duplicate").count() == 50


def test_wide_header_and_ragged_rows(spark, write, tmp_path, rows):
    names = [f"a_rather_long_column_name_{i:06d}" for i in range(40_000)]
    write("wide.csv", ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    assert len(",".join(names)) > 1 << 20
    found = delimited.file_headers(spark, str(tmp_path)).first()
    assert found.header == names and found.error is None
    (tmp_path / "wide.csv").unlink()
    write("long.csv", "a,b\n1,2\n3,4,5\n")
    write("short.csv", "a,b\n1,2\n3\n\n4\n")
    write("quoted.csv", 'a,b\n"x, y",2\n"say ""hi"", you",6" pipe\n')
    write("broken.csv", 'a,b\n"two\nlines",2\n')
    tables, log = delimited.read_folder(spark, str(tmp_path))
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    assert rows(log, name, "status", "rows", "short_rows", "error") == [
        ("broken.csv", "ok", 1, None, None),
        ("long.csv", "failed", None, None, "1 row(s) have more fields than the header"),
        ("quoted.csv", "ok", 2, 0, None),
        ("short.csv", "ok", 3, 2, None),
    ]
    assert rows(tables[0][1], "a", "b") == [
        ("1", "2"), ("3", None), ("4", None), ("say \"hi\", you", "6\" pipe"), ("two\nlines", "2"), ("x, y", "2"),
    ]
    with pytest.raises(LoadError, match="more fields"):
        delimited.read_delimited(spark, str(tmp_path / "long.csv"))
    write("broken_long.csv", 'a,b\n"two\nlines",2,3\n')
    with pytest.raises(LoadError, match="more fields"):
        delimited.read_delimited(spark, str(tmp_path / "broken_long.csv"))


def test_a_lone_quote_leaves_the_file_splittable(spark, write):
    found = delimited.scan_lines(spark, write("q.csv", 'a,b\n6" pipe,x\n"y",z"\n')).first()
    assert found.spans_lines is False and found.widths == {2: 3}


def test_several_files_need_one_header(spark, write, rows):
    same = [write("a.csv", "a,b\n1,x\n"), write("b.csv", "a,b\n2,y\n")]
    assert rows(delimited.read_delimited(spark, same), "a", "b") == [(1, "x"), (2, "y")]
    with pytest.raises(LoadError, match="different headers"):
        delimited.read_delimited(spark, [same[0], write("c.csv", "b,a\nx,1\n")])


def test_names_that_differ_in_case(spark, write):
    df = delimited.read_delimited(spark, write("case.csv", "ID,id,Id.1\n1,2,3\n"))
    assert df.columns[:3] == ["ID", "id.1", "Id.1.1"]
    assert tuple(df.first())[:3] == (1, 2, 3)


def test_files_are_typed_by_their_own_cells(spark, write, tmp_path, rows):
    write("a.csv", "k,amount\n1,9\n1,10\n")
    write("b.csv", "k,amount\n1,9\n1,ten\n1,10\n")
    steps = [
        Step("remove_duplicates", {"columns": ["k"], "keep": "highest", "rank_by": "amount"}),
        Step("validate", {"rules": [{"rule_type": "custom_expression", "parameter": "amount > 9.5"}]}),
    ]
    results, report = run_workflow_folder(spark, str(tmp_path), steps)
    file = F.regexp_extract("source", r"([^/]+)$", 1)
    assert rows(report.withColumn("source", file), "source", "rows_after", "status", "detail") == [
        ("a.csv", 1, "OK", "remove_duplicates: Removed 1 row(s); validate: 0 issue(s) found"),
        ("b.csv", 1, "OK", "remove_duplicates: Removed 2 row(s); validate: 1 issue(s) found"),
    ]
    assert rows(results[0], "amount") == [("10",), ("ten",)]


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path, sheets, shared=(), formats=("General", "yyyy-mm-dd")):
    """A workbook from ``{name: (state, rows xml)}``; cell style 1 is a date."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(
            f'<sheet name="{name}" sheetId="{i}" {state} r:id="rId{i}"/>'
            for i, (name, (state, _)) in enumerate(sheets.items(), 1)
        )
        z.writestr("xl/workbook.xml", f"<workbook {NS} {RS}><sheets>{listed}</sheets></workbook>")
        links = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        texts = "".join(f"<si><t>{t}</t></si>" for t in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{texts}</sst>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="{formats[1]}"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        )
        for i, (_, body) in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


BODY = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Day</t></is></c>'
    '<c r="D1" t="s"><v>2</v></c></row>'
    '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" t="b"><v>1</v></c></row>'
    '<row r="4"><c r="A4"><v>2</v></c><c r="B4" t="s"><v>3</v></c><c r="C4" s="1"><v>45292.5</v></c></row>'
)


def test_task_functions_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    for function in (delimited._parse_headers, records._mark, workbook._read_workbooks):
        (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(function))
        code = "import pickle, sys; f = pickle.load(open('f.pkl', 'rb')); list(f([]));" \
            "assert not any(m.startswith('tallyframe') for m in sys.modules)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_workbooks(spark, tmp_path, rows):
    make_workbook(
        tmp_path / "a.xlsx",
        {"Data": ("", BODY), "Secret": ('state="hidden"', BODY), "Blank": ("", "")},
        shared=["ID", "Score", "Flag", "N/A"],
    )
    make_workbook(tmp_path / "b.xlsm", {"Data": ("", '<row r="1"><c r="A1" t="str"><v>X</v></c></row>')})
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    (tmp_path / "locked.xlsx").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (tmp_path / "notes.txt").write_text("x")
    tables, log = workbook.read_workbooks(spark, str(tmp_path))
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    assert rows(log, name, "sheet", "status", "rows", "columns", "is_hidden", "is_empty") == [
        ("a.xlsx", "Blank", "ok", 0, 0, False, True),
        ("a.xlsx", "Data", "ok", 3, 4, False, False),
        ("a.xlsx", "Secret", "ok", 3, 4, True, False),
        ("b.xlsm", "Data", "ok", 0, 1, False, True),
        ("bad.xlsx", None, "failed", None, None, None, False),
        ("locked.xlsx", None, "failed", None, None, None, False),
    ]
    errors = {r[0]: r.error for r in log.where("error IS NOT NULL").select(name, "error").collect()}
    assert "password" in errors["locked.xlsx"]
    header, df = tables[0]
    assert header == ("ID", "Score", "Day", "Flag")
    assert typed(df)[:4] == [("ID", "bigint"), ("Score", "double"), ("Day", "timestamp_ntz"), ("Flag", "boolean")]
    assert rows(df.where("_source_sheet = 'Data'"), "ID", "Score", "Day", "Flag", "_position") == [
        (1, 2.5, datetime(2024, 1, 1), True, 0), (2, None, datetime(2024, 1, 1, 12), None, 2),
    ]


def test_columns_beyond_z_and_mixed_kinds(spark, tmp_path, rows):
    body = '<row r="1"><c r="A1" t="str"><v>a</v></c><c r="AB1" t="str"><v>b</v></c></row>' \
        '<row r="2"><c r="A2"><v>1</v></c></row><row r="3"><c r="A3" t="str"><v>x</v></c><c r="AB3"><v>7</v></c></row>'
    make_workbook(tmp_path / "w.xlsx", {"S": ("", body)})
    (header, df), = workbook.read_workbooks(spark, str(tmp_path))[0]
    assert len(header) == 28 and header[1] == "Unnamed: 1" and header[27] == "b"
    assert rows(df, "a", "b") == [("1", None), ("x", 7)]


def test_writing_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    reports.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        reports.write_table(spark.range(3), path)
    with pytest.raises(ValueError):
        reports.write_table(spark.range(3), path, "xlsx")


def test_report_folders(spark, frame, tmp_path, rows):
    a = frame("k long, v string", (1, "x"), (2, "y"), (2, "z"))
    b = frame("k long, v string", (1, "x2"), (3, "n"))
    pairs = reports.comparison_tables(a.drop("row_id"), b.drop("row_id"), ["k"], "a.csv", "b.csv")
    reports.write_comparison(pairs, str(tmp_path / "cmp"))
    new = spark.read.parquet(str(tmp_path / "cmp" / "differences")).where("status = 'new_in_second'")
    assert rows(new, "k", "v_second") == [(3, "n")]
    summary = {r.Metric: r.Value for r in spark.read.parquet(str(tmp_path / "cmp" / "summary")).collect()}
    assert summary["Master File"] == "a.csv" and summary["Missing In Second"] == "2"

    reports.write_tables(reports.duplicate_tables(a, ["k"], "row_id"), str(tmp_path / "dup"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "dup" / "duplicate_rows")).first().v == "z"

    tables = reports.validation_tables(a, [Rule("regex", "v", "[xy]")], "row_id")
    assert [tuple(r) for r in tables["issues"].collect()] == [
        (3, "v", "regex", "'v' value 'z' doesn't match pattern '[xy]'"),
    ]
    assert rows(tables["summary"]) == [("Issues Found", "1"), ("Rules Checked", "1"), ("Total Rows", "3")]


def test_audit_log(spark, tmp_path, rows):
    path = str(tmp_path / "audit")
    audit.append_entries(spark, path, [("a.csv", "Sheet1", "Removed duplicates")], datetime(2024, 1, 1, 8))
    audit.append_entries(
        spark, path, [("b.csv", "Sheet1", "Applied lookup"), ("b.csv", "Sheet1", "Saved")], datetime(2024, 1, 20)
    )
    log = spark.read.parquet(path)
    assert [r.id for r in audit.query_entries(log).collect()] == [3, 2, 1]
    assert [r.operation for r in audit.query_entries(log, "LOOKUP").collect()] == ["Applied lookup"]
    assert [r.id for r in audit.query_entries(log, limit=1).collect()] == [3]
    assert audit.count_entries(log).first().entries == 3
    kept, removed = audit.prune_entries(log, 10, datetime(2024, 1, 25))
    assert rows(kept, "id") == [(2,), (3,)] and removed.first().removed == 1
    assert audit.audit_export(log).columns == ["Timestamp", "File", "Sheet", "Operation"]
    assert audit.query_entries(log).first().timestamp == "2024-01-20T00:00:00"


def test_pruning_knows_no_time_zone(spark, rows):
    log = local_table(spark, [(1, "2024-01-14T23:59:59"), (2, "2024-01-15T00:00:00")], "id long, timestamp string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        kept, _ = audit.prune_entries(log, 10, datetime(2024, 1, 25))
        assert rows(kept, "id") == [(2,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_snapshots(spark, tmp_path, rows):
    path = str(tmp_path / "snap")
    assert snapshots.restore_tables(spark, path) == {}
    one = local_table(spark, [(1, "A"), (2, "B")], "ID long, Name string")
    two = local_table(spark, [(3, "C")], "ID long, Name string")
    snapshots.snapshot_tables([("a.csv", "Sheet1", "a", one)], path, datetime(2024, 1, 1))
    failing = one.withColumn("Name", F.raise_error(F.lit("broken")))
    snapshots.snapshot_tables(
        [("a.csv", "Sheet1", "a", two), ("b.csv", "Sheet1", "b", failing)], path, datetime(2024, 1, 2)
    )
    restored = snapshots.restore_tables(spark, path)
    assert set(restored) == {("a.csv", "Sheet1")}
    assert rows(restored["a.csv", "Sheet1"]) == [(3, "C")]
    assert restored["a.csv", "Sheet1"].schema == two.schema


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two
    if root:
        assert one.startswith(f"{root.rstrip('/')}/x-")


def test_folder_stream(spark, tmp_path, rows):
    from pyspark.sql.types import LongType, StringType

    source = tmp_path / "in"
    source.mkdir()
    types = {"id": LongType(), "v": StringType()}
    checks = [Rule("required", "id"), Rule("regex", "v", "[a-z]+$")]

    def run():
        good, bad = stream_folder.split_stream(
            stream_folder.read_folder_stream(spark, str(source), types), checks
        )
        for name, df in (("good", good), ("bad", bad)):
            stream_folder.write_stream(df, str(tmp_path / name), str(tmp_path / f"cp_{name}")).awaitTermination()

    (source / "1.csv").write_text("id,v\n1,a\nNA,b\n")
    run()
    (source / "2.csv").write_text("id,v\n2,c\n3,D\n")
    run()
    assert rows(spark.read.parquet(str(tmp_path / "good")), "id", "v") == [(1, "a"), (2, "c")]
    assert rows(spark.read.parquet(str(tmp_path / "bad")), "id", "v") == [(None, "b"), (3, "D")]
    with pytest.raises(ValueError):
        stream_folder.split_stream(spark.readStream.format("rate").load(), [Rule("unique", "value")])


def test_comparison_saved_in_one_pass(spark, tmp_path, rows):
    first = spark.range(40).selectExpr("id AS k", "id % 4 AS v")
    second = spark.range(10, 60).selectExpr("id AS k", "id % 4 + (id = 30)::int AS v")
    reports.save_comparison(first, second, ["k"], str(tmp_path / "report"))
    tables = reports.comparison_tables(first, second, ["k"])
    read = lambda name: spark.read.parquet(str(tmp_path / "report" / name))
    assert rows(read("summary")) == rows(tables["summary"])
    assert rows(read("differences").groupBy("status").count()) == [
        ("missing_in_second", 10), ("modified", 1), ("new_in_second", 20),
    ]


def test_a_header_that_spans_lines(spark, write, tmp_path):
    path = write("h.csv", 'a,"b\nc"\n1,2\n')
    df = delimited.read_delimited(spark, path)
    assert df.columns[:2] == ["a", "b\nc"] and tuple(df.first())[:2] == (1, 2)
    log = delimited.read_folder(spark, str(tmp_path))[1].first()
    assert (log.status, log.error) == ("failed", "The header record spans lines")


@pytest.fixture
def small_blocks(spark):
    """Files of a few kilobytes are read in many blocks."""
    settings = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


# No cell is lost: stray quotes, an empty surplus field, and files said to be of many lines.
@pytest.mark.parametrize(
    "text, multi_line",
    [
        ('a,b\n6" x,7" y,lost\n', None),
        ('a,b\n"x\ny",1,,3\n', None),
        ('a,b\n"x\ny",1,9\n', True),
        ("a,b\n1,2,\n", None),
        ('a,b\n1,2,""\n', True),
        ('a,b\n"x,y",1,3\n"p\nq",2\n', None),
        ('a,b\n"never closed,1\n2,3\n', None),
        ('a,b\n"x",1\n"y,1,2\n', False),
        ('a,b\n1,2,"y\n', False),
    ],
)
def test_no_cell_is_lost(spark, write, text, multi_line, request):
    path = write("lost.csv", text)
    if multi_line is False and text.endswith('"y,1,2\n'):
        df = delimited.read_delimited(spark, path, multi_line=False)
        assert sorted(map(tuple, df.select("a", "b").collect()), key=str) == [("x", 1), ("y,1,2", None)]
        return
    with pytest.raises(LoadError, match="more fields|never closed"):
        delimited.read_delimited(spark, path, multi_line=multi_line)
    tables, log = delimited.read_folder(spark, path.rsplit("/", 1)[0], multi_line=multi_line)
    entry = log.first()
    if multi_line is None:
        assert entry.status == "failed" and ("more fields" in entry.error or "never closed" in entry.error)
        assert all(df.isEmpty() for _, df in tables)


def test_a_faulty_file_stops_no_other(spark, write, tmp_path, rows):
    write("good.csv", 'a,b\n"two\nlines",2\n')
    write("long.csv", 'a,b\n"two\nlines",2,3\n"x",1\n')
    write("open.csv", 'a,b\n1,2\n"two\nlines,2\n')
    tables, log = delimited.read_folder(spark, str(tmp_path))
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    assert rows(log, name, "status", "rows", "error") == [
        ("good.csv", "ok", 1, None),
        ("long.csv", "failed", None, "1 row(s) have more fields than the header"),
        ("open.csv", "failed", None, "A quoted field is never closed"),
    ]
    assert [r for _, df in tables for r in rows(df, "a", "b")] == [("two\nlines", 2)]


def cells(draw):
    pieces = ["a", "b c", '"', ",", "\n", "\n\n", "", "é\U0001f600", "\t", '""', "6\" pipe", "  "]
    return "".join(draw.choice(pieces) for _ in range(draw.choice([0, 1, 2, 3, 8, 60])))


@pytest.mark.parametrize("seed", range(3))
def test_records_are_regrouped_over_blocks(spark, tmp_path, small_blocks, seed):
    import csv
    import random

    draw, expected = random.Random(seed), []
    for name in ("one.csv", "two.csv"):
        table = [(f"{name}{i}", *(cells(draw) for _ in range(2))) for i in range(30)]
        with open(tmp_path / name, "w", newline="") as file:
            writer = csv.writer(file, lineterminator=draw.choice(["\n", "\r\n"]))
            writer.writerows([("id", "x", "y"), *table])
        expected += table
    paths = [str(tmp_path / n) for n in ("one.csv", "two.csv")]
    df = delimited.read_delimited(spark, paths, infer=False)
    assert spark.read.text(paths).rdd.getNumPartitions() > 4
    missing = delimited.NA_TOKENS
    assert sorted(map(tuple, df.select("id", "x", "y").fillna("").collect())) == sorted(
        (i, "" if x in missing else x, "" if y in missing else y) for i, x, y in expected
    )
    # Places give the rows of a file in their order.
    ordered = [r.id for r in df.orderBy(*POSITION_COLUMNS).collect()]
    assert ordered == [i for i, _, _ in expected]
    numbered = files.number_rows(df).select("id", "row_no").collect()
    assert {r.id: r.row_no for r in numbered} == {i: n % 30 for n, (i, _, _) in enumerate(expected)}


def test_a_header_and_blank_lines_over_blocks(spark, write, small_blocks, rows):
    header = "long\nheader " * 60
    path = write("h.csv", f'\n  \n"{header}",b\n\n1,"x\n\n\ny"\n' + "\n" * 500 + '2,"z\n"\n')
    df = delimited.read_delimited(spark, path)
    assert df.columns[:2] == [header, "b"]
    assert rows(files.number_rows(df), header, "b", "row_no") == [(1, "x\n\n\ny", 0), (2, "z\n", 1)]


def test_one_long_record_spans_many_blocks(spark, write, small_blocks, rows):
    long = "\n".join(f'line {i}, with a ""quote""' for i in range(60))
    path = write("long.csv", f'a,b\n1,x\n2,"{long}"\n3,"y"\n\n4,"p\nq"\n')
    df = delimited.read_delimited(spark, path)
    assert rows(df, "a", "b") == [(1, "x"), (2, long.replace('""', '"')), (3, "y"), (4, "p\nq")]


def test_broken_records_can_be_kept(spark, write, rows):
    path = write("kept.csv", 'a,b\n"x\ny",1\n"p\nq",2,3\nz\n')
    df = delimited.read_delimited(spark, path, corrupt_column="broken")
    assert rows(df, "a", "b", "broken") == [("p\nq", 2, '"p\nq",2,3'), ("x\ny", 1, None), ("z", None, "z")]


def test_a_log_of_many_entries(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    assert audit.read_log(spark, path).isEmpty()
    entries = spark.range(1000).selectExpr("concat('f', id) AS file_key", "'Sheet1' AS sheet_name", "'x' AS operation", "-id AS place")
    assert audit.append_log(spark, path, entries, datetime(2024, 1, 1, 8), ["place"]) == 1000
    assert audit.append_log(spark, path, entries.limit(0), datetime(2024, 1, 1, 9), ["place"]) == 0
    assert audit.append_log(spark, path, entries.where("place = -7"), datetime(2024, 1, 2, 9), ["place"]) == 1
    # A batch that the manifest does not list was broken off.
    audit.read_log(spark, path).limit(3).withColumn("day", F.lit("2024-01-03")).write.partitionBy("day").parquet(f"{path}/data/batch=broken")
    log = audit.read_log(spark, path)
    assert [r.file_key for r in log.orderBy("id").collect()] == [f"f{i}" for i in range(999, -1, -1)] + ["f7"]
    assert [r.id for r in log.orderBy("id").collect()] == list(range(1, 1002))
    assert rows(log.where("id > 999"), "id", "timestamp") == [(1000, "2024-01-01T08:00:00"), (1001, "2024-01-02T09:00:00")]
