"""Files as users send them."""

import random

import pytest

from gleanset.functions.validation import parsed_date
from gleanset.operators import dedup
from gleanset.operators.mapping import add_column
from gleanset.sources import readers
from gleanset.sources.delimited import ends_inside


def test_quoted_cells_keep_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nAnn,"line1\nline2, ""quoted"""\nBob,x\n')
    rows = readers.read_csv(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {("Ann", 'line1\nline2, "quoted"'), ("Bob", "x")}


@pytest.fixture
def ranges_of(spark):
    """Cut files into byte ranges of about this size."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield cut
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def as_text(rows, sep, end="\n", always=False):
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if always or any(x in c for x in (sep, '"', "\n", "\r")) else c
    return end.join(sep.join(quoted(c) for c in row) for row in rows) + end


def awkward_rows(n, seed):
    pick = random.Random(seed)
    cells = ["plain", "a,b", "a;b", 'say "hi"', "two\nlines", '\n"\n', "x\r\ny", '5" disk', "'", ",", ";;", "tab\there", 'end"\n', "é|ß", "long\n" * 30]
    return [[str(i), *[pick.choice(cells) for _ in range(3)]] for i in range(n)]


@pytest.mark.parametrize("size", [1 << 20, 700, 64])
def test_each_file_has_its_dialect_in_any_number_of_ranges(spark, tmp_path, ranges_of, size):
    """Two delimiters, quoted line breaks, an extra column, line ends of both kinds, a mark at the start and empty files."""
    head = ["id", "b", "c", "d"]
    parts = [("a [b]+%20{c}.csv", ",", "\n", 1), ("b.csv", ";", "\r\n", 2), ("c.csv", "\t", "\n", 3), ("d.csv", "|", "\n", 4)]
    expected = []
    for name, sep, end, seed in parts:
        rows = awkward_rows(60 if size == 64 else 150, seed)
        (tmp_path / name).write_bytes(("\ufeff" + as_text([head, *rows], sep, end, always=seed == 4)).encode())
        expected += [(*row, None) for row in rows]
    (tmp_path / "plain.csv").write_text("id,e,d\n7,new,last\n\n  \n8,\n")
    expected += [("7", None, None, "last", "new"), ("8", None, None, None, None)]
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "header.csv").write_text("id;b;c;d\n")
    ranges_of(size)
    frame = readers.read_csv(spark, str(tmp_path))
    assert frame.columns == ["id", "b", "c", "d", "e"]
    assert frame.rdd.getNumPartitions() > (40 if size == 64 else 0)
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_cells_over_many_ranges_and_without_end(spark, tmp_path, ranges_of, size):
    giant = "\n".join(f"line {i}, of many" for i in range(200))
    (tmp_path / "a.csv").write_text(as_text([["name\nof a", "b"], ["1", giant], [giant, "2"], ["3", "4"]], ","))
    (tmp_path / "b.csv").write_text('x,y\n1,2\n3,"never closed\n5,6\n')
    ranges_of(size)
    rows = [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/a.csv").collect()]
    assert sorted(rows) == sorted([("1", giant), (giant, "2"), ("3", "4")])
    rows = [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/b.csv").collect()]
    assert sorted(rows) == [("1", "2"), ("3", "never closed\n5,6")]


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,A,,"b, ""c""",d`e\n1,2,3,4,5,6\n1\n')
    frame = readers.read_csv(spark, str(tmp_path))
    assert frame.columns == ["a0", "A1", "_c2", 'b, "c"', "d`e"]
    assert [tuple(r) for r in frame.collect()] == [("1", "2", "3", "4", "5"), ("1", None, None, None, None)]
    assert readers.read_csv(spark, str(tmp_path), ";").columns == ['a,A,,"b, ""c""",d`e']


def test_files_without_line_breaks_go_to_the_plain_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\n1;"x;y"\n')
    plan = readers.read_csv(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    assert readers.read_csv(spark, str(tmp_path)).collect()[0]["b"] == "x;y"


def test_a_folder_without_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path)).columns == []
    assert readers.read_sheets(spark, str(tmp_path), "csv").count() == 0


@pytest.mark.parametrize("line, inside, expected", [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('a,"b', True, False), ('a"b', False, False), ('"a""', False, True),
    ('"a"",b', False, True), ('x",y', True, False), ('x",";"', True, False), ('x"",y', True, True), ('a;"b', False, False), ('', True, True), ('"', False, True), ('"', True, False),
    ('a,"b","c', False, True), (' "a', False, False),
])
def test_state_of_a_line(line, inside, expected):
    assert ends_inside(line, inside, ",") == expected


def test_sheets_are_files_or_folders(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "First Sheet.csv").write_text('a,b\n1,"line1\nline2"\n')
    (tmp_path / "files" / "second.csv").write_text("a;c\n2;3\n")
    (tmp_path / "files" / "none.csv").write_text("a,b\n")
    rows = readers.read_sheets(spark, str(tmp_path / "files"), "csv", "my/book").collect()
    assert {(r["sheet"], r["sheet_label"], r["a"], r["b"], r["c"]) for r in rows} == {
        ("First Sheet", "my_book_First Sheet", "1", "line1\nline2", None), ("second", "my_book_second", "2", None, "3")}
    for form in ("csv", "parquet"):
        frame = spark.createDataFrame([("1", "x/y+z"), ("2", "plain")], "a string, sheet string")
        frame.write.partitionBy("sheet").option("header", True).format(form).save(str(tmp_path / form))
        rows = readers.read_sheets(spark, str(tmp_path / form), form).collect()
        assert {(r["a"], r["sheet"]) for r in rows} == {("1", "x/y+z"), ("2", "plain")}


@pytest.mark.parametrize("text", [
    '[\n  {"a": 1, "b": "x"},\n  {"a": 2}\n]', '{"records": [\n{"a": 1, "b": "x"},\n{"a": 2}]}', '{"a": 1, "b": "x"}\n{"a": 2}\n',
    '[{"a": 1, "b": "x"}, {"a": 2}]', '{"records": [{"a": 1, "b": "x"}]}\n{"a": 2}',
])
def test_json_forms(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    rows = readers.read_json_records(spark, str(tmp_path), "a bigint, b string").collect()
    assert {tuple(r) for r in rows} == {(1, "x"), (2, None)}


def test_json_lines_are_read_in_ranges(spark, tmp_path, ranges_of):
    """Files of lines, of arrays and of records side by side; lines are split, values of another type are NULL."""
    (tmp_path / "lines [1].json").write_text("\r\n".join(f'{{"a": {i}, "b": "x}}{{"}}' for i in range(300)) + '\n\n{"a": "no number", "b": "y"}\n')
    (tmp_path / "array.json").write_text('[{"a": 900},\n{"a": 901}]')
    (tmp_path / "records.json").write_text('{"records": [{"a": 902}]}\n{"records": [{"a": 903}, {"a": 904}]}')
    (tmp_path / "blank.json").write_text("\n \n")
    ranges_of(500)
    forms = readers.json_forms(spark, str(tmp_path))
    assert len(forms[True]) == 2 and len(forms[False]) == 1
    frame = readers.read_json_records(spark, str(tmp_path), "a bigint, b string")
    assert frame.rdd.getNumPartitions() > 10
    rows = [tuple(r) for r in frame.collect()]
    assert sorted(rows, key=str) == sorted([(i, "x}{") for i in range(300)] + [(None, "y")] + [(i, None) for i in range(900, 905)], key=str)
    (tmp_path / "later.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="no JSON in later.json"):
        readers.read_json_records(spark, str(tmp_path), "a bigint, b string").collect()


def test_one_pretty_object_and_broken_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "a": 1,\n  "b": "x"\n}')
    assert [tuple(r) for r in readers.read_json_records(spark, str(tmp_path), "a bigint, b string").collect()] == [(1, "x")]
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": ')
    with pytest.raises(Exception, match="no JSON in b.json"):
        readers.read_json_records(spark, str(tmp_path), "a bigint, b string").collect()


def test_dates(column):
    good = [
        "2024-01-31", "2024/01/31", "31.01.2024", "January 5, 2024", "31 January 2024", "20240131", "2024-01-31T10:00:00Z", "2024-01-31 10:00:00.123",
        "2024-01-31T10:00:00.5+02:00", "31/1/2024", "5 Jan 2024",
    ]
    bad = ["2024-13-01", "soon", "31.13.2024", "20241301", "2024-01-31T25:00:00Z", ""]
    assert column(good + bad, lambda x: parsed_date(x).isNotNull()) == [True] * len(good) + [False] * len(bad)


def test_added_columns_keep_their_symbols(spark):
    assert len(add_column(spark.range(1), "Share (%)").columns[1]) > len("share")


def test_large_blocks_are_compared(spark):
    rows = spark.range(10_050).selectExpr("id as rid", "'p' as phone", "'Ann Smith' as name", "1 as score")
    assert dedup.fuzzy_duplicates(rows, ["phone"], ["name"], "score", "rid").count() == 10_049
    assert dedup.fuzzy_duplicates(rows, ["phone"], ["name"], "score", "rid", block_rows=20_000).count() == 10_049
    assert dedup.fuzzy_duplicates(rows, ["phone"], ["name"], "score", "rid", block_rows=20).count() == 0


def scans(frame):
    """Scans of the executed plan, reused ones not counted."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Scan parquet")


@pytest.mark.parametrize("name, most", [("j2_managers", 3), ("j4b_visible_logs", 8), ("t11_resolved_headers", 8), ("j13_request_listing", 6)])
def test_lookups_do_not_repeat_their_rows(spark, name, most):
    from gleanset.catalog import load

    assert scans(load()[0][name](spark, "/root/testdata/sf0.001")) <= most
