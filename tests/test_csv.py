"""CSV files with rows that do not fit."""

from rowkin.sources.csv_tables import read_checked_csv

COLUMNS = ("a", "b", "c")


def test_ragged_rows_go_to_quarantine(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,"two\nlines",3\n4,5\n6,,\n7,8,9,10\n"say ""hi""",x,y\n')
    (tmp_path / "y.csv").write_text('a,b,c\n11,12,13\n14,"never closed,15\n16,17,18\n')
    rows, odd = read_checked_csv(spark, str(tmp_path), COLUMNS)
    assert sorted(r.a for r in rows.collect()) == ["1", "11", "6", 'say "hi"']
    assert {(r.a, r.b, r.c) for r in rows.where("a in ('1', '6')").collect()} == {("1", "two\nlines", "3"), ("6", "", "")}
    assert rows.count() == 4 and odd.count() == 3 and rows.select("a").count() == 4
    found = {r.record.strip(): r.file.rsplit("/", 1)[1] for r in odd.collect()}
    assert found["4,5"] == found["7,8,9,10"] == "x.csv"
    assert [f for r, f in found.items() if r.startswith('14,"never')] == ["y.csv"]


def test_empty_files_and_no_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    (tmp_path / "y.csv").write_text("1,2,3\n4\n")
    rows, odd = read_checked_csv(spark, str(tmp_path), COLUMNS, stamp=False, header=False)
    assert [tuple(r) for r in rows.collect()] == [("1", "2", "3")] and [r.record.strip() for r in odd.collect()] == ["4"]
