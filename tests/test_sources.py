import pytest
from pyspark.sql import functions as F

from rowsmith.errors import SourceRejected
from rowsmith.functions.text import clean_header, is_number, to_number
from rowsmith.operators import profile
from rowsmith.sources import csv, sinks


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_numbers_spelled_like_python_floats(spark):
    cases = ["1", "-1.5", "1e5", "1_000", ".5", "5.", "inf", "-Infinity", "nan", "+3", "1E-3", " 7 ",
             "", " ", "1f", "1d", "0x10", "1__0", "_1", "1_", "e5", ".", "1e", "abc", "1,000", "--1", "infinit"]

    def parses(text):
        try:
            float(text)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", is_number(F.col("t")).alias("n"),
                                                                           to_number(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r["n"] == parses(r["t"]), r["t"]
        if r["n"] and r["t"].strip().lower() not in ("nan",):
            assert r["v"] == float(r["t"])


def test_csv_with_quotes_crlf_and_short_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id, name ,val\r\n1,"x, y",2.5\r\n2,z\r\n3,NA,null\r\n')
    df = csv.read_csv(spark, path)
    assert df.columns[:3] == ["id", "name", "val"]
    assert [f.dataType.simpleString() for f in df.schema.fields[:3]] == ["bigint", "string", "double"]
    rows = [tuple(r)[:3] for r in df.orderBy(csv.ROW_ORDER).collect()]
    assert rows == [(1, "x, y", 2.5), (2, "z", None), (3, None, None)]


def test_types_of_mixed_and_empty_columns(spark, tmp_path):
    path = write(tmp_path / "m.csv", "a,b,c,d,e\n1,Unit Down,True,,1.5\n2,3.5,false,,nan\n")
    kinds = {f.name: f.dataType.simpleString() for f in csv.infer_types(csv.read_raw(spark, path)).fields}
    assert kinds == {"a": "bigint", "b": "string", "c": "boolean", "d": "double", "e": "double"}


def test_duplicate_headers_and_other_suffixes_are_rejected(spark, tmp_path):
    with pytest.raises(SourceRejected):
        csv.read_csv(spark, write(tmp_path / "d.csv", "a,a\n1,2\n"))
    with pytest.raises(SourceRejected):
        csv.read_csv(spark, write(tmp_path / "d.txt", "a,b\n1,2\n"))


def test_only_csv_files_of_a_folder_are_read(spark, tmp_path):
    write(tmp_path / "a.csv", "k,v\n1,2\n")
    write(tmp_path / "b.CSV", "k,v\n3,4\n")
    write(tmp_path / "c.txt", "k,v\n5,6\n")
    assert sorted(r["k"] for r in csv.read_csv(spark, str(tmp_path)).collect()) == [1, 3]


def test_files_with_another_header_fail_the_read(spark, tmp_path):
    write(tmp_path / "a.csv", "k,v\n1,2\n")
    write(tmp_path / "b.csv", "v,k\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv.read_csv(spark, str(tmp_path)).collect()


def test_unnamed_column(spark, tmp_path):
    path = write(tmp_path / "u.csv", ",a.b:c\n0,x\n1,y\n")
    df = csv.read_csv(spark, path)
    assert df.columns[:2] == ["Unnamed: 0", "a.b:c"] and df.count() == 2


def test_rows_keep_file_order(spark, tmp_path):
    path = write(tmp_path / "o.csv", "k\n" + "\n".join(str(i * 7919 % 1000) for i in range(1000)) + "\n")
    rows = csv.read_csv(spark, path).orderBy(csv.ROW_ORDER).collect()
    assert [r["k"] for r in rows] == [i * 7919 % 1000 for i in range(1000)]


def test_header_cleaning():
    assert clean_header("  a b \r\n") == "a b"
    assert clean_header("x\r\ny") == "xy"


def test_strict_and_lenient_types_differ_on_blanks(spark):
    df = spark.createDataFrame([("1", "", "x"), (" ", "", "2")], "a string, b string, c string")
    strict = {r["column"]: r["data_type"] for r in profile.profile_columns(df, strict=True).collect()}
    lenient = {r["column"]: r["data_type"] for r in profile.profile_columns(df).collect()}
    assert strict == {"a": "Categorical", "b": "Categorical", "c": "Categorical"}
    assert lenient == {"a": "Numeric", "b": "Unknown", "c": "Categorical"}
    assert profile.infer_task(df, "a") == "Regression"
    assert profile.infer_task(df, "a", strict=True) == "Classification"
    assert profile.infer_task(df, "c", target_type="Numeric") == "Regression"


def test_profile_is_one_scan(spark, orders):
    plan = profile.profile_columns(orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, None), (None, "b")], "`2E1540_4:215FT001.PNT` double, `Length (Years)` string")
    rows = {r["column"]: (r["row_count"], r["missing_records"]) for r in profile.analyse_columns(df).collect()}
    assert rows == {"2E1540_4:215FT001.PNT": (2, 1), "Length (Years)": (2, 1)}


def test_records_keep_missing_fields(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.as_records(df).first()["record"] == '{"a":1,"b":null}'


def test_csv_with_doubled_quotes_line_breaks_and_long_ids(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b,id\n"he said ""x"", ok",1,9223372036854775806\n"two\nlines",2,9223372036854775807\n')
    df = csv.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields[:3]] == ["string", "bigint", "bigint"]
    assert [tuple(r)[:3] for r in df.orderBy("b").collect()] == [('he said "x", ok', 1, 9223372036854775806), ("two\nlines", 2, 9223372036854775807)]
    too_long = csv.read_csv(spark, write(tmp_path / "l.csv", "id\n9223372036854775808\n1\n"))
    assert too_long.schema["id"].dataType.simpleString() == "double"


@pytest.mark.parametrize("multiline", [True, False])
def test_rows_wider_than_the_header_fail_the_read(spark, tmp_path, multiline):
    for i, bad in enumerate(("1,2,3", "1,2,,,5")):
        path = write(tmp_path / f"w{i}.csv", f"a,b\n{bad}\n4\n")
        with pytest.raises(Exception, match="more cells"):
            csv.read_raw(spark, path, multiline).collect()
    assert csv.read_raw(spark, write(tmp_path / "s.csv", "a,b\n1\n2,3\n"), multiline).count() == 2


def test_typed_text_keeps_its_blanks(spark, tmp_path):
    path = write(tmp_path / "b.csv", "a,b\n x ,1\n")
    assert csv.read_csv(spark, path).first()["a"] == " x " and csv.read_raw(spark, path).first()["a"] == "x"


def test_downloads_double_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1)], "t string, n int")
    sinks.download_csv(df, str(tmp_path / "d.csv"))
    text = "".join(p.read_text() for p in (tmp_path / "d.csv").glob("part-*"))
    assert '"a ""b"", c",1' in text


@pytest.mark.parametrize("multiline", [True, False])
@pytest.mark.parametrize("blanks", [1, 31, 32, 40, 200])
@pytest.mark.parametrize("after", ["", "lost", '"a,b"'])
def test_cells_too_many_are_refused_however_many_are_blank(spark, tmp_path, multiline, blanks, after):
    path = write(tmp_path / "w.csv", "k,v\n1,2\n3,4" + "," * blanks + after + "\n5\n")
    with pytest.raises(Exception, match="more cells"):
        csv.read_csv(spark, path, multiline=multiline).collect()


@pytest.mark.parametrize("multiline", [True, False])
def test_short_rows_and_odd_ends_of_rows_are_read(spark, tmp_path, multiline):
    path = write(tmp_path / "s.csv", 'k,v,w\r\n1\r\n2,"x, ""y"""\r\n3,,\r\n4,"a,b"\r\n5,z')
    rows = csv.read_raw(spark, path, multiline=multiline).orderBy(csv.ROW_ORDER).collect()
    assert [tuple(r)[:3] for r in rows] == [("1", None, None), ("2", 'x, "y"', None), ("3", None, None), ("4", "a,b", None), ("5", "z", None)]
