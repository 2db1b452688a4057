"""CSV ingest cases (Latin-1, quoting, embedded newlines, white space,
bad values, short and long rows, header sanitising)."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from salescope.sources import csv_ingest as ci

HEADER = "Row ID,Order ID,Order Date,Ship Date,Customer Name,Sub-Category,Quantity,Discount,Sales,Profit,a/b"


def write_csv(body: str) -> str:
    d = tempfile.mkdtemp(prefix="salescope-csv-")
    p = os.path.join(d, "orders.csv")
    with open(p, "w", encoding="latin-1", newline="") as f:
        f.write(body)
    return p


ROWS = "\n".join(
    [
        HEADER,
        '1,A-1,1-1-2011,02-03-2012,"Chairs, ""big""",Chairs,2,0.202,5.5,1,x',
        '2,A-2,31-12-2014,31-12-2014,"two\nlines",Tables,3,0,1e3,-2,y\\',
        "",
        "3,A-3,31-02-2011,2011/01/01, José  ,Art,5.5,nan,zz,1.23456,",
        "4,A-4,bad,1-1-2011,Ann,Art,1_000,inf, 5.5 ,0,z",
        "5,A-5,1-1-2011",
        "6,A-6,1-1-2011,1-1-2011,Bo,Art,1,0.1,2,1,q,EXTRA",
    ]
) + "\n"


@pytest.fixture(scope="module")
def ingested(spark):
    path = write_csv(ROWS)
    res = ci.ingest_order_csv(spark, path, multi_line=True)
    lines, rejects = res.lines, res.rejects
    return (
        {r["Row_ID"]: r for r in lines.collect()},
        [tuple(r) for r in rejects.select("row_key", "column", "value", "severity", "reason").collect()],
        lines,
    )


def test_names_are_sanitised(ingested):
    _, _, lines = ingested
    assert lines.columns == [
        "Row_ID", "Order_ID", "Order_Date", "Ship_Date", "Customer_Name", "Sub_Category",
        "Quantity", "Discount", "Sales", "Profit", "a_b",
    ]


def test_quotes_newlines_and_whitespace(ingested):
    rows, _, _ = ingested
    assert rows[1]["Customer_Name"] == 'Chairs, "big"'
    assert rows[2]["Customer_Name"] == "two\nlines"
    assert rows[2]["a_b"] == "y\\"
    assert rows[3]["Customer_Name"] == "José"
    assert rows[3]["a_b"] is None


def test_dates(ingested):
    rows, _, _ = ingested
    assert rows[1]["Order_Date"] == dt.date(2011, 1, 1)
    assert rows[1]["Ship_Date"] == dt.date(2012, 3, 2)
    assert rows[2]["Order_Date"] == dt.date(2014, 12, 31)
    assert rows[3]["Order_Date"] is None and rows[3]["Ship_Date"] is None
    assert rows[4]["Order_Date"] is None


def test_numbers(ingested):
    rows, _, _ = ingested
    assert rows[1]["Discount"] == Decimal("0.2020")
    assert rows[1]["Sales"] == Decimal("5.5000")
    assert rows[2]["Sales"] == Decimal("1000.0000")
    assert rows[4]["Sales"] == Decimal("5.5000")
    assert rows[3]["Profit"] == Decimal("1.2346")
    assert rows[3]["Quantity"] is None and rows[4]["Quantity"] is None
    assert rows[3]["Discount"] is None and rows[4]["Discount"] is None
    assert rows[3]["Sales"] is None


def test_short_rows_rejected_long_rows_kept(ingested):
    rows, rejects, _ = ingested
    assert 5 not in rows and 6 in rows
    reasons = {(k, r) for k, _, _, _, r in rejects}
    assert ("5", "too few fields") in reasons
    assert ("6", "too many fields") in reasons


def test_reject_rows(ingested):
    _, rejects, _ = ingested
    errors = {(k, c, v) for k, c, v, s, _ in rejects if s == "error" and c}
    assert {("3", "Order_Date", "31-02-2011"), ("3", "Ship_Date", "2011/01/01"), ("3", "Quantity", "5.5"),
            ("3", "Discount", "nan"), ("3", "Sales", "zz"), ("4", "Order_Date", "bad"),
            ("4", "Quantity", "1_000"), ("4", "Discount", "inf")} <= errors
    warnings = {(k, c) for k, c, _, s, _ in rejects if s == "warning" and c}
    assert ("3", "Profit") in warnings
    assert ("1", "Discount") not in warnings


def test_header_collision():
    with pytest.raises(ValueError):
        ci.sanitized_names(["a b", "a-b"])
    assert ci.sanitized_names([" Order ID ", "a/b"]) == ["Order_ID", "a_b"]


def test_sanitize_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Sub-Category` int, ` Order ID ` int")
    assert ci.sanitize_columns(df).columns == ["Sub_Category", "Order_ID"]


def test_write_report_and_sample(spark, scratch_dir):
    path = write_csv(ROWS)
    out = os.path.join(scratch_dir, "lines")
    rej = os.path.join(scratch_dir, "rejects")
    res = ci.ingest_order_csv(spark, path, out_path=out, reject_path=rej)
    assert res.lines.count() == 5
    assert res.rejects.count() >= 10
    assert sorted(os.listdir(out))[:2] == ["_SUCCESS", "order_year=2011"] or "order_year=2011" in os.listdir(out)
    report = ci.load_report(res.lines).collect()
    assert report[0]["column"] == "Row_ID" and report[0]["table_rows"] == 5
    assert ci.sample_rows(res.lines, 3).count() == 3


def test_short_rows_flagged_in_line_mode_whatever_is_selected(spark):
    path = write_csv(HEADER + "\n1,A-1,1-1-2011,1-1-2011,Bo,Art,1,0,2,1,q\n5,A-5,1-1-2011\n")
    res = ci.ingest_order_csv(spark, path, multi_line=False)
    assert [r["Row_ID"] for r in res.lines.select("Row_ID").collect()] == [1]
    assert [r["reason"] for r in res.rejects.select("reason").collect()] == ["too few fields"]


def write_folder(**files: str) -> str:
    d = tempfile.mkdtemp(prefix="salescope-csv-")
    for name, body in files.items():
        with open(os.path.join(d, name + ".csv"), "w", encoding="latin-1", newline="") as f:
            f.write(body)
    return d


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("other", ["Row ID,Profit,Sales\n2,1,9\n", "Row ID,Sales\n2,1\n", "Row ID,Sales,Profit,x\n2,1,9,3\n"])
def test_files_with_differing_headers_are_refused(spark, multi_line, other):
    path = write_folder(a="Row ID,Sales,Profit\n1,9,1\n", b=other)
    with pytest.raises(Exception, match="(?i)header"):
        ci.ingest_order_csv(spark, path, multi_line=multi_line).lines.select("Sales").collect()


def test_files_with_one_header_are_read_together(spark):
    path = write_folder(a="Row ID,Sales,Profit\n1,9,1\n", b="Row ID,Sales,Profit\n2,8,2\n")
    lines = ci.ingest_order_csv(spark, path).lines
    assert sorted((r["Row_ID"], int(r["Sales"])) for r in lines.collect()) == [(1, 9), (2, 8)]


@pytest.mark.parametrize("header", ["Row ID,Sales,Sales", "Row ID,a b,a-b", "Row ID,,x"])
def test_bad_raw_headers_are_refused(spark, header):
    with pytest.raises(ValueError):
        ci.read_order_csv(spark, write_csv(header + "\n1,2,3\n"))


@pytest.mark.parametrize("multi_line", [True, False])
def test_long_quoted_field_in_an_over_long_row(spark, multi_line):
    long = '"' + "ab,\"\"" * 200_000 + '"'
    path = write_csv(f"Row ID,Sales,Segment\n1,2,{long},EXTRA\n2,3,x\n")
    res = ci.ingest_order_csv(spark, path, multi_line=multi_line)
    assert {r["Row_ID"]: len(r["Segment"]) for r in res.lines.collect()} == {1: 800_000, 2: 1}
    assert [r["reason"] for r in res.rejects.collect()] == ["too many fields"]


def test_every_rounding_is_noted(spark):
    texts = ["1.00000000000004", "1." + "0" * 40 + "1", "12345e-6", "1000e-5", "1.23400000", "0.0000000", "1e3", "1.23456e1", "1.2345E+1"]
    path = write_csv("Row ID,Sales\n" + "".join(f"{i},{t}\n" for i, t in enumerate(texts)))
    rejects = ci.ingest_order_csv(spark, path).rejects.collect()
    assert {r["value"] for r in rejects} == {texts[0], texts[1], texts[2]}
    assert {r["reason"] for r in rejects} == {"rounded to 4 decimals"}


def test_rejects_hold_the_record(spark):
    path = write_csv('Row ID,Sales,Segment,Market\nxx,1," a, ""b""",\n2,3\n')
    rejects = ci.ingest_order_csv(spark, path).rejects
    assert {(r["row_key"], r["reason"], r["record"].strip()) for r in rejects.collect()} == {
        (None, "not a valid bigint", 'xx,1," a, ""b""",'),
        ("2", "too few fields", "2,3"),
    }


def test_edges_are_stripped_of_all_white_space(spark):
    df = spark.createDataFrame([("\u2003\u00a0 a \x1f b\u3000\x85",), ("\t\x1c",), (None,)], "s string")
    assert [r[0] for r in df.select(ci.clean_text(df["s"])).collect()] == ["a \x1f b", None, None]


def test_store_keeps_every_column(spark, scratch_dir):
    from salescope.sources.store import read_order_store

    path = write_csv("Row ID,Order ID,Order Date,Shipping Cost,Note\n1,A,1-1-2011,2.5,n\n2,B,1-2-2012,3,\n3,C,bad,1,m\n")
    out = os.path.join(scratch_dir, "wide-store")
    ci.ingest_order_csv(spark, path, out_path=out)
    got = read_order_store(spark, out)
    assert set(got.columns) == {"Row_ID", "Order_ID", "Order_Date", "Shipping_Cost", "Note"}
    assert sorted((r["Row_ID"], r["Shipping_Cost"], r["Note"]) for r in got.collect())[0] == (1, Decimal("2.5000"), "n")
    assert dict(read_order_store(spark, out, keep_year=True).dtypes)["order_year"] == "int"


def test_store_has_few_files(spark, scratch_dir):
    lines = spark.range(0, 4000, 1, 16).selectExpr(
        "id AS Row_ID", "cast(id AS string) AS Order_ID", "date_add(date'2011-01-01', cast(id % 1400 AS int)) AS Order_Date"
    )
    out = os.path.join(scratch_dir, "clustered")
    ci.write_order_lines(lines, out)
    files = [f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 8
    assert spark.read.parquet(out).count() == 4000
