"""Hand-made order-line frames (<= 20 rows each) for edge cases."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from salescope.schema import ORDER_LINE_SCHEMA

FIELDS = [f.name for f in ORDER_LINE_SCHEMA.fields]


def line(**kw):
    base = dict(
        Row_ID=1,
        Order_ID="O-1",
        Order_Date=dt.date(2012, 1, 10),
        Ship_Date=dt.date(2012, 1, 12),
        Ship_Mode="Standard Class",
        Customer_ID="C-1",
        Customer_Name="Ann",
        Segment="Consumer",
        Country="France",
        Market="EU",
        Region="North",
        Product_ID="P-1",
        Category="Chairs",
        Sub_Category="Office",
        Quantity=1,
        Discount=D("0.0000"),
        Sales=D("100.0000"),
        Profit=D("10.0000"),
    )
    base.update(kw)
    for k in ("Discount", "Sales", "Profit"):
        if base[k] is not None and not isinstance(base[k], D):
            base[k] = D(str(base[k]))
    return tuple(base[f] for f in FIELDS)


def _d(s):
    return dt.date.fromisoformat(s)


FIXTURES = {
    "one_row": [line()],
    "empty": [],
    "zero_sales_group": [
        line(Row_ID=1, Category="Free", Sales=0, Profit=0),
        line(Row_ID=2, Category="Free", Sales=0, Profit=-5),
        line(Row_ID=3, Category="Paid", Sales=50, Profit=5),
        line(Row_ID=4, Category="Paid", Sales=150, Profit=-5),
    ],
    "discount_edges": [
        line(Row_ID=i, Discount=d, Profit=p)
        for i, (d, p) in enumerate(
            [("0", 5), ("0.2", 3), ("0.21", -1), ("0.4", -2), ("0.41", -3), ("1.0", -9), (None, 1), ("-0.1", 2)]
        )
    ],
    "ship_edges": [
        line(
            Row_ID=i,
            Order_ID=f"O-{i}",
            Ship_Mode=m,
            Ship_Date=None if lag is None else _d("2012-01-10") + dt.timedelta(days=lag),
        )
        for i, (lag, m) in enumerate(
            [(0, "Same Day"), (3, "First Class"), (4, "Same Day"), (6, "First Class"), (7, "Second Class"), (-1, "Standard Class"), (None, "Standard Class")]
        )
    ],
    "split_order": [
        line(Row_ID=1, Order_ID="O-9", Ship_Mode="Same Day", Order_Date=_d("2012-01-31"), Ship_Date=_d("2012-01-31")),
        line(Row_ID=2, Order_ID="O-9", Ship_Mode="First Class", Order_Date=_d("2012-02-01"), Ship_Date=_d("2012-02-03")),
        line(Row_ID=3, Order_ID="O-8", Ship_Mode="First Class"),
        line(Row_ID=4, Order_ID="O-7", Ship_Mode="Standard Class"),
    ],
    "shared_region_name": [
        line(Row_ID=1, Order_ID="O-1", Market="EU", Region="North", Ship_Mode="First Class", Sales=300),
        line(Row_ID=2, Order_ID="O-2", Market="EU", Region="North", Ship_Mode="First Class", Sales=200),
        line(Row_ID=3, Order_ID="O-3", Market="LATAM", Region="North", Ship_Mode="Same Day", Sales=250),
        line(Row_ID=4, Order_ID="O-4", Market="LATAM", Region="North", Ship_Mode="Same Day", Sales=100),
        line(Row_ID=5, Order_ID="O-5", Market="LATAM", Region="North", Ship_Mode="Same Day", Sales=90),
        line(Row_ID=6, Order_ID="O-6", Market="EU", Region="South", Ship_Mode="Standard Class", Sales=10),
    ],
    "mode_tie": [
        line(Row_ID=1, Order_ID="O-1", Ship_Mode="Standard Class"),
        line(Row_ID=2, Order_ID="O-2", Ship_Mode="First Class"),
        line(Row_ID=3, Order_ID="O-3", Ship_Mode="Standard Class"),
        line(Row_ID=4, Order_ID="O-4", Ship_Mode="First Class"),
    ],
    "missing_month": [
        line(Row_ID=i, Order_ID=f"O-{i}", Order_Date=dt.date(2011 + (m - 1) // 12, (m - 1) % 12 + 1, 5), Sales=100 + i)
        for i, m in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14])
    ],
    "tile_ties": [
        line(Row_ID=i, Order_ID=f"O-{i}", Customer_ID=f"C-{i % 5}", Customer_Name=f"N{i % 5}", Sales=50)
        for i in range(10)
    ],
    "two_names": [
        line(Row_ID=1, Order_ID="O-1", Customer_ID="C-7", Customer_Name="Bo"),
        line(Row_ID=2, Order_ID="O-2", Customer_ID="C-7", Customer_Name="Bob"),
        line(Row_ID=3, Order_ID="O-3", Customer_ID="C-8", Customer_Name="Cy", Order_Date=_d("2013-03-03")),
    ],
    "rounding": [
        line(Row_ID=i, Order_ID=f"O-{i}", Category=f"K{i}", Sales=s, Profit=p)
        for i, (s, p) in enumerate(
            [("1.005", "0.285"), ("0.285", "2.675"), ("2.675", "-2.5"), ("-2.5", "18.4"), ("18.4", "1.005")]
        )
    ],
    "null_keys": [
        line(Row_ID=1, Customer_ID=None, Customer_Name=None, Order_ID="O-1"),
        line(Row_ID=2, Customer_ID="C-1", Order_Date=None, Order_ID="O-2"),
        line(Row_ID=3, Customer_ID="C-1", Order_ID="O-3", Order_Date=_d("2013-05-05")),
        line(Row_ID=4, Customer_ID="C-2", Order_ID="O-4", Region=None, Sales=None),
    ],
}


def frame(spark, name):
    return spark.createDataFrame(FIXTURES[name], ORDER_LINE_SCHEMA)


def to_duck(con, name):
    import pyarrow as pa

    cols = {f: [r[i] for r in FIXTURES[name]] for i, f in enumerate(FIELDS)}
    arrow_types = {
        "Row_ID": pa.int64(),
        "Order_Date": pa.date32(),
        "Ship_Date": pa.date32(),
        "Quantity": pa.int32(),
        "Discount": pa.decimal128(6, 4),
        "Sales": pa.decimal128(18, 4),
        "Profit": pa.decimal128(18, 4),
    }
    table = pa.table({f: pa.array(cols[f], type=arrow_types.get(f, pa.string())) for f in FIELDS})
    con.register("fixture_lines", table)
