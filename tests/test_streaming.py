"""The incremental ingest takes each file once and, over all micro-batches,
yields the same lines and rejects as the batch ingest of the same files."""

import os
import tempfile

from salescope.sources import csv_ingest as ci
from salescope.streaming.incremental_ingest import read_order_store, start_order_csv_stream, write_micro_batch

HEADER = "Row ID,Order ID,Order Date,Customer ID,Quantity,Discount,Sales,Profit"


def _write(d, name, rows):
    with open(os.path.join(d, name), "w", encoding="latin-1", newline="") as f:
        f.write(HEADER + "\n" + "\n".join(rows) + "\n")


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="salescope-stream-src-")
    work = tempfile.mkdtemp(prefix="salescope-stream-")
    out, rej, cp = (os.path.join(work, x) for x in ("lines", "rejects", "cp"))
    _write(src, "a.csv", ["1,O-1,1-1-2011,C-1,2,0.1,10.5,1", "2,O-2,5-6-2012,C-2,x,0,3,-1"])
    _write(src, "b.csv", ["3,O-3,7-7-2013,C-1,1,0.2,4,0.5", "4,O-4,bad,C-3,1,0,1"])
    header = HEADER.split(",")

    q = start_order_csv_stream(spark, src, out, rej, cp, header=header)
    q.awaitTermination(120)
    _write(src, "c.csv", ["5,O-5,1-1-2014,C-4,3,0,9,2"])
    q = start_order_csv_stream(spark, src, out, rej, cp, header=header)
    q.awaitTermination(120)

    res = ci.ingest_order_csv(spark, src, multi_line=False)
    lines, rejects = res.lines, res.rejects
    got = read_order_store(spark, out)
    assert _sorted(got.select(*lines.columns)) == _sorted(lines)
    assert got.count() == 4
    got_rej = spark.read.parquet(rej).drop("ingest_batch")
    cols = ["row_key", "column", "value", "severity", "reason"]
    assert _sorted(got_rej.select(*cols)) == _sorted(rejects.select(*cols))


def test_replayed_batch_replaces_its_output(spark):
    src = tempfile.mkdtemp(prefix="salescope-replay-src-")
    work = tempfile.mkdtemp(prefix="salescope-replay-")
    out, rej = os.path.join(work, "lines"), os.path.join(work, "rejects")
    _write(src, "a.csv", ["1,O-1,1-1-2011,C-1,2,0.1,10.5,1", "2,O-2,5-6-2012,C-2,x,0,3,-1"])
    typed = ci.type_order_lines(ci.read_order_csv(spark, src, multi_line=False))
    write_micro_batch(typed, 0, out, rej)
    write_micro_batch(typed, 1, out, rej)
    write_micro_batch(typed, 1, out, rej)  # replay of batch 1 after a failure
    got = spark.read.parquet(out)
    assert got.count() == 4
    assert sorted(r["ingest_batch"] for r in got.select("ingest_batch").distinct().collect()) == [0, 1]
    assert spark.read.parquet(rej).count() == 2
