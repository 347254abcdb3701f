"""Keep-latest upsert of the page stream."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.operators.normalize import dedupe_keep_last, normalize
from tixflow.sources.files import read_json
from tixflow.streaming import upsert as U

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ["number", "short_description", "state", "priority", "category"]])
COLS = ["number", "short_description", "state", "priority", "category", "category_source"]
AS_OF = "2024-01-01 00:00:00"


def page(folder, name, at, records):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(json.dumps({"result": [dict(zip(SCHEMA.names, r, strict=True)) for r in records]}))
    os.utime(path, (at, at))


def tickets(version, numbers):
    return [(f"INC{n}", f"vpn router down {version}" if n % 2 else f"tea {version}", "2", "3", "Network" if n % 3 == 0 else "") for n in numbers]


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(COLS).collect())


def run(spark, src, tmp, **kw):
    q = U.start_upsert_stream(spark, src, SCHEMA, f"{tmp}/table", f"{tmp}/ckpt", AS_OF, buckets=8, available_now=True, files_per_batch=1, **kw)
    q.awaitTermination(200)
    if q.exception():
        raise q.exception()


def test_stream_equals_batch_after_late_and_repeated_pages_and_a_restart(spark, tmp_path):
    src, tmp = str(tmp_path / "landing"), str(tmp_path)
    os.makedirs(src)
    page(src, "a.json", 1_700_000_000, tickets("v1", range(20)))
    page(src, "b.json", 1_700_000_300, tickets("v3", range(10, 15)))
    run(spark, src, tmp)
    page(src, "late.json", 1_700_000_100, tickets("v2", range(12, 25)))     # older than b, lands after it
    page(src, "again.json", 1_700_000_000, tickets("v1", range(20)))        # the first page once more
    page(src, "empty.json", 1_700_000_400, [])
    page(src, "none.json", 1_700_000_500, [(None, "no number", "2", "3", "")] * 2)
    with pytest.raises(Exception, match="cut off"):                          # dies after writing, before the commit
        run(spark, src, tmp, merge=cut_off)
    run(spark, src, tmp)
    batch = U.with_rule_category(normalize(read_json(spark, src, schema=T.StructType([T.StructField("result", T.ArrayType(SCHEMA))])), AS_OF))
    got = U.read_current(spark, f"{tmp}/table")
    assert rows(got) == rows(batch)
    found = {r["number"]: r for r in got.collect()}
    assert found["INC13"]["short_description"].endswith("v3") and found["INC16"]["short_description"].endswith("v2")
    assert found["INC1"]["category_source"] == "rule" and found["INC3"]["category_source"] == "original" and found["INC2"]["category_source"] == "pending"
    assert U.vacuum(spark, f"{tmp}/table") > 0 and rows(U.read_current(spark, f"{tmp}/table")) == rows(batch)


def cut_off(df, batch_id, table, buckets, updated=None):
    U.upsert(df, batch_id, table, buckets, updated=updated)
    done = os.path.join(table, f"buckets={buckets}", f"batch={batch_id}", "_SUCCESS")
    if os.path.exists(done):
        os.remove(done)
        raise RuntimeError("cut off")
    return []


def test_only_touched_buckets_are_rewritten_and_batches_are_idempotent(spark, tmp_path):
    table = str(tmp_path / "t")
    first = spark.createDataFrame([(f"INC{i}", "a", i) for i in range(200)], "number string, state string, ingest_ord long")
    assert U.upsert(first, 0, table, 16) == list(range(16))
    one = spark.createDataFrame([("INC7", "b", 1000), ("INC7", "old", 900)], "number string, state string, ingest_ord long")
    touched = U.upsert(one, 1, table, 16)
    assert len(touched) == 1 and sorted(x for x in os.listdir(f"{table}/buckets=16/batch=1") if x.startswith("bucket")) == [f"bucket={touched[0]}"]
    assert U.upsert(one.withColumn("state", F.lit("changed")), 1, table, 16) == []   # committed before
    stale = spark.createDataFrame([("INC7", "stale", 5)], "number string, state string, ingest_ord long")
    U.upsert(stale, 2, table, 16)
    got = {r["number"]: r["state"] for r in U.read_current(spark, table).collect()}
    assert len(got) == 200 and got["INC7"] == "b" and got["INC8"] == "a"
    assert U.upsert(one.limit(0), 3, table, 16) == []
    with pytest.raises(ValueError, match="buckets"):
        U.upsert(one, 4, table, 8)
    with pytest.raises(FileNotFoundError):
        U.read_current(spark, str(tmp_path / "nothing"))


def test_update_time_order(spark, tmp_path):
    data = [("A", "new", "2024-02-01", 1), ("A", "old", "2024-01-01", 2), ("B", "none", None, 9), ("B", "some", "2023-01-01", 1), ("C", "x", "2024-01-01", 1), ("C", "y", "2024-01-01", 2)]
    df = spark.createDataFrame(data, "number string, state string, at string, ingest_ord long")
    want = {"A": "new", "B": "some", "C": "y"}
    assert {r["number"]: r["state"] for r in dedupe_keep_last(df, updated="at").collect()} == want
    for i, row in enumerate(data):
        U.upsert(spark.createDataFrame([row], df.schema), i, str(tmp_path / "t"), 4, updated="at")
    assert {r["number"]: r["state"] for r in U.read_current(spark, str(tmp_path / "t")).collect()} == want
