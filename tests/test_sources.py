"""File sources, sinks and the streaming page ingest."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.operators.normalize import normalize
from tixflow.sources.filters import trailing_window
from tixflow.sources.files import read_csv, read_json, write_csv, write_report_json
from tixflow.streaming.pages import current_tickets, start_page_stream


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_csv_mixed_headers_aliases_latin1(spark, tmp_dir):
    d = os.path.join(tmp_dir, "csv")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), 'Number,Short Description,Severity\nINC1,"printer, ""offline""\nnow",1\nINC2,x,N/A\n')
    _write(os.path.join(d, "b.csv"), "incident_number,title,state\nINC3,café down,wip\nINC1,later copy,closed\n",
           encoding="latin-1")
    _write(os.path.join(d, "notes.txt"), "ignored")
    raw = read_csv(spark, d)
    t = {r["number"]: r for r in normalize(raw).collect()}
    assert set(t) == {"INC1", "INC2", "INC3"}
    assert t["INC1"]["short_description"] == "later copy"          # last file wins
    assert t["INC3"]["short_description"] == "café down"       # latin-1 fallback
    assert t["INC2"]["priority"] == "Unknown"                       # N/A -> NULL -> Unknown
    assert t["INC3"]["state"] == "In Progress"


def test_csv_glob_and_missing(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "x1.csv"), "number\nA\n")
    assert read_csv(spark, os.path.join(tmp_dir, "x*.csv")).count() == 1
    try:
        read_csv(spark, os.path.join(tmp_dir, "nothing*.csv"))
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_json_forms_and_flatten(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "list.json")
    _write(p1, json.dumps([{"number": "INC1", "caller_id": {"name": "ann"}, "priority": "2"}]))
    r1 = read_json(spark, p1)
    assert "caller_id.name" in r1.columns
    p2 = os.path.join(tmp_dir, "pages")
    os.makedirs(p2)
    _write(os.path.join(p2, "p0.json"), json.dumps({"result": [{"number": "INC1", "state": "1"},
                                                             {"number": "INC2", "state": "2"}]}))
    _write(os.path.join(p2, "p1.json"), json.dumps({"result": [{"number": "INC1", "state": "5"}]}))
    t = {r["number"]: r["state"] for r in normalize(read_json(spark, p2)).collect()}
    assert t == {"INC1": "Closed", "INC2": "In Progress"}


def test_sinks(spark, tmp_dir):
    df = normalize(spark.createDataFrame([("INC1", "t")], "number string, title string"))
    write_csv(df, os.path.join(tmp_dir, "out_csv"))
    back = read_csv(spark, os.path.join(tmp_dir, "out_csv"))
    assert back.collect()[0]["number"] == "INC1"
    write_report_json(df.limit(1), os.path.join(tmp_dir, "out_json"))
    assert any(f.endswith(".json") for f in os.listdir(os.path.join(tmp_dir, "out_json")))


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "landing")
    os.makedirs(src)
    for i in range(3):
        recs = [{"number": f"INC{j}", "short_description": f"s{j}", "state": "2", "priority": "3"}
                for j in range(i * 5, i * 5 + 5)]
        _write(os.path.join(src, f"page{i}.json"), json.dumps({"result": recs}))
    _write(os.path.join(src, "page3.json"), json.dumps({"result": []}))   # empty last page
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["number", "short_description", "state", "priority"]])
    q = start_page_stream(spark, src, schema, os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "ckpt"),
                          as_of="2024-01-01 00:00:00", available_now=True)
    q.awaitTermination(120)
    streamed = current_tickets(spark, os.path.join(tmp_dir, "log"))
    batch = normalize(read_json(spark, src), "2024-01-01 00:00:00")
    cols = ["number", "short_description", "state", "priority"]
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())


def test_file_names_with_special_characters(spark, tmp_dir):
    d = os.path.join(tmp_dir, "odd")
    os.makedirs(d)
    _write(os.path.join(d, "a+b c%20.csv"), "number,title\nINC1,x\nINC2,y\n")
    _write(os.path.join(d, "c.csv"), "number,title\nINC1,z\n")
    t = {r["number"]: r["short_description"] for r in normalize(read_csv(spark, d)).collect()}
    assert t == {"INC1": "z", "INC2": "y"}


def test_repeated_and_case_variant_headers(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "r.csv"), "Number,number,title,title,Priority,priority\nINC1,other,first,second,1,4\n")
    r = normalize(read_csv(spark, os.path.join(tmp_dir, "r.csv"))).collect()
    assert [(x["number"], x["short_description"], x["priority"]) for x in r] == [("INC1", "first", "P1")]
    clash = spark.createDataFrame([("INC1", "1", "4")], "number string, Priority string, x string").toDF("number", "Priority", "priority")
    assert normalize(clash).first()["priority"] == "P1"


def test_split_files_and_empty_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "split")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), "number,title\n" + "".join(f"INC{i % 50},v{i}\n" for i in range(500)))
    _write(os.path.join(d, "b.csv"), "")
    t = {r["number"]: r["short_description"] for r in normalize(read_csv(spark, d, multi_line=False)).collect()}
    assert t == {f"INC{i % 50}": f"v{i}" for i in range(450, 500)}


def test_corrupt_json_raises(spark, tmp_dir):
    d = os.path.join(tmp_dir, "bad")
    os.makedirs(d)
    _write(os.path.join(d, "p0.json"), json.dumps({"result": [{"number": "INC1"}]}))
    _write(os.path.join(d, "p1.json"), '{"result": [{"number": "INC2"}, {"numb')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        read_json(spark, d).collect()


def test_pages_without_records(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "p.json"), json.dumps({"result": []}))
    t = normalize(read_json(spark, os.path.join(tmp_dir, "p.json")))
    assert t.count() == 0 and "full_text" in t.columns


def test_stream_keeps_the_last_version_of_a_ticket(spark, tmp_dir):
    src = os.path.join(tmp_dir, "versions")
    os.makedirs(src)
    for i in range(1, 7):
        p = os.path.join(src, f"page{i}.json")
        _write(p, json.dumps({"result": [{"number": "INC1", "state": str(i)}]}))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["number", "state"]])
    start_page_stream(spark, src, schema, os.path.join(tmp_dir, "vlog"), os.path.join(tmp_dir, "vckpt"),
                      available_now=True).awaitTermination(120)
    streamed = current_tickets(spark, os.path.join(tmp_dir, "vlog")).collect()
    batch = normalize(read_json(spark, src)).collect()
    assert [r["state"] for r in streamed] == [r["state"] for r in batch] == ["Cancelled"]


def test_trailing_window_parses_text_and_aliases(spark):
    raw = spark.createDataFrame([("INC1", "05/01/2024 10:00", "a"), ("INC2", "2024-01-04 10:00:00", "b"), ("INC3", "2023-01-04", "a"), ("INC4", "junk", "a")],
                                "number string, Created string, urgency string")
    assert {r["number"] for r in trailing_window(raw, 7, "2024-01-08 00:00:00").collect()} == {"INC1", "INC2"}
    assert {r["number"] for r in trailing_window(raw, 3650, "2024-06-01 00:00:00", [F.col("urgency") != "b"]).collect()} == {"INC1", "INC3"}
