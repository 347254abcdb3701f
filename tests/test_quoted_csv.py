"""Quoted CSV files read in byte ranges: equal to the one-task read wherever the ranges are cut."""

import csv
import os
import random

import pytest

from tixflow.sources import quoted
from tixflow.sources.files import read_csv


@pytest.fixture
def tiny_ranges(spark):
    """Ranges of 197 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "197")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _rows(df):
    return [tuple(r) for r in df.orderBy("ingest_ord").drop("ingest_ord").collect()]


def _write(path, rows, newline="\n", encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f, lineterminator=newline).writerows(rows)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_equals_the_one_task_read(spark, tmp_dir, newline, request):
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", 'say "hi"', "x,y", "line" + newline + "break", newline, "", "caf\u00e9", " pad ", '"', "z" * 30])
    field = lambda: " ".join(word() for _ in range(rng.randrange(0, 6)))
    rows = [[f"INC{i}", field(), field()] for i in range(120)]
    rows[60][1] = newline.join(f"part {i}, of a field over many ranges" for i in range(60))
    _write(os.path.join(tmp_dir, "a.csv"), [["number", "Title", "state"], *rows], newline)
    _write(os.path.join(tmp_dir, "b.csv"), [["state", "number"], *[[field(), f"CHG{i}"] for i in range(40)]], newline, "latin-1")
    open(os.path.join(tmp_dir, "empty.csv"), "w").close()
    one = read_csv(spark, tmp_dir, na_tokens=None)
    want, names = _rows(one), one.columns
    request.getfixturevalue("tiny_ranges")
    got = read_csv(spark, tmp_dir, na_tokens=None, splittable=True)
    assert got.columns == names and _rows(got) == want and len(want) == 160
    lines = quoted.file_lines(spark, [os.path.join(tmp_dir, "a.csv")])
    ranges = quoted.byte_ranges(lines)
    assert lines.rdd.getNumPartitions() > 10 and 5 < ranges.where("inside").count() < ranges.count()
    shuffled = quoted.records(lines, ranges, max_broadcast=0).orderBy("block", "pos").collect()
    assert [tuple(r) for r in shuffled] == [tuple(r) for r in quoted.records(lines, ranges).orderBy("block", "pos").collect()]
    text = open(os.path.join(tmp_dir, "a.csv"), newline="").read().removesuffix("\n").encode()
    assert b"\n".join(bytes(r[3]) for r in shuffled) == text  # nothing is lost or moved


def test_edges(spark, tmp_dir, tiny_ranges):
    p = os.path.join(tmp_dir, "x.csv")
    with open(p, "w", newline="") as f:
        f.write('\ufeffnumber,title\nINC1,a\n\nINC2,"",more\nINC3\nINC4,"never closed\nto the end\n')
    rows = [(r["number"], r["short_description"]) for r in read_csv(spark, p, splittable=True).orderBy("ingest_ord").collect()]
    assert rows[:3] == [(r["number"], r["short_description"]) for r in read_csv(spark, p).orderBy("ingest_ord").collect()][:3]
    assert len(rows) == 4 and rows[3][0] == "INC4" and "to the end" in rows[3][1]
    with open(p, "w") as f:
        f.write("number,title\n")
    assert read_csv(spark, p, splittable=True).collect() == []
    open(p, "w").close()
    assert read_csv(spark, p, splittable=True).collect() == []
