"""Normalisation edge cases (MINI rows)."""

import pytest
from pyspark.sql import functions as F

from tixflow.operators.normalize import normalize


def _rows(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_priority_state_record_type(spark):
    raw = _rows(spark, [
        ("INC1", "SEV1", "awaiting-info", "a", None),
        ("CHG2", " 2 - high ", "", "b", ""),
        ("PRB3", "9", None, "c", "  "),
        ("XYZ4", None, "o'neil 3rd", "d", "Problem"),
        ("INC5", "Critical", " WIP ", "e", None),
    ], "number string, severity string, Status string, title string, sys_class_name string")
    out = {r["number"]: r for r in normalize(raw, "2024-01-01 00:00:00").collect()}
    assert out["INC1"]["priority"] == "P1"
    assert out["CHG2"]["priority"] == "P2"
    assert out["PRB3"]["priority"] == "Unknown"
    assert out["XYZ4"]["priority"] == "Unknown"
    assert out["INC5"]["priority"] == "P1"
    assert out["INC1"]["state"] == "Awaiting-Info"      # Python title(), not initcap
    assert out["CHG2"]["state"] == "Unknown"
    assert out["PRB3"]["state"] == "Unknown"
    assert out["XYZ4"]["state"] == "O'Neil 3Rd"
    assert out["INC5"]["state"] == "In Progress"
    assert out["CHG2"]["record_type"] == "Change"
    assert out["PRB3"]["record_type"] == "Problem"
    assert out["XYZ4"]["record_type"] == "Problem"
    assert out["INC1"]["short_description"] == "a"
    assert out["INC1"]["assigned_to"] == "Unassigned"   # absent column -> default


def test_timestamps_mttr_age_dedupe(spark):
    raw = _rows(spark, [
        ("INC1", "2024-01-05 10:00:00", "2024-01-05 12:30:00", None, 1),
        ("INC2", "2024-01-05T10:00:00Z", "2024-01-05 09:00:00", None, 2),   # resolved before opened
        ("INC3", "05/01/2024 10:00", None, "2024-01-06 10:00:00", 3),        # closed only
        ("INC4", "bad", None, None, 4),
        ("INC1", "2024-01-05 10:00:00", "2024-01-05 11:00:00", None, 9),     # later copy wins
    ], "number string, created string, resolved_at string, closed string, ingest_ord long")
    out = {r["number"]: r for r in normalize(raw, "2024-01-07 10:00:00").collect()}
    assert len(out) == 4
    assert out["INC1"]["mttr_hours"] == pytest.approx(1.0)
    assert out["INC2"]["mttr_hours"] is None
    assert out["INC3"]["mttr_hours"] == pytest.approx(24.0)
    assert out["INC3"]["age_hours"] == pytest.approx(48.0)
    assert out["INC4"]["opened_at"] is None and out["INC4"]["age_hours"] is None


def test_alias_collision_keeps_first_and_missing_number(spark):
    raw = _rows(spark, [("INC1", "x", "y")], "number string, Title string, short_description string")
    out = normalize(raw).collect()[0]
    assert out["short_description"] == "x"
    with pytest.raises(ValueError):
        normalize(_rows(spark, [("a",)], "title string"))


def test_compat_record_type(spark):
    raw = _rows(spark, [("CHG1", "t")], "number string, title string")
    assert normalize(raw).collect()[0]["record_type"] == "Change"
    assert normalize(raw, compat_record_type=True).collect()[0]["record_type"] == "Incident"


def test_null_numbers_collapse(spark):
    raw = _rows(spark, [(None, "a", 1), (None, "b", 2)], "number string, title string, ingest_ord long")
    rows = normalize(raw).collect()
    assert len(rows) == 1 and rows[0]["short_description"] == "b"
