"""Health score arithmetic, labels, recommendation rules."""

from pyspark.sql import functions as F

from tixflow.operators import health as H
from tixflow.operators.rootcause import map_recommendations, rules_frame


def _tickets(spark, p1_open, p1_breach, aged_other, resolved, no_rc):
    rows = []
    n = 0
    for _ in range(p1_open):           # open P1, aged
        rows.append((f"T{n}", "P1", "New", 200.0, None, "")); n += 1
    for _ in range(aged_other):        # other aged open tickets
        rows.append((f"T{n}", "P3", "On Hold", 500.0, None, "")); n += 1
    for i in range(resolved):
        mttr = 10.0 if i < p1_breach else 1.0
        rc = "" if i < no_rc else "cause"
        rows.append((f"T{n}", "P1" if i < p1_breach else "P2", "Closed", 5.0, mttr, rc)); n += 1
    return spark.createDataFrame(rows, "number string, priority string, state string, age_hours double, "
                                       "mttr_hours double, root_cause string")


def test_stored_run_arithmetic(spark):
    # 14 open P1 -> 30 (cap); 10 breaches -> 20 (cap); 39 patterns -> 20 (cap);
    # 83 aged -> 15 (cap); 115 of 208 resolved without root cause -> 5.53: 100 - 90.53 -> 9
    t = _tickets(spark, p1_open=14, p1_breach=10, aged_other=69, resolved=208, no_rc=115)
    n_patterns = spark.createDataFrame([(39,)], "n_patterns long")
    s = H.health_score(t, n_patterns).collect()[0]
    assert s["health_score"] == 9 and s["health_label"] == "Critical"
    d = {r["deduction"]: r["points"] for r in H.health_deductions(t, n_patterns).collect()}
    assert d == {"p1_open": 30.0, "p1_breach": 20.0, "recurring_patterns": 20.0, "aged_open": 15.0,
                 "no_root_cause_rate": d["no_root_cause_rate"]}
    assert abs(d["no_root_cause_rate"] - 5.528846) < 1e-5


def test_score_bands(spark):
    df = spark.createDataFrame([(x,) for x in [85, 84, 65, 64, 40, 39, 0]], "s int")
    label, _ = H.score_label(F.col("s"))
    got = [r[0] for r in df.select(label).collect()]
    assert got == ["Healthy", "Fair", "Fair", "At Risk", "At Risk", "Critical", "Critical"]


def test_substring_rule_fires(spark):
    kw = spark.createDataFrame([(0, ["successfully", "ran"]), (1, ["nothing"])], "id int, keywords array<string>")
    got = map_recommendations(kw, "id", rules_frame(spark)).collect()
    assert [(r["id"], r["rule_id"]) for r in got] == [(0, 2)]   # "full" in "successfully" -> disk rule
