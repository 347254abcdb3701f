"""Edge cases of the ticket operators."""

import json
import os

from pyspark.sql import functions as F

from tixflow.operators.classify import classify
from tixflow.operators.components import connected_components
from tixflow.operators.density import density_clusters, noise_count
from tixflow.operators.normalize import DERIVED_NAMES, ORD, REQUIRED_NAMES, empty_tickets, normalize
from tixflow.operators.report import recommendations, run_report, write_report
from tixflow.operators.stats import exact_median
from tixflow.sources.files import write_report_json


def _tickets(spark, rows, schema="number string, title string, category string, state string, priority string, ingest_ord long"):
    return normalize(spark.createDataFrame(rows, schema), "2024-01-01 00:00:00")


def test_column_order(spark):
    t = _tickets(spark, [("INC1", "x", "", "1", "2", 0)])
    assert t.columns == [*REQUIRED_NAMES, *DERIVED_NAMES, ORD]
    extra = normalize(spark.createDataFrame([("INC1", "x", "e")], "number string, title string, site string"))
    assert extra.columns == [*REQUIRED_NAMES, *DERIVED_NAMES, "site", ORD]


def test_empty_input(spark):
    e = empty_tickets(spark)
    assert e.count() == 0 and e.columns == [*REQUIRED_NAMES, *DERIVED_NAMES, ORD]
    t = _tickets(spark, [])
    assert t.count() == 0 and t.columns == e.columns
    d = density_clusters(t, ["number"], ORD)
    assert d.labels.count() == 0
    assert noise_count(d.labels).first().asDict() == {"noise_count": 0, "total_tickets": 0}


def test_category_text_tier(spark):
    t = _tickets(spark, [("INC1", "nothing telling", "vpn and firewall", "1", "2", 0), ("INC2", "sql deadlock", "", "1", "2", 1)])
    plain = {r["number"]: (r["category"], r["category_source"]) for r in classify(t).collect()}
    by_text = {r["number"]: (r["category"], r["category_source"]) for r in classify(t, use_category_text=True).collect()}
    assert plain["INC1"] == ("Other", "uncategorized")
    assert by_text["INC1"] == ("Network", "rule") and by_text["INC2"] == plain["INC2"] == ("Database", "rule")


def _rc_recs(spark, n):
    same = "x" * 60
    return spark.createDataFrame([(1 + i % 3, 1 + i // 3, f"cause {i}", 10, f"{same}{i % 14}") for i in range(n)],
                                 "rc_order int, rank int, label string, ticket_count long, recommendation string")


def test_recommendation_dedupe_and_limit(spark):
    t = _tickets(spark, [("INC1", "x", "", "6", "2", 0)])
    mttr = spark.createDataFrame([], "priority string, breach_pct double")
    patterns = spark.createDataFrame([], "cluster_id int, label string, size long, keywords array<string>, top_services array<string>, trend string, trend_by_time string")
    by_prefix = recommendations(t, mttr, patterns, _rc_recs(spark, 20)).collect()
    in_full = recommendations(t, mttr, patterns, _rc_recs(spark, 20), dedupe="full").orderBy("seq").collect()
    assert sum(r["action"].startswith("xxx") for r in by_prefix) == 1
    assert len(in_full) == 10 and len({r["action"] for r in in_full}) == 10
    assert [r["seq"] for r in in_full] == list(range(1, 11))
    assert recommendations(t, mttr, patterns, _rc_recs(spark, 20), dedupe="full", limit=4).count() == 4


def test_report_content(spark, tmp_dir):
    rows = [(f"INC{i}", "branch office lost wireless connectivity" if i % 2 else "nightly sql batch hits deadlock", "", "1" if i < 4 else "4", "1", i) for i in range(12)]
    rep = run_report(_tickets(spark, rows), "2024-01-01 00:00:00", with_root_causes=False, generated_at="fixed")
    write_report_json(rep.row, os.path.join(tmp_dir, "rep"))
    part = next(f for f in os.listdir(os.path.join(tmp_dir, "rep")) if f.endswith(".json"))
    with open(os.path.join(tmp_dir, "rep", part)) as f:
        got = json.loads(f.read())
    assert got["generated_at"] == "fixed" and got["metrics"]["summary"]["total"] == 12
    assert got["metrics"]["summary"]["open"] == 4 and got["metrics"]["summary"]["p1_open"] == 4
    assert sorted(c["size"] for c in got["patterns"]["clusters"]) == [6, 6]
    assert got["root_causes"]["unresolved_insight"].startswith("4 ticket(s) remain open. 4 are P1")
    write_report(rep, os.path.join(tmp_dir, "tables"))
    back = spark.read.parquet(os.path.join(tmp_dir, "tables", "summary.parquet")).first()
    assert (back["total"], back["open"], back["n_patterns"], back["noise_count"]) == (12, 4, 2, 0)
    assert spark.read.parquet(os.path.join(tmp_dir, "tables", "pattern_members.parquet")).count() == 12
    assert rep.members.count() == 12 and {r["cluster_id"] for r in rep.members.collect()} == {0, 1}


def test_components_with_a_hub_and_a_chain(spark):
    hub = [(0, i) for i in range(1, 200)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame(hub + chain + [(5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(200), *range(1000, 1041), 9999]], "node long")
    got = {r["node"]: r["comp"] for r in connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(200)} == {0} and {got[1000 + i] for i in range(41)} == {1000} and got[9999] == 9999


def test_median_with_one_value_for_a_third_of_the_rows(spark):
    rows = [("hot", 5.0)] * 300 + [("hot", float(i)) for i in range(600)] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    want = {r["k"]: r["m"] for r in df.where("v is not null").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want
