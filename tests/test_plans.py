"""Plans and null-number tickets."""

from pyspark.sql import functions as F

from tixflow.config import STOP_WORDS
from tixflow.operators import metrics as M
from tixflow.operators.normalize import normalize
from tixflow.operators.report import run_report
from tixflow.operators.rootcause import root_cause_clusters
from tixflow.plans import catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_prune_through_the_dedupe(spark):
    plan = _plan(M.ticket_totals(catalog.tickets(spark, "/root/testdata/sf0.001")))
    assert "full_text" not in plan and "close_notes" not in plan
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def _notes(spark, notes):
    rows = [(f"INC{i}", f"ticket {i}", "6", n, i) for i, n in enumerate(notes)]
    return normalize(spark.createDataFrame(rows, "number string, title string, state string, close_notes string, ingest_ord long"), "2024-01-01 00:00:00")


def test_uniform_notes_are_one_root_cause(spark):
    r = root_cause_clusters(_notes(spark, ["restarted the print spooler"] * 8))
    assert r.k == 1 and {x["rc_cluster"] for x in r.corpus.collect()} == {0} and r.corpus.count() == 8


def test_stop_word_notes_have_no_root_cause(spark):
    r = root_cause_clusters(_notes(spark, [" ".join(STOP_WORDS[:8])] * 8))
    assert r.k == 0 and r.corpus.count() == 0


def test_report_keeps_the_ticket_without_a_number(spark):
    rows = [(f"INC{i}" if i else None, "printer offline in the office" if i % 2 else "vpn tunnel drops again", "1", i) for i in range(26)]
    t = normalize(spark.createDataFrame(rows, "number string, title string, state string, ingest_ord long"), "2024-01-01 00:00:00")
    assert t.count() == 26
    rep = run_report(t, "2024-01-01 00:00:00", with_root_causes=False)
    got = rep.tickets
    assert got.count() == 26 and got.where(F.col("category").isNull()).count() == 0
    assert rep.row.first()["metrics"]["summary"]["total"] == 26
