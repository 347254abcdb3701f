"""Ticket steps that must not sort or move whole rows, and the faster keyword patterns."""

import random
import re

from pyspark.sql import functions as F

from tixflow.config import CATEGORY_KEYWORDS
from tixflow.operators import classify as C
from tixflow.operators import clusters as CL
from tixflow.operators import textfeat
from tixflow.operators.density import density_clusters
from tixflow.operators.report import with_labels, with_text_labels


def _clean(text):
    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", (text or "").lower())).strip(" ")


def test_keyword_counts_equal_word_boundaries(spark):
    rng = random.Random(3)
    words = [w for kws in CATEGORY_KEYWORDS.values() for w in kws] + ["dbs", "networks", "9", "x", "db", "app"]
    texts = [rng.choice([" ", "-", "  ", ", ", ""]).join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    texts += ["", None, "db db db x", "a db db b", "vpn vpn-vpn", "\tVPN\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.keyword_hits(F.col("t")).alias("h"), C.rule_category(F.col("t")).alias("best"))
    pats = C.keyword_patterns()
    for r in df.collect():
        want = [len(re.findall(p, _clean(texts[r["i"]]))) for p in pats.values()]
        assert [h["hits"] for h in r["h"]] == want
        assert r["best"] == (list(pats)[want.index(max(want))] if max(want) else None)


def test_texts_are_cleaned_once_for_all_counts(spark):
    df = spark.createDataFrame([("a",)], "t string").select(F.explode(C.keyword_hits(F.col("t"))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_distinct_texts_do_not_sort_the_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, None])], "id long, txt string")
    _, texts = textfeat.distinct_texts(df, "txt", "id")
    assert "SortAggregate" not in texts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["text"] or "", r["tord"], r["tmult"]) for r in texts.collect()) == [("", 3, 2), ("a", 0, 2), ("b", 1, 1)]


def test_labels_of_texts_equal_labels_of_tickets(spark):
    rows = [(f"INC{i}", i, t) for i, t in enumerate(["disk full on host"] * 4 + ["printer toner empty"] * 2 + ["", None, "disk full on host now"])] + [(None, 20, "disk full on host")]
    t = spark.createDataFrame(rows, "number string, ingest_ord long, full_text string")
    dens = density_clusters(t, ["number"], "ingest_ord")
    by_text = with_text_labels(t, dens.text_label)
    assert by_text.columns == [*t.columns, "cluster_id"]
    key = lambda r: r["ingest_ord"]
    assert sorted(by_text.collect(), key=key) == sorted(with_labels(t, dens.labels).collect(), key=key)
    assert by_text.where("cluster_id = 0").count() >= 5
    joins = [x for x in by_text._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x]
    assert not joins  # the few texts are broadcast; tickets stay where they are


def test_best_rule_counts_every_category_once(spark):
    df = spark.createDataFrame([("a",)], "t string").select(C.rule_category(F.col("t")).alias("best"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(CATEGORY_KEYWORDS) and plan.count("regexp_replace") == 1


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().toString()


def test_keywords_tokenise_written_distinct_texts(spark):
    rows = [(f"INC{i}", i % 2, "printer jam on floor" if i % 3 else "mail queue stuck") for i in range(30)]
    kw = CL.cluster_keywords(spark.createDataFrame(rows, "number string, cluster_id int, full_text string"))
    assert kw.count() == 12 and "LogicalRDD" not in _leaves(kw)


def test_centroids_tokenise_written_distinct_texts(spark, monkeypatch):
    rows = [("INC1", 1, "Network", "switch port down"), ("INC2", 2, "Database", "slow sql index"), ("INC3", 3, "", "switch down"), ("INC4", 4, "", "switch down")]
    t = spark.createDataFrame(rows, "number string, ingest_ord long, category string, full_text string")
    fit = C.category_centroids(t, min_labeled=1, min_df=1)
    seen, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: seen.append(df) or cut(df))
    pending = textfeat.with_text_hash(t.where("category = ''"), "full_text").select("th1", "th2", F.col("full_text").alias("text")).distinct()
    best = C.nearest_centroid_of_texts(pending, *fit)
    assert [r["b"]["category"] for r in best.collect()] == ["Network"]
    tokenised = [df for df in seen if "Generate" in df._jdf.queryExecution().optimizedPlan().toString()]
    assert tokenised and all("LogicalRDD" not in _leaves(df) for df in tokenised)
