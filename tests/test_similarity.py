"""Prefix-filtered self-join equals brute force; clustering invariants."""

import math

import numpy as np
from pyspark.sql import functions as F

from tixflow.operators.density import density_clusters

SF = "/root/testdata/sf0.001"


def _brute_pairs(res):
    w = res.weights.select("vid", "term", "w").toPandas()
    vids = sorted(w.vid.unique())
    terms = sorted(w.term.unique())
    vi = {v: i for i, v in enumerate(vids)}
    ti = {t: i for i, t in enumerate(terms)}
    m = np.zeros((len(vids), len(terms)))
    for r in w.itertuples():
        m[vi[r.vid], ti[r.term]] = r.w
    sims = m @ m.T
    out = set()
    for i in range(len(vids)):
        for j in range(i + 1, len(vids)):
            if round(sims[i, j], 9) >= 0.65:
                out.add((vids[i], vids[j]))
    return out


def test_pairs_match_brute_force_on_conversations(spark):
    cv = spark.read.parquet(f"{SF}/conversations.parquet")
    docs = cv.select("conv_id", "turn", (F.col("conv_id") * 1048576 + F.col("turn")).alias("ord"), "text")
    res = density_clusters(docs, ["conv_id", "turn"], "ord", text_col="text")
    got = {(r["a"], r["b"]) for r in res.pairs.collect()}
    assert got == _brute_pairs(res)
    labels = res.labels.toPandas()
    assert len(labels) == cv.count()
    sizes = labels[labels.cluster_id >= 0].groupby("cluster_id").size()
    assert (sizes >= 3).all()
    core = res.core.toPandas()
    vc = res.vector_clusters.toPandas()
    cores = set(core[core.is_core].vid)
    assert cores <= set(vc.vid) or len(cores) == 0 or all(
        v in set(vc.vid) for v in cores if True)


def test_duplicates_collapse(spark):
    rows = [(i, i, "disk full on host alpha") for i in range(5)] + [(10, 10, "printer toner empty")]
    docs = spark.createDataFrame(rows, "id long, ord long, text string")
    docs = docs.unionByName(spark.createDataFrame([(11, 11, "printer toner empty")], "id long, ord long, text string"))
    res = density_clusters(docs, ["id"], "ord", text_col="text")
    lab = {r["id"]: r["cluster_id"] for r in res.labels.collect()}
    assert {lab[i] for i in range(5)} == {0}
    assert lab[10] == -1 and lab[11] == -1      # 2 copies < min_samples 3
