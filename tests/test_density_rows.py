"""Vocabulary and vectors from text buffers, and links in place of pairs, against the definitions."""

import random

from pyspark.sql import functions as F

from test_ballcover import brute_clusters, cosines, table, unit
from tixflow.functions.text import vectoriser_terms
from tixflow.operators import ballcover as B
from tixflow.operators import similarity as S
from tixflow.operators import textfeat as T
from tixflow.operators.density import density_clusters
from tixflow.session import cut_lineage


def odd_texts(spark):
    rng = random.Random(4)
    words = ["disk", "full", "the", "a", "of", "Kelvin", "İce", "naïve", "X9", "don't", "mail-server", "42", "日本disk", "zz\tyy"]
    rows = [(i, rng.randrange(1, 4), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    rows += [(200, 1, ""), (201, 2, None), (202, 1, "  "), (203, 1, "a b c"), (204, 3, "disk" + "!" * 300 + "full"), (205, 1, "disk"), (206, 1, "full")]
    return cut_lineage(spark.createDataFrame(rows, "tord long, tmult long, text string").withColumn("th1", F.col("tord")).withColumn("th2", F.lit(0).cast("long")))


def test_vocabulary_and_vectors_equal_the_relational_ones(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 300)
    texts, keys = odd_texts(spark), ["th1", "th2", "tord", "tmult"]
    n_docs = texts.agg(F.sum("tmult").alias("n_docs"))
    for stop in (["the", "of", "disk"], None):
        tf = T.term_counts(texts.select(*keys, vectoriser_terms(F.col("text"), stop).alias("terms")), keys)
        for most, min_df in ((15, 2), (400, 1), (3, 400)):
            want = sorted(map(tuple, T.vocabulary(tf, n_docs, most, min_df, weight="tmult").collect()))
            got = sorted(map(tuple, T.text_vocabulary(texts, n_docs, most, min_df, stop).collect()))
            assert got == want
            terms = [r[0] for r in got]
            vec = {(r["th1"], terms[t]): f for r in T.text_vectors(texts, keys, terms, stop).collect() for t, f in zip(r["tids"], r["tfs"], strict=True)}
            assert vec == {(r["th1"], r["term"]): r["tf"] for r in tf.collect() if r["term"] in terms}


def loose_family(n=200):
    """Texts all near one another, but not to a third of the angle."""
    rng = random.Random(7)
    return {i: unit({t: 1.0 for t in range(30)} | {t: 1.0 for t in rng.sample(range(30, 90), 14)}) for i in range(n)}


def test_links_are_rows_in_proportion_to_the_vectors(spark, monkeypatch):
    vectors = loose_family()
    vectors |= {200: unit({100: 1.0, 101: 1.0}), 201: unit({100: 1.0, 102: 0.5})}  # a pair of noise
    counted, near = [], S.near_vectors

    def counting(*args, **kw):
        out = cut_lineage(near(*args, **kw))
        counted.append(out.count())
        return out

    monkeypatch.setattr(S, "near_vectors", counting)
    got = {r["vid"]: r["comp"] for r in B.ball_clusters(table(spark, vectors), 0.65, 3).collect()}
    assert got == brute_clusters(vectors, {}, 0.65, 3) and set(got.values()) == {0}
    assert len(counted) == 1 and counted[0] <= 4 * len(vectors)


def test_masses_of_links_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = random.Random(9)
    vectors = {i: unit({rng.randrange(80): rng.uniform(0.1, 1) for _ in range(6)} | {i % 9: 1.2}) for i in range(250)}
    mult = {i: rng.choice([1, 1, 2]) for i in vectors}
    ids, sims = cosines(vectors)
    want = {a: mult[a] + sum(mult[b] for y, b in enumerate(ids) if b != a and sims[x, y] >= 0.65) for x, a in enumerate(ids)}
    vec = table(spark, vectors, mult)
    for tile in (40, 1000):
        got = {r["vid"]: r["mass"] for r in B.neighbour_mass(vec, B.neighbour_links(vec, 0.65, 4, tile)).collect()}
        assert got == want


def test_clusters_of_texts_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "similar_pairs", None)
    rows = [(i, i, "disk full on host alpha" + " again" * (i % 2)) for i in range(9)] + [(10, 10, "printer toner empty"), (11, 11, None)]
    res = density_clusters(spark.createDataFrame(rows, "id long, ord long, text string"), ["id"], "ord", text_col="text")
    assert {r["id"]: r["cluster_id"] for r in res.labels.collect()} == {i: 0 if i < 9 else -1 for i, *_ in rows}
    assert {(r["vid"], r["mult"], r["mass"]) for r in res.core.collect()} == {(0, 5, 9), (1, 4, 9)}
