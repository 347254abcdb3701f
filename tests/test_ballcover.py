"""Ball cover and tiled similarity join against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tixflow.operators import ballcover as B
from tixflow.operators import similarity as S
from tixflow.session import cut_lineage

SCHEMA = "vid long, mult long, tids array<int>, ws array<double>"


def unit(weights):
    n = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / n for t, w in weights.items()}


def table(spark, vectors, mult=None):
    rows = [(i, (mult or {}).get(i, 1), sorted(v), [float(v[t]) for t in sorted(v)]) for i, v in vectors.items()]
    return cut_lineage(spark.createDataFrame(rows, SCHEMA))


def cosines(vectors):
    ids, n = sorted(vectors), 1 + max(max(v) for v in vectors.values())
    m = np.zeros((len(ids), n))
    for k, i in enumerate(ids):
        for t, w in vectors[i].items():
            m[k, t] = w
    return ids, np.round(m @ m.T, 9)


def brute_clusters(vectors, mult, threshold, min_samples):
    """{vid: smallest core vid of its cluster}: neighbourhoods, components and border points from the definition."""
    ids, sims = cosines(vectors)
    near = {a: [b for y, b in enumerate(ids) if b != a and sims[x, y] >= threshold] for x, a in enumerate(ids)}
    core = {a for a in ids if mult.get(a, 1) + sum(mult.get(b, 1) for b in near[a]) >= min_samples}
    comp = {}
    for a in sorted(core):
        if a not in comp:
            todo, comp[a] = [a], a
            while todo:
                for b in near[todo.pop()]:
                    if b in core and b not in comp:
                        comp[b] = a
                        todo.append(b)
    edge = {a: min(comp[b] for b in near[a] if b in core) for a in ids if a not in core and any(b in core for b in near[a])}
    return comp | edge


def families(rng, n_terms=60):
    """Tight families, chains between them, loose relatives and strangers."""
    vectors, base = {}, []
    for _ in range(6):
        base.append({rng.randrange(n_terms): rng.uniform(0.2, 1) for _ in range(12)})
    base.append({t: (base[0].get(t, 0) + base[1].get(t, 0)) for t in {*base[0], *base[1]}})  # between two families
    vid = 0
    for v in base:
        for spread in [0.02] * rng.randrange(1, 9) + [0.3] * 4 + [0.7] * 4:
            vectors[vid] = unit({t: max(1e-3, w + rng.uniform(-spread, spread)) for t, w in v.items()} | {rng.randrange(n_terms): spread})
            vid += 1
    for _ in range(15):
        vectors[vid] = unit({rng.randrange(n_terms): rng.uniform(0.2, 1) for _ in range(10)})
        vid += 1
    order = list(vectors)
    rng.shuffle(order)
    return {new: vectors[old] for new, old in enumerate(order)}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    vectors = families(rng)
    mult = {i: rng.choice([1, 1, 1, 2, 5]) for i in vectors}
    got = {r["vid"]: r["comp"] for r in B.ball_clusters(table(spark, vectors, mult), 0.65, 3, tile=16).collect()}
    want = brute_clusters(vectors, mult, 0.65, 3)
    assert got == want and len(set(want.values())) > 1


def test_without_balls_and_empty(spark):
    apart = {i: {i: 1.0} for i in range(5)}
    assert B.ball_clusters(table(spark, apart), 0.65, 3).collect() == []
    got = {r["vid"]: r["comp"] for r in B.ball_clusters(table(spark, apart, {2: 3}), 0.65, 3).collect()}
    assert got == {2: 2}
    assert B.ball_clusters(cut_lineage(spark.createDataFrame([], SCHEMA)), 0.65, 3).collect() == []


def test_near_identical_texts_cost_rows_not_pairs(spark, monkeypatch):
    counted = []
    near = S.near_vectors

    def counting(*args, **kw):
        out = cut_lineage(near(*args, **kw))
        counted.append(out.count())
        return out

    monkeypatch.setattr(S, "near_vectors", counting)
    for k in (40, 80):
        rng = random.Random(k)
        vectors = {i: unit({t: 1.0 for t in range(60)} | {rng.randrange(60, 90): 0.5}) for i in range(k)}
        vec = table(spark, vectors)
        got = {r["vid"]: r["comp"] for r in B.ball_clusters(vec, 0.65, 3).collect()}
        assert got == {i: 0 for i in range(k)}
    assert counted[1] <= 2 * counted[0] + 20 and counted[1] < 80 * 79 // 2 // 8


def test_tiles_of_a_hot_term(spark):
    """One term is in a third of the rows: its list is cut, every group is small, and no pair is lost or repeated."""
    rng = random.Random(5)
    vectors = {}
    for i in range(300):
        v = {rng.randrange(1, 400): rng.uniform(0.3, 1) for _ in range(4)}
        if i % 3 == 0:
            v[0] = 1.5
        vectors[i] = unit(v)
    vec = cut_lineage(table(spark, vectors).withColumn("r", F.lit(0.0)))
    ids, sims = cosines(vectors)
    want = {(a, b): sims[x, y] for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and sims[x, y] >= 0.6}
    rows = S.near_vectors(vec, math.acos(0.6 - 1e-9), tile=8).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): round(r["sim"], 9) for r in rows} == pytest.approx(want)
    lists = vec.where("array_contains(tids, 0)").withColumn("list", F.lit(0))
    sizes = spark.createDataFrame([(0, 13)], "list int, k long")
    groups = S._tile_pairs(lists, sizes, 8).groupBy("list", "i", "j").count().collect()
    assert lists.count() == 100 and max(g["count"] for g in groups) <= 50


def test_one_list_for_dense_vectors(spark):
    rng = random.Random(6)
    vectors = {i: unit({t: rng.uniform(0.1, 1) for t in rng.sample(range(12), 8)}) for i in range(60)}
    vec = cut_lineage(table(spark, vectors).withColumn("r", F.lit(0.0)))
    ids, sims = cosines(vectors)
    want = {(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and sims[x, y] >= 0.65}
    rows = S.near_vectors(vec, math.acos(0.65 - 1e-9), tile=16).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]) for r in rows} == want


def test_rows_are_sent_to_a_bounded_number_of_tiles(spark, monkeypatch):
    """Chunks inside a tile find what small tiles find; rows are sent 16 times, not once per 1,024 vectors."""
    sent = []
    tile_pairs = S._tile_pairs

    def counting(lists, sizes, tile):
        sent.append(sizes.agg(F.max("k")).first()[0])
        return tile_pairs(lists, sizes, tile)

    monkeypatch.setattr(S, "_tile_pairs", counting)
    monkeypatch.setattr(S, "CHUNK", 7)
    monkeypatch.setattr(S, "LEAST_TILE", 2)
    rng = random.Random(8)
    vectors = {i: unit({t: rng.uniform(0.1, 1) for t in rng.sample(range(12), 6)}) for i in range(200)}
    vec = cut_lineage(table(spark, vectors).withColumn("r", F.lit(0.0)))
    ids, sims = cosines(vectors)
    want = {(a, b): sims[x, y] for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and sims[x, y] >= 0.65}
    rows = S.near_vectors(vec, math.acos(0.65 - 1e-9)).collect()
    assert len(rows) == len(want) and {(r["a"], r["b"]): round(r["sim"], 9) for r in rows} == pytest.approx(want)
    assert sent == [16]
