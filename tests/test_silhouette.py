"""Cosine silhouette against the pairwise definition."""

import math
import random

import pytest

from tixflow.operators.silhouette import cosine_silhouette, mean_silhouette


def test_silhouette_equals_the_pairwise_definition(spark):
    rng = random.Random(7)
    vectors = []
    for _ in range(25):
        v = {f"t{rng.randrange(8)}": rng.uniform(0.1, 1) for _ in range(3)}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    points = [(i, i % 3, rng.choice([1, 1, 4])) for i in range(25)] + [(0, 1, 2), (24, 7, 1), (99, 0, 5)]  # a vector in two groups, one alone, a zero vector
    weights = [(i, t, w) for i, v in enumerate(vectors) for t, w in v.items()]
    p, w = spark.createDataFrame(points, "id long, g int, mult long"), spark.createDataFrame(weights, "id long, term string, w double")
    scored = cosine_silhouette(p, w, ["id"], "g")
    got = {(r["id"], r["g"]): r["silhouette"] for r in scored.collect()}
    rows = [(i, g) for i, g, m in points if i < 25 for _ in range(m)]
    far = lambda i, j: 1 - sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items())
    want, total = {}, []
    for k, (i, g) in enumerate(rows):
        own = [far(i, j) for x, (j, h) in enumerate(rows) if h == g and x != k]
        others = {h: [far(i, j) for j, o in rows if o == h] for h in {h for _, h in rows} - {g}}
        b = min(sum(x) / len(x) for x in others.values())
        a = sum(own) / len(own) if own else 0
        want[(i, g)] = 0.0 if not own else (b - a) / max(a, b)
        total.append(want[(i, g)])
    assert got == pytest.approx(want)
    mean = {r["g"]: (r["n"], r["silhouette"]) for r in mean_silhouette(scored, "g").collect()}
    assert mean[None] == pytest.approx((len(rows), sum(total) / len(rows))) and mean[7] == (1, 0.0)


def test_one_group_and_no_points(spark):
    w = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "id long, term string, w double")
    p = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "id long, g int, mult long")
    assert [r["silhouette"] for r in cosine_silhouette(p, w, ["id"], "g").collect()] == [None, None]
    assert cosine_silhouette(p.limit(0), w, ["id"], "g").collect() == []
