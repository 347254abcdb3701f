"""Periodic runs (operator 11) against brute force, and their defined cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tixflow.llm import periodic_runs as P


def brute(w):
    """(start, length, period) of every run, from the definition."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                stretch = w[i:j + q]
                if not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                    out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, text):
    """Words of the document as the query's contract rebuilds them."""
    w = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(doc_id, w):
    runs = brute(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def texts():
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 5), (5, "a " * 6), (6, "a b " * 4), (7, "a b a b a b a"), (8, "x a b a b a b a b y y y y y y z"), (None, "a " * 9), (8, "a b c " * 4)]
    for i in range(150):  # few different words: many runs of short periods, overlapping and nested
        rows.append((10 + i, " ".join(rng.choice("ab" if i % 2 else "abc") for _ in range(rng.randrange(0, 60)))))
    for i in range(60):  # runs of every scale, with repeats inside the period
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(1, 3)):
            q = rng.randrange(1, 70)
            unit = [f"w{rng.randrange(3 if i % 3 else 50)}" for _ in range(q)]
            if i % 4 == 0:
                unit = unit[:max(1, q // 3)] * 2 + unit  # a period that holds a square
            length = rng.randrange(3 * len(unit), 6 * len(unit) + 2)
            w += (unit * 7)[:length] + [f"v{rng.randrange(9)}" for _ in range(rng.randrange(5))]
        rows.append((200 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("short", [1, 2, 4, 16])
def test_runs_of_every_scale(monkeypatch, short):
    monkeypatch.setattr(P, "SHORT", short)
    rng = random.Random(short)
    lists = [(t or "").split() for _, t in texts()]
    ids = {}
    h = np.array([ids.setdefault(x, rng.getrandbits(64)) for w in lists for x in w], np.uint64)
    off = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    t, s, n, q = P.find_runs(h, off)
    got = {}
    for d, *r in zip(t.tolist(), s.tolist(), n.tolist(), q.tolist(), strict=True):
        got.setdefault(d, []).append(tuple(r))
    assert got == {d: brute(w) for d, w in enumerate(lists) if brute(w)}
    assert max(q) > 40 and len(q) > 100


def test_operator(docs_of):
    rows = texts()
    d = P.periodic_runs(docs_of(rows, clash=True).withColumn("runs", F.lit("x")).withColumn("start", F.lit("x")))
    assert d.columns == [*docs_of(rows, clash=True).columns, "start", "n_words", "runs", "collapsed"]
    left = list(rows)
    for r in d.collect():
        w = (r["text"] or "").split()
        assert (r["doc_id"], r["text"]) in left and r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == brute(w)
        left.remove((r["doc_id"], r["text"]))
    assert not left
    assert P.periodic_runs(docs_of([])).collect() == []
    assert P.periodic_runs(docs_of([(1, "a " * 8)]).select("text")).collect()[0]["collapsed"] == "a"


def test_query(shipped, docs_of, tmp_path):
    rows = [r for r in texts() if r[0] is not None] + [(300 + i, " ".join(f"u{j % 97}" for j in range(i * 3))) for i in range(100)]
    docs_of(rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, P.op11_periodic_runs(shipped, str(tmp_path)).drop("n_words").collect()))
    assert got == sorted(digest(i, rewritten(i, t)) for i, t in rows)


def test_long_texts(docs_of):
    rng = random.Random(1)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = [(1, "be " * 200_000), (2, " ".join(unit * 5)), (3, "no white space" + "x" * 300_000), (4, "a b " * 100_000)]
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], len(r["collapsed"].split())) for r in P.periodic_runs(docs_of(rows)).collect()}
    assert got == {1: ([(0, 200_000, 1)], 1), 2: ([(0, 100_000, 20_000)], 20_000), 3: ([], 3), 4: ([(0, 200_000, 2)], 2)}
