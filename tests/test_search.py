"""Batch similar-text search against brute force."""

import random

import numpy as np
import pytest

from tixflow.functions.text import vectoriser_terms
from tixflow.operators import search, textfeat


def docs_and_queries():
    rng = random.Random(20)
    words = [f"term{i}" for i in range(40)]
    docs = [(i, 1000 - i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    docs += [(150 + i, 500 + i, docs[3][2]) for i in range(20)] + [(180, 5, ""), (181, 3, None), (182, 4, "###")]  # copies, empty ones
    queries = [(f"q{i}", d[2]) for i, d in enumerate(docs) if i % 10 == 0] + [("none", "unknownword"), ("null", None), ("empty", ""), ("twice", docs[3][2]), ("again", docs[3][2])]
    return docs, queries


@pytest.mark.parametrize("block", [4, 64])
def test_batch_search(spark, block):
    docs, queries = docs_and_queries()
    d = spark.createDataFrame(docs, "number long, ord long, text string")
    q = spark.createDataFrame(queries, "qid string, query string")
    vocab, doc_text, texts, w = textfeat.fit_texts(d, "text", vectoriser_terms, 200, 1, ord_col="ord")
    got = {}
    for r in search.find_similar_batch(q, "qid", "query", doc_text.select("number", "ord", "th1", "th2"), texts, w, vocab, vectoriser_terms, "ord", 5, block).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["number"], round(r["similarity_score"], 6))
    terms = {r["term"]: k for k, r in enumerate(vocab.collect())}

    def matrix(df, key):
        m = {}
        for r in textfeat.transform(df.select(key, vectoriser_terms(df["t"]).alias("terms")), vocab, [key]).collect():
            m.setdefault(r[key], np.zeros(len(terms)))[terms[r["term"]]] = r["w"]
        return m

    dm, qm, zero = matrix(d.withColumnRenamed("text", "t"), "number"), matrix(q.withColumnRenamed("query", "t"), "qid"), np.zeros(len(terms))
    for qid, _ in queries:
        scored = sorted((-round(float(dm.get(n, zero) @ qm.get(qid, zero)), 9), o, n) for n, o, _ in docs)[:5]
        assert got[qid] == {k + 1: (n, round(-s, 6)) for k, (s, _, n) in enumerate(scored)}, qid
    assert len(got) == len(queries)


def test_fewer_documents_than_asked(spark):
    d = spark.createDataFrame([(1, 1, "alpha beta"), (2, 2, "gamma")], "number long, ord long, text string")
    q = spark.createDataFrame([("a", "beta"), ("b", "zzz")], "qid string, query string")
    vocab, doc_text, texts, w = textfeat.fit_texts(d, "text", vectoriser_terms, 200, 1, ord_col="ord")
    rows = search.find_similar_batch(q, "qid", "query", doc_text.select("number", "ord", "th1", "th2"), texts, w, vocab, vectoriser_terms, "ord", 5).collect()
    assert sorted((r["qid"], r["rank"], r["number"]) for r in rows) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2)]
