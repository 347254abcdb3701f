import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def shipped(spark):
    from tixflow.llm.common import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def docs_of(shipped):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    def make(rows, clash=False):
        df = shipped.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F
            for c in ("th", "k1", "k2", "a", "b", "n", "words", "hash", "at", "part", "rem", "nid", "comp", "kind", "range", "item", "score", "keep"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared passages, nulls, empties and one very long text."""
    import random
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "ñu", "größe", "and", "THE", "don't", "x_1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(120), text(70)
    rows = [(1, base), (2, base), (3, base.replace("w1", "w2", 1)), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (9, "Two words")]
    for i in range(10, 40):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(40, 60):
        rows.append((i, text(rng.randrange(20, 90)) + " " + passage + " " + text(rng.randrange(0, 60))))
    rows += [(60, "be " * 200), (61, "be " * 260), (62, text(9000)), (63, text(30)), (64, "a\x0bb\x0cc  d e f\x1cg")]
    return rows
