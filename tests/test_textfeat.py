"""Collapsing identical texts before tokenising changes no result."""

from pyspark.sql import functions as F

from tixflow.functions.text import vectoriser_terms
from tixflow.operators import textfeat
from tixflow.operators.classify import classify

SF = "/root/testdata/sf0.001"


def _docs(spark):
    # One text holds a third of the rows (a hot group); others repeat a little.
    hot = "disk full on file host after backup"
    rows = [(i, hot) for i in range(30)]
    rows += [(100 + i, f"printer {i % 7} offline in branch {i % 5}") for i in range(50)]
    rows += [(200 + i, "network switch down after power loss") for i in range(10)]
    rows += [(300, None), (301, ""), (302, "the and of")]
    return spark.createDataFrame(rows, "id long, txt string")


def _rounded(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                  for r in df.select(*cols).collect())


def test_fit_transform_texts_equals_per_document(spark):
    docs = _docs(spark)
    d = docs.select("id", vectoriser_terms(F.col("txt")).alias("terms"))
    v1, w1 = textfeat.fit_transform(d, ["id"], 50, 2)
    v2, w2 = textfeat.fit_transform_texts(docs, ["id"], "txt", vectoriser_terms, 50, 2)
    cols = ["term", "total", "df", "idf"]
    assert _rounded(v1, cols) == _rounded(v2, cols)
    assert _rounded(w1, ["id", "term", "w"]) == _rounded(w2, ["id", "term", "w"])


def test_distinct_texts_multiplicities(spark):
    doc_text, texts = textfeat.distinct_texts(_docs(spark), "txt", "id")
    got = {r["text"]: (r["tord"], r["tmult"]) for r in texts.collect()}
    assert got["disk full on file host after backup"] == (0, 30)
    assert got["network switch down after power loss"] == (200, 10)
    assert sum(m for _, m in got.values()) == doc_text.count() == 93


def test_classify_one_result_per_ticket(spark):
    """The rule join on the text hash neither drops nor duplicates tickets."""
    from tixflow.plans import catalog
    t = catalog.tickets(spark, SF)
    rows = classify(t).select("number", "category", "category_source").collect()
    once = {r["number"]: (r["category"], r["category_source"]) for r in rows}
    assert len(rows) == len(once) == t.count()
    sources = {s for _, s in once.values()}
    assert sources <= {"original", "rule", "ml", "uncategorized"}
    assert "rule" in sources and "original" in sources
