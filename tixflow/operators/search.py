"""Similar-document search for many queries (P20).

Texts are put into impact order (by their heaviest term, the heaviest weights
first) and cut into blocks of ``BLOCK`` texts.  A block keeps the largest weight
of each of its terms, so a query's product with these maxima bounds its score
with every text of the block.  Each query first scores the block of its highest
bound; its ``top_n``-th score there is the threshold below which no other block
is read.  Blocks are scored as one matrix product with at most about ``QUERIES``
queries, and only ``top_n`` texts a query and block leave a task.

Equal query texts are one query and equal document texts one text; documents
come in at the end, at most ``top_n`` a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tixflow.operators import textfeat
from tixflow.operators.components import dense_index
from tixflow.operators.similarity import SIM_DECIMALS
from tixflow.session import cut_lineage

BLOCK, QUERIES = 256, 1024
Q = ["q1", "q2"]
T = ["th1", "th2"]


def _arrays(w: DataFrame, keys: list[str], tids: DataFrame) -> DataFrame:
    e = w.join(F.broadcast(tids), "term").groupBy(*keys).agg(F.collect_list(F.struct("tid", "w")).alias("e"))
    return e.select(*keys, F.col("e.tid").alias("tids"), F.col("e.w").alias("ws"))


def text_blocks(texts: DataFrame, text_w: DataFrame, block: int = BLOCK) -> DataFrame:
    """(th1, th2, tord, block, pos): every text with terms, in impact order; pos is its place by ``tord`` in the block."""
    lead = text_w.groupBy(*T).agg(F.max(F.struct("w", "term")).alias("m"))
    lead = cut_lineage(lead.select(*T, F.struct(F.col("m.term").alias("t"), (-F.col("m.w")).alias("w"), *T).alias("impact")))
    at = lead.join(dense_index(lead, "impact", "_i"), "impact").select(*T, F.floor(F.col("_i") / block).cast("long").alias("block"))
    pos = F.row_number().over(Window.partitionBy("block").orderBy("tord"))
    return at.join(texts.select(*T, "tord"), T).withColumn("pos", pos)


def _best_of_block(top_n: int, n_terms: int):
    """Function over the queries and the texts of one block: the ``top_n`` best texts of positive score of each query."""
    def dense(t: pa.Table) -> np.ndarray:
        tids, ws = t.column("tids").combine_chunks(), t.column("ws").combine_chunks()
        x = np.zeros((t.num_rows, n_terms))
        x[np.repeat(np.arange(t.num_rows), tids.value_lengths().to_numpy()), tids.flatten().to_numpy()] = ws.flatten().to_numpy()
        return x

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        d = d.sort_by("pos")
        score = dense(q) @ dense(d).T if q.num_rows and d.num_rows else np.zeros((q.num_rows, d.num_rows))
        order = np.argsort(-np.round(score, SIM_DECIMALS), axis=1, kind="stable")[:, :top_n]  # ties: the earlier text
        row = np.repeat(np.arange(q.num_rows), order.shape[1])
        col = order.ravel()
        found = score[row, col]
        some = np.round(found, SIM_DECIMALS) > 0
        row, col = pa.array(row[some]), pa.array(col[some])
        return pa.table([q.column(c).take(row) for c in Q] + [d.column(c).take(col) for c in T] + [pa.array(found[some])], names=[*Q, *T, "score"])

    return best


def find_similar_batch(queries: DataFrame, query_key: str, query_text: str, doc_text: DataFrame, texts: DataFrame, text_w: DataFrame,
                       vocab: DataFrame, terms_fn, order_col: str, top_n: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_key, rank, document columns, similarity_score): the ``top_n`` best documents of every query.

    ``queries``: (query_key, query_text); ``doc_text``, ``texts`` (with
    ``tord``) and ``text_w`` as from ``textfeat.fit_texts``.  Documents that share
    no term with a query score 0 and are still eligible, so every query has
    ``min(top_n, documents)`` rows; equal scores (9 decimals) go to the earlier
    document.
    """
    asked, wanted = textfeat.distinct_texts(queries.select(query_key, query_text), query_text)
    asked = asked.select(query_key, F.col("th1").alias("q1"), F.col("th2").alias("q2"))
    wanted = cut_lineage(wanted.select(F.col("th1").alias("q1"), F.col("th2").alias("q2"), terms_fn(F.col("text")).alias("terms")))
    qw = cut_lineage(textfeat.transform(wanted, vocab, Q))
    tids = cut_lineage(vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("tid")))  # bounded by max_features
    n_terms, n_queries = tids.count() or 1, wanted.count()  # two numbers on the driver
    text_w = cut_lineage(text_w)
    at = cut_lineage(text_blocks(texts, text_w, block))
    maxima = text_w.join(at.select(*T, "block"), T).groupBy("block", "term").agg(F.max("w").alias("most"))
    reach = qw.join(cut_lineage(maxima), "term").groupBy(*Q, "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    reach = cut_lineage(reach)
    tiles = -(-n_queries // QUERIES) or 1
    tile = F.pmod(F.xxhash64(*Q), F.lit(tiles)).cast("int")
    qv, dv = cut_lineage(_arrays(qw, Q, tids)), cut_lineage(_arrays(text_w, T, tids).join(at, T))

    def scored(visits: DataFrame) -> DataFrame:
        left = cut_lineage(visits.select(*Q, "block").join(qv, Q).withColumn("tile", tile))
        need = left.groupBy(F.col("block").alias("_b"), F.col("tile").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
        right = dv.join(need, F.col("block") == F.col("_b")).select(F.col("_b").alias("block"), F.col("_t").alias("tile"), "pos", *T, "tids", "ws")
        return left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(
            lambda q, d: best(q, d), "q1 long, q2 long, th1 long, th2 long, score double")

    best = _best_of_block(top_n, n_terms)
    first = reach.groupBy(*Q).agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))
    first = cut_lineage(first)
    found = cut_lineage(scored(first))
    floor = found.groupBy(*Q).agg(F.when(F.count(F.lit(1)) >= top_n, F.min("score")).otherwise(F.lit(0.0)).alias("floor"))
    rest = reach.join(first.withColumnRenamed("block", "_b"), Q).where(F.col("block") != F.col("_b")).join(floor, Q, "left")
    rest = rest.where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 1e-8)
    found = found.unionByName(scored(cut_lineage(rest.select(*Q, "block")))).join(at.select(*T, "tord"), T)
    by_score: Column = F.round("score", SIM_DECIMALS).desc()
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*Q).orderBy(by_score, "tord"))).where(F.col("_r") <= top_n)
    found = cut_lineage(found.select(*Q, *T, "score"))

    docs = doc_text.withColumn("_d", F.row_number().over(Window.partitionBy(*T).orderBy(order_col))).where(F.col("_d") <= top_n).drop("_d")
    hits = docs.join(found, T)
    # queries with too few texts of positive score: the earliest other documents fill up
    short = wanted.select(*Q).join(found.groupBy(*Q).agg(F.count(F.lit(1)).alias("n")), Q, "left").where(F.coalesce("n", F.lit(0)) < top_n).select(*Q)
    early = doc_text.orderBy(order_col).limit(2 * top_n)
    fill = short.crossJoin(F.broadcast(early)).join(found.select(*Q, *T), [*Q, *T], "left_anti").withColumn("score", F.lit(0.0))  # 2 * top_n rows a query
    cols = [c for c in doc_text.columns if c not in T]
    ranked = hits.select(*Q, *cols, "score").unionByName(fill.select(*Q, *cols, "score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*Q).orderBy(by_score, order_col))).where(F.col("rank") <= top_n)
    return asked.join(cut_lineage(ranked), Q).select(query_key, "rank", *cols, F.col("score").alias("similarity_score"))
