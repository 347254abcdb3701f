"""TF-IDF as relational operators.

A document set is a frame with id columns and a ``terms`` array (1- and
2-grams, see ``functions.text.vectoriser_terms``).  Everything below is a
shuffle-aware composition:

* term counts: ``explode`` + ``groupBy(id, term)`` after one repartition on
  the id, so the later per-document window needs no further exchange;
* vocabulary: ``groupBy(term)`` with map-side partial sums, then a global
  top-k (``orderBy().limit()``, merged from per-partition top-k).  Its size
  is bounded by ``max_features``, which is what makes it safe to broadcast;
* counts of texts that no caller needs term by term (``text_vocabulary``,
  ``text_vectors``): words are found on whole Arrow buffers, a text is never
  sent anywhere, and only counts per distinct term of a slice leave it;
* weights: broadcast join with the vocabulary, L2 norm by a window on the
  document id (a document has at most ``max_features`` distinct terms).

Vocabulary order: total count descending, then term ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.session import cut_lineage

SLICE_BYTES = 4 << 20  # of text that is cut into words at a time


def term_counts(docs: DataFrame, ids: list[str], terms: str = "terms") -> DataFrame:
    """(ids..., term, tf) for every term occurrence, grouped per document."""
    return (docs.select(*ids, terms)
                .repartition(*ids)
                .select(*ids, F.explode(terms).alias("term"))
                .groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf")))


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def with_text_hash(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``th1``, ``th2``: a 128-bit hash of the text."""
    c = F.col(text_col)
    return docs.withColumn("th1", F.xxhash64(c)).withColumn("th2", F.xxhash64(F.lit("tixflow"), c))


def distinct_texts(docs: DataFrame, text_col: str, ord_col: str | None = None,
                   extra_keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Collapse identical texts before any tokenising.

    Returns ``doc_text`` (every input column, ``th1``, ``th2``: a 128-bit hash
    of the text) and ``texts`` (th1, th2, extra_keys..., [tord,] tmult, text):
    one row per distinct text (and ``extra_keys`` value) with its earliest
    ``ord_col`` and its number of documents.
    The ``groupBy`` combines map-side, so a text repeated across a third of
    the rows is one row per map task before the shuffle.  The text is a key:
    as an aggregate (a string buffer) it would make Spark sort all rows.
    """
    doc_text = with_text_hash(docs, text_col)
    aggs = [F.min(ord_col).alias("tord")] if ord_col else []
    aggs.append(F.count(F.lit(1)).alias("tmult"))
    keys = ["th1", "th2", *(extra_keys or [])]
    texts = doc_text.groupBy(*keys, F.col(text_col).alias("text")).agg(*aggs)
    return doc_text, texts.select(*keys, *(["tord"] if ord_col else []), "tmult", "text")


def vocabulary(tf: DataFrame, n_docs: DataFrame, max_features: int | None,
               min_df: int = 1, weight: str | None = None) -> DataFrame:
    """(term, total, df, idf, term_rank): the fitted vocabulary.

    ``idf = ln((1 + n) / (1 + df)) + 1`` (smoothed).  Bounded by
    ``max_features`` rows.  ``weight``: a column of ``tf`` holding how many
    documents a row stands for (distinct texts collapsed before
    tokenising); counts and document frequencies are multiplied by it.
    """
    if weight is None:
        stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    else:
        stats = tf.groupBy("term").agg(F.sum(F.col("tf") * F.col(weight)).alias("total"),
                                       F.sum(weight).alias("df"))
    return ranked_vocabulary(stats, n_docs, max_features, min_df)


def ranked_vocabulary(stats: DataFrame, n_docs: DataFrame, max_features: int | None, min_df: int) -> DataFrame:
    """``vocabulary`` from (term, total, df) of every term."""
    stats = stats.where(F.col("df") >= min_df)
    if max_features is not None:
        stats = stats.orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features)
    # n_docs is one row; the product is bounded by the vocabulary size.
    v = stats.crossJoin(F.broadcast(n_docs))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return v.select("term", "total", "df", idf.alias("idf"))


_CLEAN = np.zeros(256, np.uint8)
for _lo, _hi, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97)):
    _CLEAN[_lo:_hi] = np.arange(_to, _to + _hi - _lo)


def _kept_words(texts: pa.Array, stop_words: list[str] | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words as of ``functions.text`` (cleaned, two characters or more, no stop words).

    Returns each word's index in the distinct words, its text, and the distinct words.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    for upper, lower in (("\u212a", "k"), ("\u0130", "i ")):  # the only other letters whose small ones are ASCII
        if pc.any(pc.match_substring(texts, upper)).as_py():
            texts = pc.replace_substring(texts, upper, lower)
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = _CLEAN[np.frombuffer(raw, np.uint8)[off[0]:off[-1]]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 0
    border = np.zeros(len(data) + 1, bool)
    border[off] = True
    first, last = inside[:-1].copy(), inside[:-1].copy()
    first[1:] &= ~inside[:-2] | border[1:-1]
    last &= ~inside[1:] | border[1:]
    inside[:-1] &= ~(first & last)  # words of one character
    s, e = np.flatnonzero(first & inside[:-1]), np.flatnonzero(last & inside[:-1]) + 1
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=ends[1:])
    words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(data[inside[:-1]])).dictionary_encode()
    code, text = words.indices.to_numpy().astype(np.int64), np.searchsorted(off, s, side="right") - 1
    if stop_words and len(code):
        keep = ~pc.is_in(words.dictionary, value_set=pa.array(stop_words, pa.large_string())).to_numpy(zero_copy_only=False)[code]
        code, text = code[keep], text[keep]
    return code, text, words.dictionary


def _slices(col: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end rows of slices of about ``SLICE_BYTES`` of text; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        yield i, j
        i = j


BUCKETS = 1 << 16
_BYTE, _ONE, _TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _buckets(words: pa.Array, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words ``code``, and of the pairs of words that begin at ``at``: the same in every process."""
    n = len(words)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]].astype(np.uint64)
    off = off - off[0]
    place = (np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))).astype(np.uint64)
    h = (data + np.uint64(1)) * _BYTE
    h = (h ^ (h >> np.uint64(29))) * (_ONE + np.uint64(2) * place)
    h = np.add.reduceat(h ^ (h >> np.uint64(32)), off[:-1]) * _TWO
    h = h ^ (h >> np.uint64(31))
    of = lambda x: (x * _BYTE >> np.uint64(64 - 16)).astype(np.int64)
    return of(h)[code], of((h * _ONE)[code[at]] + (h * _TWO)[code[at + 1]])


def text_vocabulary(texts: DataFrame, n_docs: DataFrame, max_features: int | None, min_df: int, stop_words: list[str] | None) -> DataFrame:
    """``vocabulary`` of the terms of ``functions.text.vectoriser_terms``, from written texts (tmult, text) that stand for ``tmult`` documents.

    Most terms are rare pairs of words.  A first pass adds up totals per bucket of
    terms, and counts the most frequent terms of each slice, which bounds the total
    of the last term of the vocabulary from below.  Terms of buckets below that
    bound cannot be in it; the others are counted exactly by a second pass.
    """

    def words_of(batches):
        for b in batches:
            for i, j in _slices(b.column(1)):
                code, text, words = _kept_words(b.column(1).slice(i, j - i), stop_words)
                if len(code):
                    at = np.flatnonzero(text[1:] == text[:-1])
                    yield b.column(0).slice(i, j - i).to_numpy(), code, text, words, at, _buckets(words, code, at)

    def counts(of, text, mult):
        """Distinct ``of``, their totals and document frequencies."""
        each, of = np.unique(of, return_inverse=True)
        seen = np.unique(text * len(each) + of)
        total = np.bincount(of, mult[text], minlength=len(each)).astype(np.int64)
        return each, total, np.bincount(seen % max(len(each), 1), mult[seen // max(len(each), 1)], minlength=len(each)).astype(np.int64)

    def strings(each, words, pair):
        if not pair:
            return words.take(pa.array(each)).cast(pa.string())
        a, b = (words.take(pa.array(x)) for x in (each // len(words), each % len(words)))
        return pc.binary_join_element_wise(a, b, pa.scalar(" ", pa.large_string())).cast(pa.string())

    def first(batches):
        sums = np.zeros(BUCKETS)
        for mult, code, text, words, at, (one, two) in words_of(batches):
            pairs = np.bincount(two, mult[text[at]], minlength=BUCKETS)
            sums += np.bincount(one, mult[text], minlength=BUCKETS) + pairs
            at = at[pairs[two] >= np.partition(pairs, -2 * max_terms)[-2 * max_terms]]  # any terms give a bound
            for pair, (each, total, df) in enumerate((counts(code, text, mult), counts(code[at] * len(words) + code[at + 1], text[at], mult))):
                most = np.argsort(-total, kind="stable")[:max_terms]
                yield pa.RecordBatch.from_arrays([strings(each[most], words, pair), pa.nulls(len(most), pa.int32()), pa.array(total[most]), pa.array(df[most])], names=names)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(sums[used].astype(np.int64)), pa.nulls(len(used), pa.int64())], names=names)

    max_terms, names = min(max_features or BUCKETS, BUCKETS // 2), ["term", "bucket", "total", "df"]
    src = texts.select("tmult", "text")
    seen = cut_lineage(src.mapInArrow(first, "term string, bucket int, total long, df long"))
    some = seen.where("term is not null").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    least = 0
    if max_features is not None:
        last = some.select("total").orderBy(F.col("total").desc()).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("t")).first()
        least = last["t"] if last["n"] == max_features else 0
    # at most BUCKETS numbers reach the driver
    may = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("total").alias("total")).where(F.col("total") >= least).select("bucket").collect()
    keep = np.zeros(BUCKETS, bool)
    keep[[r["bucket"] for r in may]] = True

    def second(batches):
        for mult, code, text, words, at, (one, two) in words_of(batches):
            one, two = keep[one], keep[two]
            at = at[two]
            for pair, (each, total, df) in enumerate((counts(code[one], text[one], mult), counts(code[at] * len(words) + code[at + 1], text[at], mult))):
                yield pa.RecordBatch.from_arrays([strings(each, words, pair), pa.array(total), pa.array(df)], names=["term", "total", "df"])

    stats = src.mapInArrow(second, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    return ranked_vocabulary(stats, n_docs, max_features, min_df)


def text_vectors(texts: DataFrame, keys: list[str], terms: list[str], stop_words: list[str] | None) -> DataFrame:
    """(keys..., tids, tfs) of the texts that have any of ``terms``: their positions there, ascending, and term counts."""
    split = [t.split(" ") for t in terms]
    words = sorted({w for t in split for w in t})
    index = {w: k for k, w in enumerate(words)}
    single = np.full(len(words) + 1, -1, np.int64)  # the last: of words in no term
    double = []
    for tid, t in enumerate(split):
        if len(t) == 1:
            single[index[t[0]]] = tid
        else:
            double.append((index[t[0]] * len(words) + index[t[1]], tid))
    double = np.array(sorted(double), np.int64).reshape(-1, 2)

    def run(batches):
        for b in batches:
            for i, j in _slices(b.column(len(keys))):
                part = b.slice(i, j - i)
                code, text, found = _kept_words(part.column(len(keys)), stop_words)
                known = pc.fill_null(pc.index_in(found, value_set=pa.array(words, pa.large_string())), len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
                code = known[code]
                at = np.flatnonzero((text[1:] == text[:-1]) & (code[1:] < len(words)) & (code[:-1] < len(words)))
                both = code[at] * len(words) + code[at + 1]
                place = np.searchsorted(double[:, 0], both)
                hit = np.flatnonzero(place < len(double))
                hit = hit[double[place[hit], 0] == both[hit]]
                one = np.flatnonzero(single[code] >= 0)
                n = len(terms)
                seen, tf = np.unique(np.concatenate((text[one] * n + single[code[one]], text[at[hit]] * n + double[place[hit], 1])), return_counts=True)
                owner = seen // max(n, 1)
                which = np.unique(owner)
                off = pa.array(np.append(np.searchsorted(owner, which), len(owner)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (seen % max(n, 1), tf)]
                out = part.select(range(len(keys))).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*out.columns, *lists], names=[*keys, "tids", "tfs"])

    fields = [texts.schema[k] for k in keys] + [T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("tids", "tfs")]
    return texts.select(*keys, "text").mapInArrow(run, T.StructType(fields))


def tfidf(tf: DataFrame, vocab: DataFrame, ids: list[str], sublinear: bool = True) -> DataFrame:
    """(ids..., term, w): L2-normalised TF-IDF weights; zero vectors have no rows."""
    tfw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    raw = (tf.join(F.broadcast(vocab.select("term", "idf")), "term")
             .select(*ids, "term", (tfw * F.col("idf")).alias("w0")))
    norm = F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy(*ids)))
    return raw.select(*ids, "term", (F.col("w0") / norm).alias("w"))


def fit_transform(docs: DataFrame, ids: list[str], max_features: int | None, min_df: int,
                  sublinear: bool = True, terms: str = "terms") -> tuple[DataFrame, DataFrame]:
    """Fit a vocabulary on ``docs`` and return (vocab, weights)."""
    tf = term_counts(docs, ids, terms)
    vocab = vocabulary(tf, document_count(docs), max_features, min_df)
    return vocab, tfidf(tf, vocab, ids, sublinear)


def fit_texts(docs: DataFrame, text_col: str, terms_fn, max_features: int | None, min_df: int,
              sublinear: bool = True, ord_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fit on ``terms_fn(text_col)`` with identical texts collapsed: (vocab, doc_text, texts, weights).

    Tokenising, counting and weighting run once per distinct text; the
    vocabulary is weighted by multiplicity (same result as counting every
    document).  ``weights`` are (th1, th2, term, w); ``doc_text`` and ``texts`` as in
    ``distinct_texts``.
    """
    doc_text, texts = distinct_texts(docs, text_col, ord_col)
    texts = cut_lineage(texts)  # read for the terms, their number and by callers
    d = texts.select("th1", "th2", "tmult", terms_fn(F.col("text")).alias("terms"))
    tf = cut_lineage(term_counts(d, ["th1", "th2", "tmult"]))
    vocab = vocabulary(tf, texts.agg(F.sum("tmult").alias("n_docs")), max_features, min_df, weight="tmult")
    return vocab, doc_text, texts, tfidf(tf, vocab, ["th1", "th2"], sublinear)


def fit_transform_texts(docs: DataFrame, ids: list[str], text_col: str, terms_fn,
                        max_features: int | None, min_df: int,
                        sublinear: bool = True) -> tuple[DataFrame, DataFrame]:
    """``fit_transform`` of ``terms_fn(text_col)`` with identical texts collapsed.

    Per-document weights come from one join of the documents with the
    distinct-text weights on the text hash.
    """
    vocab, doc_text, _, wt = fit_texts(docs.select(*ids, text_col), text_col, terms_fn, max_features, min_df, sublinear)
    # Materialised: the join below then has two plain shuffles, and AQE can
    # split the documents of a text that very many share.
    w = doc_text.select(*ids, "th1", "th2").join(cut_lineage(wt), ["th1", "th2"]).select(*ids, "term", "w")
    return vocab, w


def transform(docs: DataFrame, vocab: DataFrame, ids: list[str], sublinear: bool = True,
              terms: str = "terms") -> DataFrame:
    """Weights of new documents in an already fitted vocabulary."""
    return tfidf(term_counts(docs, ids, terms), vocab, ids, sublinear)


def cosine(wa: DataFrame, wb: DataFrame, a_ids: list[str], b_ids: list[str]) -> DataFrame:
    """Cosine of unit vectors: join on term, sum of products.

    Pairs without a shared term (including zero vectors) are absent = 0.
    """
    a = wa.select(*[F.col(c).alias(f"a_{c}") for c in a_ids], "term", F.col("w").alias("wa"))
    b = wb.select(*[F.col(c).alias(f"b_{c}") for c in b_ids], "term", F.col("w").alias("wb"))
    keys = [f"a_{c}" for c in a_ids] + [f"b_{c}" for c in b_ids]
    return a.join(b, "term").groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))

