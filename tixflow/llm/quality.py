"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are built from good and from bad labelled text.  A
text is compressed with either, in pieces of ``PIECE`` bytes so that the
dictionary stays in reach to the end of a long text; the difference of the
summed sizes, normalised by the larger sum, says which class its phrases come
from.  A logistic calibration turns
it into a probability; it also sees both compressed ratios and the length,
because the same difference means less for a text that hardly compresses or is
very short.

The dictionaries are fitted on at most ``DICT_DOCS`` labelled documents a
class of at most ``DICT_DOC_CHARS`` characters, the calibration on at most
``CALIBRATION_DOCS`` others a class, drawn by a hash of the id (documented
bounds; a score reads its whole text); of several texts of one id the least by
hash counts.  Only labels and texts are used, no other
column.

Defined results: a null text is empty; every text gets a score, the empty one
that of zero sizes; unlabelled, null-labelled and held-out rows are not learned
from; of several labels of one id the least counts; if a class has no
examples every score is the share of good labels (0.5 without labels); other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.llm.common import crc32_mod, doc_chunks, read_table

DICT_DOCS, DICT_DOC_CHARS, CALIBRATION_DOCS = 2000, 32_768, 3000
DICT_BYTES, LEVEL, PIECE = 256 << 10, 3, 16 << 10
FOLDS, HELD_OUT, KEEP = 5, 0, 0.3
_COMPRESSORS: dict[str, list] = {}


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    import zstandard
    parts = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def compressors(dicts: list[bytes]) -> list:
    import zstandard
    key = hashlib.sha256(b"\0".join(dicts)).hexdigest()
    if key not in _COMPRESSORS:
        _COMPRESSORS.clear()
        made = []
        for d in dicts:
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=z, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def features(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Columns of the calibration from sizes (bad, good dictionary) and byte lengths."""
    diff = (sizes[:, 0] - sizes[:, 1]) / np.maximum(1, sizes.max(axis=1))
    ratio = np.log(sizes / np.maximum(1, n)[:, None] + 0.01)
    return np.column_stack([np.ones(len(n)), diff, np.minimum(ratio, 1), np.log1p(n)])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a normal prior on standardised slopes."""
    mean, sd = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    z = np.column_stack([x[:, 0], (x[:, 1:] - mean) / sd])
    w = np.zeros(z.shape[1])
    eye = ridge * np.diag([1e-6] + [1.0] * (len(w) - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + eye, z.T @ (weight * (y - p)) - eye @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / sd
    return np.concatenate([[w[0] - slopes @ mean], slopes])


def _sizes(data: np.ndarray, off: np.ndarray, dicts: list[bytes]) -> np.ndarray:
    bad, good = compressors(dicts)
    out = np.zeros((len(off) - 1, 2))
    raw = data.tobytes()
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        pieces = [raw[k:min(k + PIECE, z)] for k in range(a, max(z, a + 1), PIECE)]
        out[i] = [sum(len(c.compress(t)) for t in pieces) for c in (bad, good)]
    return out


class QualityModel:
    """Two dictionaries (bad, good) and calibration weights, or a constant."""

    def __init__(self, dicts: list[bytes] | None, weights: np.ndarray | None, constant: float = 0.5):
        self.dicts, self.weights, self.constant = dicts, weights, constant

    def score(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, text hash, score) per row of ``docs``."""
        dicts, weights, constant = self.dicts, self.weights, self.constant

        def run(batches):
            for b in batches:
                for i, j, data, off in doc_chunks(b, "text"):
                    if weights is None:
                        s = np.full(j - i, constant)
                    else:
                        s = 1 / (1 + np.exp(-np.clip(features(_sizes(data, off, dicts), np.diff(off)) @ weights, -30, 30)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s)], names=["doc_id", "th", "score"])
        src = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
        return src.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, score double")


def _one_text(sample: DataFrame) -> DataFrame:
    """doc_id, y and text of one row an id, however many rows it has: the text of the least hash."""
    return sample.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("x")).select("doc_id", "y", "x.text")


def fit(docs: DataFrame, labels: DataFrame, dict_docs: int = DICT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> QualityModel:
    """Learn from labelled rows outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
             .where(crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    known = known.join(text.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = []
    for y in (0, 1):  # bounded: at most dict_docs + calibration_docs ids a class
        ids = [r["doc_id"] for r in known.where(F.col("y") == y).orderBy(order, "doc_id").limit(dict_docs + calibration_docs).collect()]
        cut = min(dict_docs, (len(ids) + 1) // 2)
        picked += [(d, y, i < cut) for i, d in enumerate(ids)]
    n = {y: sum(1 for p in picked if p[1] == y) for y in (0, 1)}
    if min(n.values()) < 2:
        shares = known.agg(F.avg("y").alias("good")).first()["good"]
        return QualityModel(None, None, 0.5 if shares is None else float(shares))
    spark = docs.sparkSession
    sample = text.join(F.broadcast(spark.createDataFrame(picked, "doc_id long, y int, for_dict boolean")), "doc_id")
    base = _one_text(sample.where(F.col("for_dict") & (F.char_length("text") <= DICT_DOC_CHARS))).collect()
    base.sort(key=lambda r: (r["doc_id"], r["text"]))
    dicts = [build_dictionary([r["text"].encode() for r in base if r["y"] == y]) for y in (0, 1)]
    if not all(len(d) >= 8 for d in dicts):
        return QualityModel(None, None, n[1] / sum(n.values()))

    def run(batches):
        for b in batches:
            for i, j, data, off in doc_chunks(b, "text"):
                s = _sizes(data, off, dicts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(np.diff(off))], names=["y", "bad", "good", "n"])
    got = _one_text(sample.where(~F.col("for_dict"))).select("y", "text").mapInArrow(run, "y int, bad double, good double, n long").collect()
    got.sort(key=lambda r: tuple(r))
    m = np.array([tuple(r) for r in got], float).reshape(-1, 4)
    # classes are drawn up to the same number; weights restore how often they occur
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = np.array([total[y] / max(1, (m[:, 0] == y).sum()) for y in (0, 1)])[m[:, 0].astype(int)]
    w = calibrate(features(m[:, 1:3], m[:, 3]), m[:, 0], each / each.mean() if len(each) else each)
    return QualityModel(dicts, w)


def reject_low_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """``docs`` without the documents whose score is below ``keep``; all columns stay."""
    low = fit(docs, labels).score(docs).where(F.col("score") < keep).select(F.col("doc_id").alias("low_id"), F.col("th").alias("low_th")).distinct()
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(low, docs["doc_id"].cast("long").eqNullSafe(low["low_id"]) & (th == low["low_th"]), "left_anti")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    s = fit(docs, read_table(spark, sf_dir, "labels")).score(docs)
    return s.select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
