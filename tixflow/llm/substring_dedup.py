"""Substring dedup by relative Lempel-Ziv parsing (operator 8).

Reference blocks.  In every window of ``window`` words the smallest hash among
its half-length word runs is the window's anchor; neighbouring windows with the
same anchor form a block.  Equal text has equal anchors, so blocks are cut by
content alone.  All blocks of all documents are indexed by (anchor, block
hash), and the index keeps each block's first place: its least document, and
the least word number there.

Parsing.  A document is read from left to right against the index.  A block
whose first place is in an earlier document opens a factor, a copy of words of
that document; the factor greedily takes every next block that goes on at the
same distance in the same document.

Factor boundaries.  Where a copy begins or ends inside a block, the block as a
whole is no copy, but shares its anchor with the reference's block.  Such blocks
are read window by window against the windows of all blocks with that
anchor; windows found lengthen the factor beside them, or make a factor of
their own.  So a factor is as long as its reference allows, and its words are
duplicates if it has ``window`` words or more.  The result is exact: it equals
comparing all windows with all windows.

The index holds one row per block (about one per ``window / 4`` words), is
pre-aggregated before it is shuffled, and no group of equal blocks is ever
gathered: only first places are.  No document's text travels to another.

Defined results: null or empty text has no words; a text shorter than the
window loses nothing; equal ids are the same document (neither is earlier);
a null id is never earlier nor later than another; repeated rows repeat the
result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.llm import kernel
from tixflow.llm.common import doc_chunks, read_table, stage

WINDOW = 50
BLOCK = "doc_id long, th long, anchor long, block long, at int, n int"
FACTOR = "struct<at:int,n:int,ref:long,ref_at:int>"
PARSED = f"doc_id long, th long, n_words long, text string, factors array<{FACTOR}>, probe_at array<int>, probe_anchor array<long>, probe_hash array<long>, n_removed long, kept_sha256 string"
FINISHED = f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<{FACTOR}>"
_FACTORS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ref", pa.int64()), ("ref_at", pa.int32())]))


def anchors(h: np.ndarray, wo: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and anchor position of every window that lies in one text.

    The anchor is the leftmost position with the smallest hash of ``window //
    2`` words inside the window.
    """
    half = window // 2
    g = kernel.grams(h, half)
    span = window - half + 1
    if len(g) < span:
        e = np.zeros(0, np.int64)
        return e, e, g
    at, width = np.arange(len(g)), 1
    while width * 2 <= span:
        a, b = at[:len(at) - width], at[width:]
        at = np.where(g[b] < g[a], b, a)
        width *= 2
    m = len(g) - span + 1
    a, b = at[:m], at[span - width:span - width + m]
    at = np.where(g[b] < g[a], b, a)
    owner = kernel.text_of(wo, len(h))
    ok = owner[:m] == owner[window - 1:window - 1 + m]
    return np.flatnonzero(ok), at[ok], g


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def blocks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every block of every text (BLOCK): n windows from word ``at`` on."""
    def run(batches):
        for b in batches:
            ids, th = b.column(0), b.column(1)
            for i, _, data, off in doc_chunks(b, "text"):
                h, _, _, wo = kernel.words(data, off)
                s, p, g = anchors(h, wo, window)
                if not len(s):
                    continue
                new = np.ones(len(s), bool)
                # the same anchor position in one text; the next text's anchors lie further on
                new[1:] = p[1:] != p[:-1]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(s)) - 1
                a, z = s[first], s[last]
                doc = np.searchsorted(wo, a, side="right") - 1
                row = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), th.take(row), _signed(g[p[first]]), _signed(kernel.span_hash(h, a, z + window)),
                     pa.array((a - wo[doc]).astype(np.int32)), pa.array((z - a + 1).astype(np.int32))],
                    names=["doc_id", "th", "anchor", "block", "at", "n"])
    return docs.mapInArrow(run, BLOCK)


def _kept(text: bytes, mask: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(compress(text.split(), mask.tolist()))).hexdigest()


def factorise(copies: list[dict]) -> list[dict]:
    """Maximal factors of one text from copied stretches (at, n words, ref document, ref_at).

    Left to right, a factor takes every stretch that meets it at the same
    distance in the same reference document.
    """
    out, open_ = [], {}
    for c in sorted(copies, key=lambda c: (c["at"], c["ref"], c["ref_at"])):
        line = (c["ref"], c["ref_at"] - c["at"])
        f = open_.get(line)
        if f is not None and c["at"] <= f["at"] + f["n"]:
            f["n"] = max(f["n"], c["at"] + c["n"] - f["at"])
        else:
            open_[line] = f = dict(c)
            out.append(f)
    return out


def _remove(text: bytes, n: int, factors: list[dict], window: int) -> tuple[int, str]:
    """Words removed, and the digest of those kept."""
    mask = np.ones(n, bool)
    for f in factors:
        if f["n"] >= window:
            mask[f["at"]:f["at"] + f["n"]] = False
    return int(n - mask.sum()), _kept(text, mask)


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Factors of whole copied blocks; the windows of blocks at their boundaries (PARSED).

    ``docs`` has the arrays ``copied`` (at, n, ref, ref_at) and ``probed`` (at, n).
    Texts without boundary blocks are finished here and keep no text.
    """
    def run(batches):
        for b in batches:
            ids, th = b.column(0), b.column(1)
            copied, probed = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("copied", "probed"))
            for i, j, data, off in doc_chunks(b, "text"):
                h, _, _, wo = kernel.words(data, off)
                out = []
                for d in range(j - i):
                    x = h[wo[d]:wo[d + 1]]
                    n, raw = len(x), data[off[d]:off[d + 1]].tobytes()
                    factors = factorise([{**c, "n": c["n"] + window - 1} for c in copied[i + d] or ()])
                    if probed[i + d]:
                        s, p, g = anchors(x, np.array([0, n]), window)
                        at = np.unique(np.concatenate([np.arange(c["at"], c["at"] + c["n"]) for c in probed[i + d]]))
                        w = kernel.grams(x, window)
                        out.append((n, raw.decode(), factors, at.tolist(), g[p[at]].view(np.int64).tolist(), w[at].view(np.int64).tolist(), None, None))
                    else:
                        out.append((n, None, factors, None, None, None, *_remove(raw, n, factors, window)))
                types = [pa.int64(), pa.string(), _FACTORS, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), th.slice(i, j - i), *cols], names=["doc_id", "th", "n_words", "text", "factors", "probe_at", "probe_anchor", "probe_hash", "n_removed", "kept_sha256"])
    return docs.mapInArrow(run, PARSED)


def finish(parsed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Lengthen the factors by the found windows (array ``found`` of at, ref, ref_at) and remove them."""
    def run(batches):
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n_words", "text", "factors", "found")}
            out = []
            for n, text, factors, found in zip(*cols.values(), strict=True):
                factors = factorise(factors + [{**f, "n": window} for f in found or ()])
                out.append((*_remove(text.encode(), n, factors, window), factors))
            gone, sums, factors = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols["n_words"], pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(factors, _FACTORS)],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])
    return parsed.select("doc_id", "n_words", "text", "factors", "found").mapInArrow(run, FINISHED)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the factors per document."""
    # rows of equal id and text are the same document; th tells texts of one id apart
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # a null id is nobody's reference, so the first place is among the others
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "at")))
    occ = stage(blocks(src, window))
    index = stage(occ.groupBy("anchor", "block").agg(place.alias("first"), F.max("doc_id").alias("last")))
    shared = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_blocks")).where("n_blocks > 1").select("anchor", F.lit(True).alias("shared"))
    # blocks of one document only, whose anchor no other block has, say nothing
    index = stage(index.join(stage(shared), "anchor", "left").where("shared or first.doc_id < last")
                  .select("anchor", "block", F.col("first.doc_id").alias("ref"), F.col("first.at").alias("ref_at"), "shared"))
    acts = (occ.join(index, ["anchor", "block"])
            .select("doc_id", "th", "at", "n", "ref", "ref_at", F.coalesce(F.col("ref") < F.col("doc_id"), F.lit(False)).alias("copied"), "shared"))
    acts = (acts.where("copied or shared").groupBy("doc_id", "th")  # bounded by one document's blocks
            .agg(F.collect_set(F.when(F.col("copied"), F.struct("at", "n", "ref", "ref_at"))).alias("copied"), F.collect_set(F.when(~F.col("copied"), F.struct("at", "n"))).alias("probed")))
    k = acts.select(F.col("doc_id").alias("k1"), F.col("th").alias("k2"), "copied", "probed")
    joined = src.join(k, src.doc_id.eqNullSafe(k.k1) & (src.th == k.k2), "left").select("doc_id", "th", "text", "copied", "probed")
    parsed = stage(parse(joined, window))

    probes = parsed.where("probe_at is not null")
    wins = probes.select("doc_id", "th", F.explode(F.arrays_zip("probe_at", "probe_anchor", "probe_hash")).alias("w")).select("doc_id", "th", F.col("w.probe_at").alias("at"), F.col("w.probe_anchor").alias("anchor"), F.col("w.probe_hash").alias("hash"))
    firsts = stage(wins.groupBy("anchor", "hash").agg(place.alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
                   .select("anchor", "hash", F.col("first.doc_id").alias("ref"), F.col("first.at").alias("ref_at")))
    found = (wins.join(firsts, ["anchor", "hash"]).where(F.col("ref") < F.col("doc_id"))
             .groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "ref", "ref_at")).alias("found"))
             .select(F.col("doc_id").alias("k1"), F.col("th").alias("k2"), "found"))
    rest = probes.join(found, probes.doc_id.eqNullSafe(found.k1) & (probes.th == found.k2), "left")
    done = parsed.where("probe_at is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "factors")
    return done.unionByName(finish(rest, window))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
