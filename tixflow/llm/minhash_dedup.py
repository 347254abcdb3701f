"""MinHash near-dedup with Fast Similarity Sketching (operator 1).

Sketch.  ``t`` bins are filled in rounds.  In round ``i < t`` every shingle is
hashed to a bin and a value, and bins still empty keep the least value; in
round ``t + j`` every shingle goes to bin ``j``.  After at most ``2 t`` rounds
every bin of a non-empty set is filled, and matching bins estimate the Jaccard
similarity with Chernoff-type bounds.  Large sets finish in the first rounds.

Banding.  Bands of ``rows`` bins are hashed to buckets; with the default 48
bands of 6 bins two sets of similarity 0.8 share no bucket with probability
(1 - 0.8^6)^48 < 5e-7.

Links.  Documents with equal shingle sets are one node.  Every bucket's leader is
the member that meets most others in its buckets; each member is compared with
its leaders on the full shingle sets, and linked nodes are merged.  Comparing all
members of a bucket would cost the square of its size, so what the leaders leave
apart is searched by two facts.  Let u and v be linked, in a bucket of leader b,
and u not linked with b.  Either they share enough shingles outside b; then a
prefix filter over the members' shingles outside b, rarest first, finds them.  Or
what they share within b is enough; then both sizes are bounded by their overlaps
with b, which only members smaller than b can satisfy.  Only such pairs are
compared, so a family of near copies costs its size, and no link is lost.

Defined results: a null or empty text has no shingles and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows of equal id
are one document; a null id is kept as its own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.llm import kernel
from tixflow.llm.common import doc_chunks, read_table, stage
from tixflow.llm.graph import components

BANDS, ROWS, SIMILARITY = 48, 6, 0.8
SKETCHED = "doc_id long, th long, n_shingles long, sig1 long, sig2 long, bands array<long>"
U = np.uint64
_SEEDS = np.zeros(0, U)


def fast_sketch(v: np.ndarray, so: np.ndarray, t: int) -> np.ndarray:
    """Sketches (sets x t, 32-bit values) of the sets v[so[i]:so[i+1]]; empty sets stay all ones."""
    global _SEEDS
    if len(_SEEDS) < 2 * t:
        _SEEDS = np.arange(1, 2 * t + 1, dtype=U) * U(0x9FB21C651E98DF25)
    n = len(so) - 1
    out = np.full(n * t, 0xFFFFFFFF, np.uint32)
    empty = np.ones(n * t, bool)
    owner = np.repeat(np.arange(n), np.diff(so)) * t
    for i in range(2 * t):
        if not len(v):
            break
        h = kernel.mix(v ^ _SEEDS[i])
        slot = owner + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else owner + (i - t)
        ok = empty[slot]
        slot = slot[ok]
        np.minimum.at(out, slot, (h[ok] & U(0xFFFFFFFF)).astype(np.uint32))
        empty[slot] = False
        if i % 4 == 0 or i < 4 or i >= t:
            todo = empty.reshape(n, t).any(axis=1)[owner // t]
            if not todo.all():
                v, owner = v[todo], owner[todo]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sketch[:, :bands * rows].astype(U).reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xA24BAED4963EE407), (len(sketch), bands)).copy()
    for r in range(rows):
        key = kernel.mix(key ^ x[:, :, r] * U(0x9E3779B97F4A7C15)) + U(r)
    return key


def sketch(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, 128-bit set signature and band keys of every text (SKETCHED)."""
    def run(batches):
        for b in batches:
            for i, j, data, off in doc_chunks(b, "text"):
                h, _, _, wo = kernel.words(data, off, fold=True)
                v, so = kernel.shingles(h, wo, words)
                sk = fast_sketch(v, so, bands * rows)
                keys = band_keys(sk, bands, rows).view(np.int64)
                size = np.diff(so)
                a, z = kernel.mix(v), kernel.mix(v ^ U(0xD6E8FEB86659FD93))
                sums = []
                for x in (a, z):
                    acc = np.zeros(len(v) + 1, U)
                    np.cumsum(x, out=acc[1:])
                    sums.append(pa.array((acc[so[1:]] - acc[so[:-1]]).view(np.int64)))
                n_keys = np.where(size > 0, bands, 0)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_keys))).astype(np.int32)), pa.array(keys[size > 0].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(size), *sums, flat], names=[f.split()[0] for f in SKETCHED.split(", ")])
    return docs.mapInArrow(run, SKETCHED)


def _sets(col: pa.Array, words: int) -> list[np.ndarray]:
    out = []
    for _, _, data, off in doc_chunks(pa.RecordBatch.from_arrays([col], names=["text"]), "text"):
        h, _, _, wo = kernel.words(data, off, fold=True)
        v, so = kernel.shingles(h, wo, words)
        out += [v[so[d]:so[d + 1]] for d in range(len(so) - 1)]
    return out


def overlaps(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, na, nb, both): set sizes and intersection size of every pair, on the full sets."""
    def run(batches):
        for x in batches:
            for i in range(0, len(x), 128):
                part = x.slice(i, 128)
                na, nb, both = [], [], []
                for p, q in zip(_sets(part.column(2), words), _sets(part.column(3), words), strict=True):
                    na.append(len(p))
                    nb.append(len(q))
                    both.append(len(np.intersect1d(p, q, assume_unique=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in (na, nb, both))], names=["a", "b", "na", "nb", "both"])
    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, na long, nb long, both long")


def outside(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, g): for every pair a row per shingle of b that a lacks; g stands for a and the shingle."""
    def run(batches):
        for x in batches:
            for i in range(0, len(x), 128):
                part = x.slice(i, 128)
                lists = [np.setdiff1d(q, p, assume_unique=True).view(np.int64).tolist() for p, q in zip(_sets(part.column(2), words), _sets(part.column(3), words), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["a", "b", "s"])
    rows = _with_texts(pairs, texts).mapInArrow(run, "a long, b long, s array<long>")
    return rows.select("a", "b", F.explode("s").alias("s")).select("a", "b", F.xxhash64("a", "s").alias("g"))


def shared_outside(spots: DataFrame, known: DataFrame, within: float, least_size: float) -> DataFrame:
    """(a, b): members apart that may share as many shingles outside their leader as a link takes.

    A link of u and v, |u| <= |v|, needs ``within`` (|u| + |v|) common shingles, and
    at most as many as u (or v) shares with the leader lie inside it.  So
    u needs at least 2 within |u| - |u and leader| outside, and v at least
    least_size |v| - |v and leader|.  Of two lists in one order that share t
    entries, the first len - t + 1 of either share one (prefix filtering); the
    order is by rarity, so what many members share is hardly ever looked at.
    """
    spots = stage(spots)
    often = stage(spots.groupBy("g").agg(F.count(F.lit(1)).alias("c")))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("c", "g"))  # one member's shingles
    need = lambda share: F.greatest(F.lit(1), F.ceil(share * F.col("nb") - F.col("both") - 1e-6))
    one = known.select("a", "b", "nb", "both", "comp")
    rows = spots.join(often, "g").withColumn("r", rank).where("c > 1").join(one, ["a", "b"])
    rows = rows.where(F.col("r") <= F.col("nb") - F.col("both") - need(F.lit(least_size)) + 1)
    rows = stage(rows.select("g", "b", "nb", "both", "comp", "r", (F.col("r") <= F.col("nb") - F.col("both") - need(F.lit(2 * within)) + 1).alias("small")))
    x = rows.where("small").select("g", F.col("b").alias("u"), F.col("nb").alias("nu"), F.col("both").alias("iu"), F.col("comp").alias("cu"), F.col("r").alias("ru"))
    y = rows.select("g", F.col("b").alias("v"), F.col("nb").alias("nv"), F.col("both").alias("iv"), F.col("comp").alias("cv"), F.col("r").alias("rv"))
    # of this very pair: what must be shared outside, and whether this shingle is early enough in both lists
    must = F.greatest(F.lit(1), F.ceil(within * (F.col("nu") + F.col("nv")) - F.least("iu", "iv") - 1e-6))
    early = F.least(F.col("nu") - F.col("iu") - F.col("ru"), F.col("nv") - F.col("iv") - F.col("rv")) + 1 >= must
    found = x.join(y, (x.g == y.g) & (F.col("nu") <= F.col("nv")) & (F.col("cu") != F.col("cv")) & early)
    return found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))  # a pair may come several times


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta"))
    y = texts.select(F.col("nid").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ta", "tb")


def _relabelled(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` (nid, comp) after the labels that ``edges`` (a, b) join are one."""
    roots = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return stage(comp.join(roots, "comp", "left").select("nid", F.coalesce("root", "comp").alias("comp")))


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (nid, comp) after the components that ``links`` (a, b) join are merged."""
    x, y = comp.select(F.col("nid").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("nid").alias("b"), F.col("comp").alias("cb"))
    edges = stage(links.join(x, "a").join(y, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    return _relabelled(comp, edges) if edges.limit(1).count() else comp


def _leaders(members: DataFrame) -> DataFrame:
    """(bucket, lead): of every bucket the member that meets most others, over all buckets.

    ``members``: (bucket, nid, c), c the bucket's size; a member is in as many buckets as there are bands, at most.
    """
    met = F.sum("c").over(Window.partitionBy("nid"))
    return members.select("bucket", "nid", met.alias("met")).groupBy("bucket").agg(F.max(F.struct("met", "nid")).alias("top")).select("bucket", F.col("top.nid").alias("lead"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id per row of ``docs``."""
    percent = round(100 * similarity)
    within = percent / (100 + percent)
    linked = (100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sketched = stage(sketch(src, words, bands, rows))
    full = sketched.where("n_shingles > 0")
    # one node per distinct set; equal sets have equal bands, so any will do
    nodes = stage(full.groupBy("sig1", "sig2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("at"), F.first("bands").alias("bands"))
                  .select(F.monotonically_increasing_id().alias("nid"), "sig1", "sig2", "least", "at", "bands"))
    entry = nodes.select("nid", F.explode("bands").alias("bucket"))
    # staged, so both sides of the join are plain shuffles and a hot bucket can be split
    shared = stage(entry.groupBy("bucket").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("bucket", "c"))
    members = stage(entry.join(shared, "bucket").select("bucket", "nid", "c"))

    used = members.select("nid").distinct().join(nodes.select("nid", "at.doc_id", "at.th"), "nid")
    u = used.select("nid", F.col("doc_id").alias("k1"), F.col("th").alias("k2"))
    # a text once per node, though its row may be repeated
    texts = stage(src.join(u, src.doc_id.eqNullSafe(u.k1) & (src.th == u.k2)).select("nid", "text").dropDuplicates(["nid"]))

    led = members.join(stage(_leaders(members)), "bucket")
    pairs = stage(led.where("lead <> nid").select(F.col("lead").alias("a"), F.col("nid").alias("b")).distinct())
    known = stage(overlaps(pairs, texts, words).withColumn("linked", linked))
    comp = _relabelled(texts.select("nid", F.col("nid").alias("comp")), known.where("linked").select("a", "b"))  # every node is its own yet

    # leaders whose members are still apart
    known = known.join(comp.select(F.col("nid").alias("b"), "comp"), "b")
    apart = known.groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("a")
    known = stage(known.join(apart, "a"))
    v = known.where("nb < na").select("a", F.col("b").alias("v"), F.col("nb").alias("nv"), F.col("both").alias("bv"), F.col("comp").alias("cv"))
    inside = (known.where("not linked").join(v, "a").where((F.col("comp") != F.col("cv")) & (F.least("both", "bv") + 1e-6 >= within * (F.col("nb") + F.col("nv"))))
              .select(F.least("b", "v").alias("a"), F.greatest("b", "v").alias("b")))
    beyond = shared_outside(outside(known, texts, words), known, within, percent / 100)
    left = stage(inside.unionByName(beyond).distinct())
    comp = merged(comp, overlaps(left, texts, words).where(linked).select("a", "b"))

    ids = stage(nodes.select("nid", "sig1", "sig2", "least").join(comp, "nid", "left").select("sig1", "sig2", "least", F.coalesce("comp", "nid").alias("comp")))
    smallest = stage(ids.groupBy("comp").agg(F.min("least").alias("component")))
    classes = stage(ids.join(smallest, "comp").select("sig1", "sig2", "component"))
    empty = sketched.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"))
    return (full.join(classes, ["sig1", "sig2"])
            .select("doc_id", "th", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).unionByName(empty))


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with the document of the least id of every group; all columns stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), words).where("doc_id <> component_id").select(F.col("doc_id").alias("_k1"), F.col("th").alias("_k2")).distinct()
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col("_k1")) & (th == F.col("_k2")), "left_anti")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(read_table(spark, sf_dir, "documents"), words=4)
    return d.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
