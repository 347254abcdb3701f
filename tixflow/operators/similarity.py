"""Thresholded cosine self-join (P1) and similar-document search (P20).

All-pairs cosine is a theta join; it is re-expressed over tiles of vectors:

1. Documents whose in-vocabulary term counts are equal have equal vectors;
   they collapse to one vector with a multiplicity (a ``groupBy`` on a
   128-bit hash of the sparse count vector, partial-combined map-side, so a
   text repeated across a third of the rows is one row after the map side).
2. L2 prefix filter (Bayardo et al., WWW 2007): order each vector's terms by
   ascending document frequency and index only the prefix whose remaining
   suffix norm is still >= t.  Any pair with cosine >= t shares a prefix term,
   so only vectors on one posting list have to meet.
3. Every posting list is cut into tiles of at most about ``TILE`` vectors and
   each pair of tiles is one group, so no task holds a whole list however
   frequent its term is.  Rows are sent as often as their list has tiles, so
   tiles are large and rows are packed: term ids of two bytes beside term
   counts of two, or weights of eight where counts are not known.
4. With a vocabulary of at most ``max_features`` terms the lists of dense
   vectors overlap so much that their squares add up to more than the square
   of the number of vectors.  Then all vectors are one list (counted, not
   guessed), which is less work for the same result.
5. A group puts the vectors of a tile beside their like and scores them by
   matrix products of ``CHUNK`` vectors a side, on the terms that both chunks
   have.  Left out are vectors that cannot reach the threshold with the largest
   weights of the other chunk, and, after a third of the terms, those that
   cannot with what is left (largest weights, or norms).  These are bounds, with
   a margin above the error of single precision; near the threshold, and for
   every similarity returned, products are made again in double precision.
6. Pairs that reach the threshold leave the group as they are found.  Whoever
   only needs neighbour masses and connected vectors gets ``links`` instead:
   rows in proportion to the vectors, however many pairs there are.

Per-vector windows are bounded by the vocabulary size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tixflow.operators import textfeat
from tixflow.session import cut_lineage

SIM_DECIMALS = 9
TILE, LEAST_TILE = 65_536, 1024  # vectors a side of a scored pair of tiles: at most, and while there are few
FEW = 1 << 17  # vectors that are cut into 16 tiles; more are sent less often
CHUNK = 512  # vectors a side of one matrix product
BATCH = 1 << 16  # pairs in a returned batch, about


def vector_hash(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("tixflow"), key)


def collapse_vectors(per: DataFrame, keys: list[str], ord_col: str, mult_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct non-zero count vectors.

    ``per``: (keys..., ord_col, mult_col, tids, tfs) of rows that each stand
    for ``mult_col`` documents (distinct texts).  Returns ``members``
    (keys..., h1, h2) and ``vectors`` (h1, h2, vid, mult, tids, tfs) where
    ``vid`` is the smallest ``ord_col`` of the vector's rows and ``mult`` their
    summed multiplicity.
    """
    key = F.struct("tids", "tfs")
    h1, h2 = vector_hash(key)
    per = cut_lineage(per.select(*keys, ord_col, mult_col, key.alias("key"), h1.alias("h1"), h2.alias("h2")))
    vectors = per.groupBy("h1", "h2").agg(
        F.min(ord_col).alias("vid"), F.sum(mult_col).alias("mult"), F.first("key").alias("key"))
    return per.select(*keys, "h1", "h2"), vectors.select("h1", "h2", "vid", "mult", "key.tids", "key.tfs")


def unit_weights(vectors: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """(vid, term, df, w) of the distinct vectors (L2 normalised TF-IDF); ``vocab`` has the position ``tid`` of each term."""
    ex = vectors.select("vid", F.explode(F.arrays_zip("tids", "tfs")).alias("e")).select("vid", F.col("e.tids").alias("tid"), F.col("e.tfs").alias("tf"))
    ex = ex.join(F.broadcast(vocab.select("tid", "term")), "tid").select("vid", "term", "tf")
    w = textfeat.tfidf(ex, vocab, ["vid"], sublinear)
    return w.join(F.broadcast(vocab.select("term", "df")), "term")


def _weights(size: np.ndarray, tids: np.ndarray, vals: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    """Weights of vectors of ``size`` terms each: ``vals``, or from term counts the unit vectors of (1 + ln tf) * idf."""
    if idf is None or not len(tids):
        return vals.astype(np.float64)
    w = (1.0 + np.log(vals.astype(np.float64))) * idf[tids]
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, np.cumsum(size) - size)), size)


def _packed(vec: DataFrame, limit: float, n_terms: int, idf: np.ndarray | None, most: int, margin: float = 1e-6) -> DataFrame:
    """(vid, mult, pre, row): the term ids of the L2 prefix, and the vector packed."""
    kind = _packing(n_terms, idf, most)
    least = max(limit - margin, 0.0) ** 2
    val = "ws" if idf is None else "tfs"

    def run(batches):
        for b in batches:
            tids, vals = b.column(2), b.column(3)
            size = tids.value_lengths().to_numpy().astype(np.int64)
            t, v = tids.flatten().to_numpy(), vals.flatten().to_numpy()
            to = np.cumsum(size)
            w = _weights(size, t, v, idf)
            acc = np.concatenate(([0.0], np.cumsum(w * w)))
            tail = np.repeat(acc[to], size) - acc[:-1]  # squared norm of what follows and includes each term
            first = np.zeros(len(t), bool)
            first[(to - size)[size > 0]] = True
            pre = (tail >= least) | first
            rows = np.empty(len(t), kind)
            rows["t"], rows["v"] = t, v
            ends = np.concatenate(([0], to))
            row = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends * kind.itemsize), pa.py_buffer(rows)]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pre)))[ends].astype(np.int32)), pa.array(t[pre].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, row], names=["vid", "mult", "pre", "row"])

    return vec.select("vid", "mult", "tids", val).mapInArrow(run, "vid long, mult long, pre array<int>, row binary")


def _packing(n_terms: int, idf: np.ndarray | None, most: int) -> np.dtype:
    small = lambda n: "<u2" if n < 1 << 16 else "<u4"
    return np.dtype([("t", small(n_terms)), ("v", "<f8" if idf is None else small(most))])


def _tile_pairs(lists: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Rows (list, i, j, at, vid, ...): every row of a list once for each pair of tiles that it is in.

    ``sizes``: (list, k), the number of tiles of each list; bounded by the
    vocabulary and broadcast.
    """
    d = lists.join(F.broadcast(sizes), "list")
    d = d.withColumn("at", F.pmod(F.xxhash64("vid", "list"), F.col("k")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)))
    return d.withColumn("i", F.least("at", "_o")).withColumn("j", F.greatest("at", "_o")).drop("_o", "k")


class _Side:
    """The vectors of a tile, each beside its like, and its chunks."""

    def __init__(self, vid: np.ndarray, mult: np.ndarray, pre: pa.Array, row: pa.Array, n_terms: int, kind: np.dtype, idf: np.ndarray | None, chunk: int):
        self.n_terms, self.chunk = n_terms, chunk
        size = pc.binary_length(row).to_numpy().astype(np.int64) // kind.itemsize
        flat = np.frombuffer(row.buffers()[2], kind, int(size.sum()), row.buffers()[1] and int(np.frombuffer(row.buffers()[1], np.int32, 1, 4 * row.offset)[0]))
        self.t, self.at, self.size = flat["t"].astype(np.int32), np.cumsum(size) - size, size
        self.w = _weights(size, self.t, flat["v"], idf)
        self.order = np.arange(len(vid))
        self.order = self._beside()
        self.vid, self.mult, self.pre = vid[self.order], mult[self.order], pre.take(pa.array(self.order))
        self.starts = list(range(0, len(vid), chunk))
        self.top, self.total = np.zeros((2, len(self.starts), n_terms), np.float32)  # largest weights and sums of a chunk
        for k, p in enumerate(self.starts):
            x = self.dense(p, p + chunk)
            self.top[k], self.total[k] = x.max(axis=0, initial=0), x.sum(axis=0)
        self.cols = [np.flatnonzero(x) for x in self.top]  # terms of a chunk

    def part(self, k: int) -> np.ndarray:
        """The weights of a chunk, a row for each of its terms."""
        return np.ascontiguousarray(self.dense(self.starts[k], self.starts[k] + self.chunk)[:, self.cols[k]].T)

    def dense(self, a: int, b: int, dtype: type = np.float32) -> np.ndarray:
        """Rows a to b as a matrix."""
        rows = self.order[a:b]
        size = self.size[rows]
        place = np.arange(size.sum()) + np.repeat(self.at[rows] - np.cumsum(size) + size, size)
        x = np.zeros((len(rows), self.n_terms), dtype)
        x[np.repeat(np.arange(len(rows)), size), self.t[place]] = self.w[place]
        return x

    def _beside(self) -> np.ndarray:
        """Rows in the order of the centres that they are nearest to; any order is right."""
        n = len(self.order)
        k = min(32, n // self.chunk)
        if k < 2:
            return self.order
        some = np.linspace(0, n - 1, min(n, 4096)).astype(np.int64)
        self.order = some
        x = self.dense(0, len(some))
        self.order = np.arange(n)
        centre = x[np.linspace(0, len(some) - 1, k).astype(np.int64)]
        for _ in range(3):
            own = (x @ centre.T).argmax(axis=1)
            for c in np.unique(own):
                mean = x[own == c].sum(axis=0)
                centre[c] = mean / max(float(np.linalg.norm(mean)), 1e-30)
        like, chain = centre @ centre.T, [0]
        while len(chain) < k:
            like[:, chain[-1]] = -1
            chain.append(int(like[chain[-1]].argmax()))
        rank = np.empty(k, np.int64)
        rank[chain] = np.arange(k)
        sims = np.concatenate([self.dense(p, p + 2048) @ centre.T for p in range(0, n, 2048)])
        return np.lexsort((sims.max(axis=1), rank[sims.argmax(axis=1)]))

    def prefixes(self, rows: np.ndarray) -> np.ndarray:
        """Which terms are in the prefixes of ``rows``."""
        p = self.pre.take(pa.array(rows))
        x = np.zeros((len(rows), self.n_terms), bool)
        x[np.repeat(np.arange(len(rows)), p.value_lengths().to_numpy()), p.flatten().to_numpy()] = True
        return x


def _some(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns ``of`` of x, or all of them where leaving out the rest costs more than it saves; which ones."""
    n = x.shape[1]
    return (x, np.arange(n)) if 4 * len(of) > 3 * n else (x.take(of, axis=1), of)


def _within(x: np.ndarray, y: np.ndarray, top_x: np.ndarray, top_y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of x, vectors of y and their products; all pairs of ``least`` and more are among them.

    x and y have a row for each term, those with the largest products first, and
    ``top_x`` and ``top_y`` their largest weights.
    """
    k = len(x) // 3
    sims = x[:k].T @ y[:k]
    x, y = x[k:], y[k:]
    left = np.minimum((top_y[k:] @ x)[:, None], (top_x[k:] @ y)[None, :])
    np.minimum(left, np.sqrt(np.einsum("ij,ij->j", x, x))[:, None] * np.sqrt(np.einsum("ij,ij->j", y, y))[None, :], out=left)
    left += sims
    may = left >= least
    i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(i):
        return i, j, np.zeros((0, 0), np.float32)
    (x, i), (y, j) = _some(x, i), _some(y, j)
    return i, j, (sims if sims.shape == (len(i), len(j)) else sims.take(i, axis=0).take(j, axis=1)) + x.T @ y


def _near_pairs(left: _Side, right: _Side, limit: float, n_terms: int, exact: bool, linked) -> Iterator[tuple]:
    """(first row, first row there, rows, rows there, which are near, their similarity if ``exact``) of pairs of chunks.

    ``linked`` decides on similarities in double precision.
    """
    loose = 1e-4 + n_terms * 2.0 ** -24  # above the error of a product of unit vectors in single precision
    same, least = left is right, limit - loose
    parts = [right.part(k) for k in range(len(right.starts))]
    to_left = [y.T @ left.top[:, c].T for y, c in zip(parts, right.cols, strict=True)]  # bounds on the similarity to any vector of a chunk
    for p, a in enumerate(left.starts):
        here, x64 = parts[p] if same else left.part(p), None
        to_right = here.T @ right.top[:, left.cols[p]].T
        for q in range(p if same else 0, len(right.starts)):
            b = right.starts[q]
            i, j = np.flatnonzero(to_right[:, q] >= least), np.flatnonzero(to_left[q][:, p] >= least)
            if not len(i) or not len(j):
                continue
            both = np.flatnonzero((left.top[p] > 0) & (right.top[q] > 0))
            both = both[np.argsort(-left.total[p, both] * right.total[q, both])]
            x, i = _some(here.take(np.searchsorted(left.cols[p], both), axis=0), i)
            y, j = _some(parts[q].take(np.searchsorted(right.cols[q], both), axis=0), j)
            oi, oj, sims = _within(x, y, left.top[p, both], right.top[q, both], least)
            i, j = i[oi], j[oj]
            if not len(i):
                continue
            near = sims >= least
            if same and p == q:
                near &= i[:, None] < j[None, :]
            ask = near if exact else near & (sims < limit + loose)
            u, v = np.nonzero(ask)
            sim = np.zeros(0)
            if len(u):
                x64 = left.dense(a, a + left.chunk, np.float64) if x64 is None else x64
                x, y = x64[:, both], right.dense(b, b + right.chunk, np.float64)[:, both]
                if 50 * len(u) > ask.size:
                    sim = (x[i] @ y[j].T)[u, v]
                else:
                    sim = np.concatenate([np.einsum("ij,ij->i", x[i[u[k:k + 4096]]], y[j[v[k:k + 4096]]]) for k in range(0, len(u), 4096)])
                ok = linked(sim)
                near[u[~ok], v[~ok]] = False
                sim = sim[ok]
            if near.any():
                yield a, b, i, j, near, sim


class _Links:
    """Neighbour masses, and enough of the pairs to know what is connected.

    A row with a mass of ``least`` so far is dense for good.  Pairs of dense rows only
    count while they join what is not joined yet; all other pairs are kept, of a row
    less than ``least`` of them.
    """

    def __init__(self, mult: np.ndarray, least: int):
        self.mult, self.least = mult, least
        self.mass, self.label = np.zeros(len(mult), np.int64), np.arange(len(mult))
        self.edges, self.wait = [], []

    def add(self, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> None:
        self.mass[i] += near @ self.mult[j]
        self.mass[j] += self.mult[i] @ near
        dense_i, dense_j = (self.mult[k] + self.mass[k] >= self.least for k in (i, j))
        u, v = np.nonzero(near & ~(dense_i[:, None] & dense_j[None, :]))
        self.wait.append((i[u], j[v]))
        u, v = np.nonzero(near & (dense_i[:, None] & dense_j[None, :]) & (self.label[i][:, None] != self.label[j][None, :]))
        self._join(i[u], j[v])

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            _, first = np.unique(np.maximum(a, b), return_index=True)
            self.edges.append((u[first], v[first]))
            to = np.arange(len(self.label))
            to[np.maximum(a, b)[first]] = np.minimum(a, b)[first]
            while True:
                on = to[to]
                if (on == to).all():
                    break
                to = on
            self.label = to[self.label]

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs to keep."""
        u, v = (np.concatenate(x) for x in zip(*self.wait, strict=True)) if self.wait else (np.zeros(0, np.int64),) * 2
        dense = self.mult + self.mass >= self.least
        both = dense[u] & dense[v]
        self._join(u[both], v[both])
        self.edges.append((u[~both], v[~both]))
        return tuple(np.concatenate(x) for x in zip(*self.edges, strict=True))


def _score_tiles(theta: float, n_terms: int, chunk: int, idf: np.ndarray | None, most: int, links: int | None, margin: float = 1e-9):
    """Function over one pair of tiles: (a, b, sim) of vectors at most ``theta`` apart, a < b; with ``links`` its links."""
    kind, limit = _packing(n_terms, idf, most), math.cos(theta) - margin
    bound = round(math.cos(theta) + 1e-9, SIM_DECIMALS)
    linked = (lambda sim: sim >= limit) if links is None else (lambda sim: np.round(sim, SIM_DECIMALS) >= bound)

    def near(key: tuple, t: pa.Table):
        lst, i, j = (k.as_py() for k in key)
        at = t.column("at").to_numpy()

        def side(n: int) -> _Side:
            part = t.filter(pa.array(at == n))
            return _Side(part.column("vid").to_numpy(), part.column("mult").to_numpy(), part.column("pre").combine_chunks(), part.column("row").combine_chunks(), n_terms, kind, idf, chunk)

        left = side(i)
        right = left if i == j else side(j)
        for a, b, u, v, hit, sim in _near_pairs(left, right, limit, n_terms, links is None, linked):
            if lst >= 0:  # on several lists: the first shared prefix term returns the pair
                x, y = np.nonzero(hit)
                pa_, pb = left.prefixes(a + u), right.prefixes(b + v)
                first = np.concatenate([(pa_[x[k:k + 4096]] & pb[y[k:k + 4096]]).argmax(axis=1) == lst for k in range(0, len(x), 4096)])
                hit[x[~first], y[~first]] = False
                sim = sim[first] if links is None else sim
            yield left, right, a + u, b + v, hit, sim

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            a, b, sim = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim)], names=["a", "b", "sim"])

        for left, right, u, v, hit, sim in near(key, pa.Table.from_batches(batches)):
            x, y = np.nonzero(hit)
            held.append((left.vid[u[x]], right.vid[v[y]], sim))
            n += len(x)
            if n > BATCH:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    def joined(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, vid = None, None
        for left, right, u, v, hit, _ in near(key, pa.Table.from_batches(batches)):
            if got is None:
                vid = left.vid if left is right else np.concatenate((left.vid, right.vid))
                got = _Links(left.mult if left is right else np.concatenate((left.mult, right.mult)), links)
            got.add(u, v if left is right else v + len(left.vid), hit)
        if got is None:
            return
        u, v = got.end()
        some = np.flatnonzero(got.mass)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(vid[some]), none, pa.array(got.mass[some])], names=["a", "b", "mass"])
        yield pa.RecordBatch.from_arrays([pa.array(vid[u]), pa.array(vid[v]), pa.nulls(len(u), pa.int64())], names=["a", "b", "mass"])

    return pairs if links is None else joined


def near_vectors(vec: DataFrame, theta: float, tile: int = TILE, idf: np.ndarray | None = None, links: int | None = None) -> DataFrame:
    """(a, b, sim) of the pairs of ``vec`` (vid, mult, tids, ws; staged) at most ``theta`` apart (an angle).

    With ``idf`` (by term id) ``vec`` has term counts ``tfs`` in place of ``ws``.

    With ``links`` (a, b, mass): rows (a, null, mass), whose masses add up to the
    multiplicity of all neighbours of ``a``, and pairs (a, b, null) of neighbours:
    all pairs of a vector whose own and neighbours' multiplicities are below
    ``links``, and between the others enough to connect the same vectors as all
    pairs do.  See the module's text for the tiles.
    """
    # one row each reaches the driver
    total = vec.agg(F.count(F.lit(1)).alias("n"), (F.max(F.get("tids", F.size("tids") - 1)) + 1).alias("terms"),
                    (F.lit(0) if idf is None else F.max(F.array_max("tfs"))).alias("most")).first()
    n, n_terms, most = total["n"], total["terms"] or 1, total["most"] or 0
    packed = _packed(vec, math.cos(theta), n_terms, idf, most)
    posting = cut_lineage(packed.select(F.explode("pre").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("m")))
    work = posting.agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("s")).first()["s"] or 0.0
    # Rows are sent once for each tile: as few tiles as keep all cores busy, and more only where a tile would be too large for a task.
    some = 16 if n <= FEW else max(8, math.isqrt(6 * vec.sparkSession.sparkContext.defaultParallelism))
    tile = min(tile, max(LEAST_TILE, -(-n // some)))
    if work >= float(n) ** 2:
        k = -(-n // tile) or 1
        lists = packed.select(F.lit(-1).alias("list"), "vid", "mult", "row", F.array().cast("array<int>").alias("pre"))
        sizes = vec.sparkSession.range(1).select(F.lit(-1).alias("list"), F.lit(k).cast("long").alias("k"))
    else:
        lists = packed.select(F.explode("pre").alias("list"), "vid", "mult", "row", "pre")
        sizes = posting.select("list", F.ceil(F.col("m") / tile).alias("k"))
    groups = _tile_pairs(lists, sizes, tile)
    if work >= float(n) ** 2 and n > FEW:  # few and large groups: one a task, nearly always
        groups = groups.repartition(2 * k * (k + 1), "list", "i", "j")
    groups = groups.groupBy("list", "i", "j")
    return groups.applyInArrow(_score_tiles(theta, n_terms, CHUNK, idf, most, links), f"a long, b long, {'sim double' if links is None else 'mass long'}")


def similar_pairs(vec: DataFrame, threshold: float, tile: int = TILE, idf: np.ndarray | None = None) -> DataFrame:
    """(a, b, sim) with a < b and round(cosine, 9) >= threshold; ``vec`` as in ``near_vectors``."""
    near = near_vectors(vec, math.acos(max(threshold - 1e-9, -1.0)), tile, idf)
    sims = near.select("a", "b", F.round("sim", SIM_DECIMALS).alias("sim"))
    return sims.where(F.col("sim") >= F.lit(round(threshold, SIM_DECIMALS)))


def find_similar(doc_text: DataFrame, texts: DataFrame, text_w: DataFrame, query_w: DataFrame,
                 order_col: str, top_n: int = 10) -> DataFrame:
    """P20: top ``top_n`` documents by cosine to one query vector.

    ``doc_text``, ``texts`` (with ``tord``) and ``text_w`` as from
    ``textfeat.fit_texts``; ``query_w``: (term, w) of the query, bounded by its
    length and broadcast.  Texts are scored, not documents: the best documents
    belong to the best ``top_n`` texts (by score, then earliest document), whose
    documents are then looked up by a broadcast of at most ``top_n`` rows.
    Documents sharing no term score 0 and are still eligible, so the result
    always has ``min(top_n, n)`` rows.  Ties (scores equal to 9 decimals) go to
    the earlier row.
    """
    scores = (text_w.join(F.broadcast(query_w.select("term", F.col("w").alias("qw"))), "term")
                    .groupBy("th1", "th2").agg(F.sum(F.col("w") * F.col("qw")).alias("similarity_score")))
    best = (texts.select("th1", "th2", "tord").join(scores, ["th1", "th2"], "left")
                 .withColumn("similarity_score", F.coalesce("similarity_score", F.lit(0.0)))
                 .orderBy(F.round("similarity_score", SIM_DECIMALS).desc(), "tord").limit(top_n).drop("tord"))
    return (doc_text.join(F.broadcast(best), ["th1", "th2"])
                    .orderBy(F.round("similarity_score", SIM_DECIMALS).desc(), F.col(order_col).asc()).limit(top_n))
