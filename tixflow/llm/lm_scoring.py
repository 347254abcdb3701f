"""Language-model scoring by deleted interpolation (operator 10).

A bigram model: the maximum-likelihood estimates of a word after its
predecessor, of the word alone, and a uniform floor are mixed with weights that
depend on how often the predecessor was seen (buckets by powers of two).  The
weights are learned by expectation-maximisation on held-out counts: one fold
of the training documents is deleted from the counts that the estimates use
and supplies the events.  The final estimates use all training documents.

Counting and look-up are by blocks of about ``BLOCK_BYTES`` of text, in a tree:

1. texts are packed into compressed blocks and staged;
2. every block sends its distinct n-gram hashes with its own counts, sorted
   and delta-coded, cut into ``FAN`` hash ranges; a frequent n-gram is one entry a block;
3. about ``FAN`` blocks are a node, whose counts are added up range by range; the
   sums of ``FAN`` nodes, each range cut into ``FAN`` finer ones, are added up
   by a node above, until one node is left.  So every group reads some ``FAN``
   rows and about as much as a block holds, at any size of the corpus; the rows
   of a level grow with the blocks, the levels with their logarithm;
4. the totals go back the same way, in the order asked, so no hash travels back;
5. every block looks its tokens' totals up, writes them with its documents and
   a histogram of held-out events (log probabilities in steps of 0.1);
6. the driver runs expectation-maximisation on the summed histogram, whose
   size is bounded by the steps, and the blocks' tokens are scored.

Hashes have 56 bits inside a table of all n-grams; two n-grams fall together
with probability 1e-5 even among 10^12.

Defined results: a null or empty text is its end token alone; repeated rows
count and are scored each; unseen words have count 0; without training
documents every token gets the floor; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.llm import kernel
from tixflow.llm.common import crc32_mod, doc_chunks, read_table, shuffle_width, stage

FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_BYTES = 8 << 20
FAN_BITS = 8  # FAN = 256
BITS = 56
CONTEXT_BUCKETS = 48
STEP = 0.1
ROUNDS = 60
U = np.uint64
BEGIN, END = U(0x51ED270B9F3C6A11), U(0xB5AD4ECEDA1CE2A9)
BLOCK = "block long, doc_ids array<long>, folds array<int>, sizes array<int>, texts binary"
ASKED = "gram int, node long, range long, child long, n int, keys binary, counts binary"
TOLD = "gram int, range long, child long, totals binary, n_all long, n_kept long, types long, ends long"
COUNTED = "block long, doc_ids array<long>, folds array<int>, n_tokens array<int>, totals binary, events array<struct<b:int,q2:int,q1:int,n:long>>"


def _squeeze(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed (high bytes of small numbers cost nothing)."""
    import zstandard
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b""


def _expand(raw: bytes, n: int, dtype: str) -> np.ndarray:
    import zstandard
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts of about ``block_bytes`` together (BLOCK)."""
    def run(batches):
        import zstandard
        base, k = TaskContext.get().partitionId() << 32, 0
        ids, folds, sizes, parts, held = [], [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([base + k]), pa.array([ids], pa.list_(pa.int64())), pa.array([folds], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(parts))], pa.binary())], names=["block", "doc_ids", "folds", "sizes", "texts"])
        for b in batches:
            got_ids, got_folds = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, data, off in doc_chunks(b, "text", min(block_bytes, 2 << 20)):
                ids += got_ids[i:j]
                folds += got_folds[i:j]
                sizes += np.diff(off).tolist()
                parts.append(data.tobytes())
                held += len(data)
                if held >= block_bytes:
                    yield row()
                    ids, folds, sizes, parts, held, k = [], [], [], [], 0, k + 1
        if ids:
            yield row()
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), crc32_mod(docs["doc_id"], FOLDS).cast("int").alias("fold"), docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, BLOCK)


def _tokens(texts: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (each text's words, then END), their predecessors, and token counts per text."""
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8) if sum(sizes) else np.zeros(0, np.uint8)
    off = np.concatenate(([0], np.cumsum(sizes)))
    out, counts, i, n = [], [], 0, len(sizes)
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + (2 << 20), side="right")) - 1, i + 1), n)
        h, _, _, wo = kernel.words(raw[off[i]:off[j]], off[i:j + 1] - off[i], fold=True)
        out.append(np.insert(h, wo[1:], END))
        counts.append(np.diff(wo) + 1)
        i = j
    tok, cnt = np.concatenate(out), np.concatenate(counts)
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[np.cumsum(cnt) - cnt] = BEGIN
    return tok, prev, cnt


def _keys(tok: np.ndarray, prev: np.ndarray, gram: int) -> np.ndarray:
    shift = U(64 - BITS)
    return kernel.mix(tok ^ U(0x2545F4914F6CDD1D)) >> shift if gram == 1 else kernel.mix(prev * U(0x9E3779B97F4A7C15) + kernel.mix(tok)) >> shift


def _cut(gram: int, node: int, child: int, prefix: int, bits: int, fan_bits: int, u: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted n-grams of one range, and their counts, by the ranges of ``bits`` bits in it (ASKED)."""
    first, fan = prefix << fan_bits, 1 << fan_bits
    cut = np.searchsorted(u, np.array([(first + x) << (BITS - bits) for x in range(fan + 1)], dtype=U))
    out = [(gram, node, first + x, child, z - a, _squeeze(np.diff(u[a:z], prepend=U(0))), _squeeze(counts[a:z].astype(U)))
           for x, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < z]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    cols = zip(*out, strict=True) if out else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in ASKED.split(", ")])


def ask(blocks: DataFrame, nodes: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """Every block's distinct n-grams by hash range, with its training and deleted counts (ASKED)."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                tok, prev, cnt = _tokens(r["texts"], r["sizes"])
                fold = np.repeat(np.array(r["folds"]), cnt)
                node = int(kernel.mix(np.array([r["block"]], np.int64).view(U))[0] % U(nodes))
                for gram in (1, 2):
                    u, inv = np.unique(_keys(tok, prev, gram), return_inverse=True)
                    both = np.column_stack([np.bincount(inv, fold != HELD_OUT, len(u)), np.bincount(inv, fold == DELETED, len(u))])
                    yield _cut(gram, node, r["block"], 0, fan_bits, fan_bits, u, both)
    return blocks.mapInArrow(run, ASKED)


def _added(group: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows, its distinct n-grams, where each row's are among them, and their counts."""
    rows = sorted(group.to_pylist(), key=lambda r: r["child"])
    u, inv = np.unique(np.concatenate([np.cumsum(_expand(r["keys"], r["n"], "u8"), dtype=U) for r in rows]), return_inverse=True)
    counts = np.concatenate([_expand_pairs(r["counts"]) for r in rows])
    total = np.column_stack([np.bincount(inv, counts[:, c], len(u)) for c in (0, 1)]).astype(np.int64)  # exact below 2^53
    return rows, u, inv, total


def _answers(rows: list[dict], inv: np.ndarray, total: np.ndarray, sums: list[int]) -> pa.Table:
    """The totals of every row's n-grams, in its order (TOLD); ``sums`` are in the first row."""
    at, out = 0, []
    for r in rows:
        out.append((r["gram"], r["range"], r["child"], _squeeze(total[inv[at:at + r["n"]]].astype(U))))
        at += r["n"]
    cols = [*zip(*out, strict=True), *([s] + [0] * (len(rows) - 1) for s in sums)]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in TOLD.split(", ")])


def add_up(asked: DataFrame, nodes: int, bits: int, parts: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """The sums of every node, asked of the ``nodes`` above in ranges of ``bits`` bits (ASKED)."""
    def run(group: pa.Table) -> pa.Table:
        rows, u, _, total = _added(group)
        r = rows[0]
        return pa.Table.from_batches([_cut(r["gram"], r["node"] % nodes, r["node"], r["range"], bits, fan_bits, u, total)])
    return asked.repartition(parts, "gram", "node", "range").groupBy("gram", "node", "range").applyInArrow(run, ASKED)


def tell(asked: DataFrame, parts: int) -> DataFrame:
    """Totals of all blocks, from the one node that all sums came to (TOLD)."""
    end_key = int(_keys(np.array([END], U), np.array([BEGIN], U), 1)[0])

    def run(group: pa.Table) -> pa.Table:
        rows, u, inv, total = _added(group)
        seen, kept = total[:, 0], total[:, 0] - total[:, 1]
        ends = kept[u == U(end_key)].sum() if rows[0]["gram"] == 1 else 0
        return _answers(rows, inv, total, [int(x) for x in (seen.sum(), kept.sum(), (seen > 0).sum(), ends)])
    return asked.repartition(parts, "gram", "node", "range").groupBy("gram", "node", "range").applyInArrow(run, TOLD)


def pass_down(asked: DataFrame, told: DataFrame, parts: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """What the nodes above ``told`` a node, for every child that ``asked`` it (TOLD)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, u, inv, _ = _added(left)
        total = np.concatenate([_expand_pairs(r["totals"]) for r in sorted(right.to_pylist(), key=lambda r: r["sub"])])
        if len(total) != len(u):
            raise RuntimeError(f"node {rows[0]['node']}: {len(total)} totals for {len(u)} n-grams")
        return _answers(rows, inv, total, [0] * 4)
    keys = ["gram", "node", "range"]
    above = told.select("gram", F.col("child").alias("node"), F.shiftright("range", fan_bits).alias("range"), F.col("range").alias("sub"), "totals")
    return asked.repartition(parts, *keys).groupBy(*keys).cogroup(above.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, TOLD)


def count_all(blocks: DataFrame, n_blocks: int, parts: int, fan_bits: int = FAN_BITS) -> tuple[DataFrame, dict]:
    """Totals for every block (TOLD), and the corpus's sums."""
    nodes = max(1, -(-n_blocks >> fan_bits))
    asked, levels = ask(blocks, nodes, fan_bits), []
    while nodes > 1:
        levels.append(stage(asked))
        nodes = -(-nodes >> fan_bits)
        asked = add_up(levels[-1], nodes, fan_bits * (len(levels) + 1), parts, fan_bits)
    told = stage(tell(asked, parts))
    sums = told.where("gram = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_all", "n_kept", "types"))).first().asDict()
    for asked in reversed(levels):
        told = stage(pass_down(asked, told, parts, fan_bits))
    return told, sums


def _probabilities(c2: np.ndarray, ctx: np.ndarray, c1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, and the two maximum-likelihood estimates (0 where unseen)."""
    b = np.where(ctx > 0, np.minimum(np.floor(np.log2(np.maximum(ctx, 1))).astype(np.int64) + 1, CONTEXT_BUCKETS - 1), 0)
    return b, np.where(ctx > 0, c2 / np.maximum(ctx, 1), 0.0), c1 / max(n, 1)


def count_tokens(blocks: DataFrame, told: DataFrame, kept_total: int, parts: int) -> DataFrame:
    """Totals of every token and its bigram, and the deleted fold's events (COUNTED)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in ("block long, doc_ids, folds, n_tokens, totals, events").split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct([("b", pa.int32()), ("q2", pa.int32()), ("q1", pa.int32()), ("n", pa.int64())]))]
        out, answers = [], right.to_pylist()
        for r in left.to_pylist():
            tok, prev, cnt = _tokens(r["texts"], r["sizes"])
            per = {}
            for gram in (1, 2):
                got = sorted((x for x in answers if x["gram"] == gram), key=lambda x: x["range"])
                u, inv = np.unique(_keys(tok, prev, gram), return_inverse=True)
                # each answer holds as many totals as its range was asked for
                flat = [_expand_pairs(x["totals"]) for x in got]
                totals = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
                if len(totals) != len(u):
                    raise RuntimeError(f"block {r['block']}: {len(totals)} totals for {len(u)} n-grams")
                per[gram] = totals[inv]
                if gram == 1:
                    ends = totals[np.searchsorted(u, _keys(np.array([END], U), np.array([BEGIN], U), 1))[0]]
            c1, c2 = per[1], per[2]
            starts = np.cumsum(cnt) - cnt
            ctx = np.empty_like(c1)
            ctx[1:] = c1[:-1]
            ctx[starts] = ends  # as many begins as ends
            fold = np.repeat(np.array(r["folds"]), cnt)
            d = fold == DELETED
            kept = lambda x: x[d, 0] - x[d, 1]
            b, p2, p1 = _probabilities(kept(c2), kept(ctx), kept(c1), kept_total)
            q2, q1 = (np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300)) / STEP), 1).astype(np.int64) for p in (p2, p1))
            ev, n = np.unique(np.column_stack([b, q2, q1]), axis=0, return_counts=True) if len(b) else (np.zeros((0, 3), np.int64), [])
            events = [{"b": int(x[0]), "q2": int(x[1]), "q1": int(x[2]), "n": int(k)} for x, k in zip(ev, n, strict=True)]
            all_ = np.column_stack([c1[:, 0], c2[:, 0]]).astype(np.uint64)
            out.append((r["block"], r["doc_ids"], r["folds"], cnt.tolist(), _squeeze(all_), events))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[n.split()[0] for n in names])
    answers = told.select("gram", "range", F.col("child").alias("block"), "totals")
    return blocks.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(run, COUNTED)


def _expand_pairs(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(16, -1)
    return np.ascontiguousarray(planes.T).view("u8").astype(np.int64)


def learn_weights(events: np.ndarray, floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, floor) per context bucket by expectation-maximisation.

    ``events``: rows of bucket, steps of log p2, steps of log p1 (1: unseen), count.
    """
    w = np.tile([0.4, 0.4, 0.2], (CONTEXT_BUCKETS, 1))
    w[0] = [0, 0.8, 0.2]  # a context never seen has no bigram estimate
    if not len(events):
        return w
    b, n = events[:, 0], events[:, 3].astype(float)
    p = np.column_stack([*(np.where(events[:, k] > 0, 0.0, np.exp(np.minimum(events[:, k], 0) * STEP)) for k in (1, 2)), np.full(len(b), floor)])
    for _ in range(rounds):
        share = w[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.column_stack([np.bincount(b, share[:, k], CONTEXT_BUCKETS) for k in range(3)])
        new[:, 1:] += 1e-3  # every bucket keeps a way out to the unigram and the floor
        new[1:, 0] += 1e-3
        w = new / new.sum(axis=1, keepdims=True)
    return w


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score per document."""
    blocks = stage(make_blocks(docs, block_bytes))
    n_blocks = blocks.count()
    parts = max(shuffle_width(docs.sparkSession), n_blocks)  # a task reads about a block at every level
    told, sums = count_all(blocks, n_blocks, parts, fan_bits)
    n_all, types = sums["n_all"], sums["types"]
    counted = stage(count_tokens(blocks, told, sums["n_kept"], parts))
    ev = (counted.select(F.explode("events").alias("e")).select("e.*").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))).collect()  # bounded by the steps
    floor = 1 / (types + 1)
    weights = learn_weights(np.array(sorted(tuple(r) for r in ev), np.int64).reshape(-1, 4), floor)
    fields = "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                cnt = np.array(r["n_tokens"])
                pair = _expand_pairs(r["totals"])
                c1, c2 = pair[:, 0], pair[:, 1]
                starts = np.cumsum(cnt) - cnt
                ctx = np.empty_like(c1)
                ctx[1:] = c1[:-1]
                ctx[starts] = c1[starts[0] + cnt[0] - 1]
                k, p2, p1 = _probabilities(c2, ctx, c1, n_all)
                lp = np.log10(weights[k, 0] * p2 + weights[k, 1] * p1 + weights[k, 2] * floor)
                base = np.log10((c1 + 1) / (n_all + types + 1))
                known = np.add.reduceat((c1 > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["folds"], pa.int32()), pa.array(cnt, pa.int64()), pa.array(known), pa.array(np.full(len(cnt), n_all)),
                     pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(lp, starts))], names=[f.split()[0] for f in fields.split(", ")])
    return counted.select("doc_ids", "folds", "n_tokens", "totals").mapInArrow(run, fields)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lm_scores(read_table(spark, sf_dir, "documents"))
    return s.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
