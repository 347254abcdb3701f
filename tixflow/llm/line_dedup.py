"""Line dedup by pairwise alignment (operator 4).

A run is the least sequence of adjacent lines with ``BLOCK_WORDS`` words from a
line on, or up to a line.  Every common block of that many words is covered by
runs, so two documents share a block if and only if they share a run.  Every
run's hash is counted over the corpus with its first holder, and a later
document is paired with the first holders of its runs.  Pairs are therefore at
most two per line, never all pairs of a run's holders, however many documents
hold the run or its lines.

Each pair is aligned by patience diff: lines that are unique in both documents
are matched along their longest increasing run, matches grow over equal
neighbours, and the gaps between them are aligned in the same way; in a gap
without unique lines the n-th occurrences of a line are matched.  An alignment
leaves repeats and lines in another order: what is left of the later document
is aligned again, piece by piece, with the places of the earlier one where its
runs occur.  Aligned common blocks of at least ``BLOCK_WORDS`` words are deleted
from the later document: a line stays if and only if no such block around it is
in an earlier document.  All pairs are judged on the input,
so a block's first holder always keeps it.

Only line hashes (8 bytes a line) are shuffled for counting and aligning;
texts are shuffled once, to be rewritten.

Defined results: lines are separated by a newline; a null or empty text has no
lines and stays; blank lines tell nothing; documents are ordered by id, rows of
equal id by their text's hash, and rows of equal id and text are the same
document; a null id comes first; other columns are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tixflow.llm import kernel
from tixflow.llm.common import read_table, stage

BLOCK_WORDS, CHUNK_LINES = 8, 1 << 18


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) whose second increases."""
    tails, at, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        x = bisect_left(tails, j)
        back[k] = at[x - 1] if x else -1
        if x == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[x], at[x] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _occurrences(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Pairs of the n-th occurrences of each line in a[a0:a1] and b[b0:b1]."""
    left: dict[int, list[int]] = {}
    for j in range(b1 - 1, b0 - 1, -1):
        left.setdefault(b[j], []).append(j)
    return [(i, left[a[i]].pop()) for i in range(a0, a1) if left.get(a[i])]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of the patience diff of a and b."""
    match: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            match.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            match.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict[int, int] = {}
        for j in range(b0, b1):
            seen[b[j]] = -1 if b[j] in seen else j
        anchors = _increasing([(i, seen[x]) for x, i in once.items() if i >= 0 and seen.get(x, -1) >= 0])
        if not anchors:
            anchors = _increasing(_occurrences(a, b, a0, a1, b0, b1))
        if not anchors:
            continue
        # each gap ends before an anchor; the anchor itself starts the next gap's common beginning
        edges = [(a0, b0), *anchors, (a1, b1)]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            todo.append((i, k, j, m))
    match.sort()
    blocks: list[tuple[int, int, int]] = []
    for i, j in match:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def runs(h: np.ndarray, w: np.ndarray, off: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and hash of the least runs of ``block_words`` words from every line and up to every line."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at, acc = np.arange(len(h)), np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    end = np.searchsorted(acc, acc[:-1] + block_words)
    start = np.searchsorted(acc, acc[1:] - block_words, side="right") - 1
    down, up = end <= off[row + 1], start >= off[row]
    s, e = np.concatenate([at[down], start[up]]), np.concatenate([end[down], at[up] + 1])
    s, e = np.unique(np.stack([s, e]), axis=1)
    return row[s], s, e, kernel.span_hash(h, s, e)


def _chunks(batch: pa.RecordBatch, *lists: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of about ``CHUNK_LINES`` lines, with flat values and offsets of the named lists."""
    off = [batch.column(c).offsets.to_numpy().astype(np.int64) for c in lists]
    total, i = sum(o - o[0] for o in off), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK_LINES, side="right")) - 1)
        x = batch.slice(i, j - i)
        yield x, [(x.column(c).flatten().to_numpy(zero_copy_only=False), o[i:j + 1] - o[i]) for c, o in zip(lists, off, strict=True)]
        i = j


def _lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def line_table(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, th, hashes and word counts of every line, one row per distinct document."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines"))
    # words up to the number that matters: gaps between runs of other characters
    words = F.transform("lines", lambda x: F.size(F.array_remove(F.split(x, r"[\x20\x09-\x0D]+", 1 + block_words), "")))
    src = src.select("doc_id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), words.alias("words"))
    return src.groupBy("doc_id", "th").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))


def partners(lines: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, th, first): the earlier documents to align every document with."""
    def run(batches):
        for b in batches:
            for x, ((h, off), (w, _)) in _chunks(b, "hashes", "words"):
                row, _, _, key = runs(h.view(np.uint64), w, off, block_words)
                row, key = np.unique(np.stack([row.astype(np.uint64), key]), axis=1)
                row = pa.array(row.astype(np.int64))
                yield pa.RecordBatch.from_arrays([x.column("doc_id").take(row), x.column("th").take(row), pa.array(key.view(np.int64))], names=["doc_id", "th", "run"])

    each = lines.select("doc_id", "th", "hashes", "words").mapInArrow(run, "doc_id long, th long, run long")
    held = stage(each.groupBy("run").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "first"))
    me = F.struct("doc_id", "th")
    return each.join(held, "run").where(F.col("first") < me).select("doc_id", "th", "first").distinct()


def common_lines(a: tuple, wa: np.ndarray, b: tuple, wb: np.ndarray, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """Flags of the lines of each text of b that are in a block common with the same text of a.

    ``a`` and ``b`` are flat line hashes and offsets, ``wa`` and ``wb`` word counts.
    """
    (ha, oa), (hb, ob) = a, b
    gone, acc = np.zeros(len(hb), bool), np.concatenate([[0], np.cumsum(wb, dtype=np.int64)])
    la, lb = ha.tolist(), hb.tolist()
    for i, z, j, y in zip(oa[:-1].tolist(), oa[1:].tolist(), ob[:-1].tolist(), ob[1:].tolist(), strict=True):
        for _, k, n in patience(la[i:z], lb[j:y]):
            if acc[j + k + n] - acc[j + k] >= block_words:
                gone[j + k:j + k + n] = True
    # what the alignment left, repeats and other orders, is aligned again at the places where its runs occur
    (ra, sa, ea, ka), (rb, s, e, kb) = runs(ha.view(np.uint64), wa, oa, block_words), runs(hb.view(np.uint64), wb, ob, block_words)
    ka, kb = ka ^ kernel.mix(ra.astype(np.uint64)), kb ^ kernel.mix(rb.astype(np.uint64))
    order = np.argsort(ka, kind="stable")
    at = np.searchsorted(ka, kb, sorter=order)
    there = np.flatnonzero(at < len(ka))
    there = there[ka[order[at[there]]] == kb[there]]
    kept = np.concatenate([[0], np.cumsum(~gone)])
    for r in there[kept[e[there]] > kept[s[there]]].tolist():
        x, y, o = int(s[r]), int(e[r]), order[at[r]]
        if not gone[x:y].all():
            for _, k, n in patience(la[sa[o]:ea[o]], lb[x:y]):
                if acc[x + k + n] - acc[x + k] >= block_words:
                    gone[x + k:x + k + n] = True
    return gone


def removed_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, th, keep): one flag per line, for documents that lose lines."""
    lines = stage(line_table(docs, block_words))
    pairs = stage(partners(lines, block_words).select("doc_id", "th", F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th")))
    a = lines.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), F.col("hashes").alias("a"), F.col("words").alias("a_words"))
    b = lines.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"), F.col("hashes").alias("b"), "words")

    def align(batches):
        for x in batches:
            for y, (p, (pw, _), q, (qw, _)) in _chunks(x, "a", "a_words", "b", "words"):
                gone, off = common_lines(p, pw, q, qw, block_words), q[1]
                out = [np.flatnonzero(gone[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([y.column("doc_id"), y.column("th"), pa.array(np.diff(off), pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "th", "n", "gone"])

    def flags(batches):
        for x in batches:
            keep = []
            for n, sets in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                m = np.ones(n, bool)
                for s in sets:
                    m[s] = False
                keep.append(m.tolist())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(keep, pa.list_(pa.bool_()))], names=["doc_id", "th", "keep"])

    both = (pairs.join(a, F.col("f_id").eqNullSafe(F.col("a_id")) & (F.col("f_th") == F.col("a_th")))
            .join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("th") == F.col("b_th"))).select("doc_id", "th", "a", "a_words", "b", "words"))
    gone = both.mapInArrow(align, "doc_id long, th long, n int, gone array<int>").where("size(gone) > 0")
    per = gone.groupBy("doc_id", "th").agg(F.max("n").alias("n"), F.collect_list("gone").alias("gone"))  # bounded by one document's lines
    return per.mapInArrow(flags, "doc_id long, th long, keep array<boolean>")


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_lines and n_removed_lines added."""
    gone = removed_lines(docs.select("doc_id", "text"), **settings).select(F.col("doc_id").alias("_k1"), F.col("th").alias("_k2"), F.col("keep").alias("_keep"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_k1")) & (F.xxhash64(text) == F.col("_k2")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: F.get(F.col("_keep"), i)), "\n")
    n = F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)
    return left.select(*(F.when(F.col("_keep").isNull(), docs[c]).otherwise(kept).alias(c) if c == "text" else docs[c] for c in docs.columns),
                       n.cast("long").alias("n_lines"), F.coalesce(F.size(F.filter("_keep", lambda x: ~x)), F.lit(0)).cast("long").alias("n_removed_lines"))


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without duplicate lines; a document that loses all its text goes.

    All columns stay; ``n_chars`` follows the text where the table has it.
    """
    d = dedup_lines(docs)
    cut = F.col("n_removed_lines") > 0
    d = d.where(~cut | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
