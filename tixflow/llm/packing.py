"""Sequence packing by minimum bin slack (operator 7).

Every text's ids, then the end id, are cut into whole windows of the sequence
length and one remainder.  Only the remainders need packing, and only their
lengths matter: the histogram has at most ``capacity - 1`` rows at any corpus
size.  From it the driver makes the plan.  Each step takes the length with the
most tokens left and runs a bitset subset-sum over the remaining multiset of
lengths; the reachable sum closest to the window is backtracked to counts per
length, and the found pattern is repeated as often as the counts allow.  The
multiset is first divided by a number of repeats, which falls until a subset
fills the window, so patterns that can be repeated often come first.  Where
no subset of the whole multiset fills the window, one more remainder is cut to
fill it and its rest goes back, so only the last sequence is padded.

The rule is the same for every corpus: after each pattern at least one of its
lengths has fewer remainders left than the pattern takes, and a length that has
run short ``SHORT`` times is set aside.  So there are at most ``SHORT`` patterns
per length below the window, however many texts there are.  What was set aside
is laid end to end in order of length and cut at the windows, a plan row a run:
about one in 70 of 10^4 remainders of evenly spread lengths, one in 1,200 of 10^8.

A plan row gives ranks of one length to positions by arithmetic.  Ranks are
counted per task while the texts are encoded and made global by prefix sums
over tasks, so no length, however common, is gathered anywhere.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each on its own; other columns are ignored; an empty table gives no
pieces.  A power of two of ids in the last sequence needs no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.llm import kernel
from tixflow.llm.common import doc_chunks, read_table, stage
from tixflow.llm.token_counts import CHUNK_BYTES, TOKENIZER, word_tokens

CAPACITY = 2048
END_ID = 1
SHORT = 4
PLAN_ROWS = 12_000  # about the rows of a plan of evenly spread lengths
PLAN = "src_len int, lo long, hi long, cut int, len int, i0 long, k long, seq0 long, off0 int, laid boolean"


def fill_window(counts: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The reachable sum closest to ``target`` from a multiset, and counts that make it.

    Bitset subset-sum: bit s of the set says that s can be made.  Counts are
    split into powers of two; the set before each step allows backtracking.
    """
    reach, full, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if length > target:
            continue
        left, part = min(counts[length], target // length), 1
        while left and not reach >> target & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> target & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    at = best
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return best, dict(used)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, plan_rows: int | None = None) -> tuple[list[tuple], int]:
    """Plan rows (PLAN) for remainders counted by length, and the sequences they fill.

    A length runs short when it has fewer remainders left than a dealt pattern
    takes of it; the ``SHORT``th time it is set aside for good.  What is set aside
    is ``laid`` end to end: ``i0`` is where the first piece of a run begins.
    ``plan_rows`` ends the dealing early.
    """
    left = {k: n for k, n in histogram.items() if n}
    runs = {k: deque([(k, 0, n, 0)]) for k, n in left.items()}  # source length, ranks, tokens cut off before
    rows, seq, short = [], 0, defaultdict(int)

    def take(length: int, k: int, times: int, off: int, size: int) -> None:
        """Deal k * times items of ``length`` to ``times`` sequences; ``size`` tokens of each go there."""
        need, i0 = k * times, 0
        left[length] -= need
        while i0 < need:
            src, lo, hi, cut = runs[length].popleft()
            mid = min(hi, lo + need - i0)
            if mid < hi:
                runs[length].appendleft((src, mid, hi, cut))
            rows.append((src, lo, mid, cut, size, i0, k, seq, off, False))
            if size < length:
                runs.setdefault(length - size, deque()).append((src, lo, mid, cut + size))
            i0 += mid - lo

    while left and (plan_rows is None or len(rows) < plan_rows):
        top = max(left, key=lambda k: (left[k] * k, k))
        repeats = left[top]
        while True:
            rest = {k: n // repeats - (k == top) for k, n in left.items() if n // repeats > (k == top)}
            best, used = fill_window(rest, capacity - top)
            if repeats == 1 or best == capacity - top:
                break
            repeats = max(1, repeats // 4)
        used[top] = used.get(top, 0) + 1
        slack = capacity - top - best
        over = {k: n - used.get(k, 0) for k, n in left.items() if n > used.get(k, 0)}
        if slack and not over:  # nothing is left to fill the window
            break
        times = min(left[k] // n for k, n in used.items())
        cut = min(over) if slack else 0
        if cut:
            times = min(times, left[cut] // (used.get(cut, 0) + 1))
        off = 0
        for k, n in used.items():
            take(k, n, times, off, k)
            off += n * k
        if cut:
            take(cut, 1, times, off, slack)
            used[cut] = used.get(cut, 0) + 1
        for k, n in used.items():
            short[k] += left[k] < n
            if not left[k] or short[k] == SHORT:
                del left[k]
        if cut and short[cut - slack] < SHORT:  # after the count: every pattern leaves a length short
            left[cut - slack] = left.get(cut - slack, 0) + times
        seq += times
    end = 0
    for length in sorted(runs, reverse=True):
        for src, lo, hi, cut in runs[length]:
            rows.append((src, lo, hi, cut, length, end, 1, seq, 0, True))
            end += (hi - lo) * length
    return rows, seq - (-end // capacity)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per text: its whole windows' checksums, its remainder's ids and both ranks in the task."""
    fields = "doc_id long, part int, doc_tokens long, full array<long>, full_rank long, rem int, rem_rank long, tail binary"

    def run(batches):
        wt, part = word_tokens(tokenizer), TaskContext.get().partitionId()
        full_seen, rem_seen = 0, defaultdict(int)
        for b in batches:
            ids = b.column(0)
            for i, j, data, off in doc_chunks(b, "text", CHUNK_BYTES):
                h, s, e, wo = kernel.words(data, off)
                toks, start, per, inv = wt.of(data, h, s, e)
                inv = np.insert(inv, wo[1:], len(per))
                start, per = np.append(start, len(toks)), np.append(per, 1)
                toks = np.append(toks, np.uint32(end_id))
                size = per[inv]
                stop = np.cumsum(size)
                flat = toks[np.arange(stop[-1]) + np.repeat(start[inv] - stop + size, size)].astype("<u4", copy=False)
                ends = stop[wo[1:] + np.arange(j - i)]
                out = []
                for t, u in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
                    n = u - t
                    k, rem = divmod(n, capacity)
                    sums = [zlib.crc32(flat[t + capacity * w:t + capacity * (w + 1)].tobytes()) for w in range(k)]
                    out.append((part, n, sums, full_seen, rem, rem_seen[rem], flat[u - rem:u].tobytes()))
                    full_seen += k
                    rem_seen[rem] += 1
                cols = list(zip(*out, strict=True))
                types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[f.split()[0] for f in fields.split(", ")])

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, plan_rows: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    t = stage(encode(docs, tokenizer, capacity, end_id))
    # at most capacity rows reach the driver
    hist = {r["rem"]: r["n"] for r in t.where("rem > 0").groupBy("rem").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, n_mixed = plan_bins(hist, capacity, plan_rows)
    plan = spark.createDataFrame(rows, PLAN)

    by_len = t.groupBy("part", "rem").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rem_base = by_len.select("part", "rem", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("rem_base"))
    by_part = t.groupBy("part").agg(F.sum(F.size("full")).alias("n"))  # one row per task
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_base = by_part.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("full_base"))

    tails = t.where("rem > 0").join(rem_base, ["part", "rem"]).withColumn("r", F.col("rem_rank") + F.col("rem_base"))
    p = F.broadcast(plan)  # at most SHORT patterns per length and the runs they leave, at any size of the corpus
    window, i = F.lit(capacity), F.col("i0") + F.col("r") - F.col("lo")
    dealt = (tails.join(p, (F.col("rem") == F.col("src_len")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
             .withColumn("at", F.when(F.col("laid"), F.col("i0") + (F.col("r") - F.col("lo")) * F.col("len"))))
    dealt = (dealt.withColumn("sequence_id", F.when(F.col("laid"), F.col("seq0") + F.floor(F.col("at") / window)).otherwise(F.expr("seq0 + (i0 + r - lo) div k")))
             .withColumn("offset", F.when(F.col("laid"), F.col("at") % window).otherwise(F.col("off0") + F.pmod(i, F.col("k")) * F.col("len")).cast("long")))
    # a laid piece over the end of its window goes on at the next one's begin
    head = F.least(F.col("len").cast("long"), window - F.col("offset"))
    first = F.struct(F.col("cut").cast("long").alias("cut"), head.alias("length"), "sequence_id", "offset")
    rest = F.struct((F.col("cut") + head).alias("cut"), (F.col("len") - head).alias("length"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    mixed = (dealt.select("doc_id", "full", "tail", "doc_tokens", F.explode(F.when(head < F.col("len"), F.array(first, rest)).otherwise(F.array(first))).alias("x"))
             .select("doc_id", (F.size("full") * window + F.col("x.cut")).cast("long").alias("start"), "x.length",
                     F.crc32(F.expr("substring(tail, cast(x.cut * 4 + 1 as int), cast(x.length * 4 as int))")).alias("ids_crc32"), "doc_tokens", "x.sequence_id", "x.offset"))
    whole = (t.where("size(full) > 0").join(full_base, "part")
             .select("doc_id", "doc_tokens", "full_rank", "full_base", F.posexplode("full").alias("pos", "ids_crc32"))
             .select("doc_id", (F.col("pos") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
                     (F.lit(n_mixed) + F.col("full_base") + F.col("full_rank") + F.col("pos")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return mixed.unionByName(whole)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
