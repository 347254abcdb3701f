"""Conversation prefix trie by adaptive radix trees (operator 12).

A turn's id is a fixed-width big-endian number (the 128-bit hash of its role
and text), so a conversation is a byte key of its turns' ids, and every prefix
of whole turns is a node.  Conversations are cut into segments of ``SEGMENT``
turns; a segment's key sits below the hash of all turns before it, so a row is
bounded however long its conversation is.  Equal segments are combined before
they are shuffled.  The distinct ones are sorted by range, and each task builds
adaptive radix trees (``radix_tree``) of its part: layouts that grow from 4 to
256 branches, compressed paths, and a walk that emits nodes at turn-aligned
depths only.  A prefix that several tasks hold has one partial row a task,
which are combined by node.

A prefix that a third of all conversations share is thus one row a task, and
its conversations spread over tasks by what follows.  Positions and prefix
hashes of one very long conversation are running totals over ranges, stitched
at the range bounds (``running``).  Sums over subtrees need the nodes of at
least two conversations only; they are formed by doubling the distance to the
ancestor, so the number of rounds is the logarithm of the depth.

Defined results: null roles and texts are empty; turns are in order of their
number (null first) and, with equal number, of their id; a repeated row is a
repeated turn; rows without a conv_id belong to no conversation; other columns
are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tixflow.llm.common import read_table, stage
from tixflow.llm.radix_tree import RadixTree

TURN_BYTES, SEGMENT, TREE_KEYS, BATCH = 16, 16, 4096, 8192
HEAD = 6  # the query's conversations start with fewer turns than this of another one
CHUNK_BITS = 12
FOLDS = {"sum": (F.sum, lambda x, y: x + y), "bit_xor": (F.bit_xor, lambda x, y: x.bitwiseXOR(y))}


def running(df: DataFrame, key: str, order: list[str], folds: dict[str, str]) -> DataFrame:
    """``df`` (staged) with ``<name>_before`` for each column of ``folds``: the named fold of the key's rows before the row.

    Rows go to ranges of (key, order), so a key with very many rows spreads over
    tasks; only keys that cross a range bound have offsets, at most one row a
    range, which are broadcast.
    """
    s = stage(df.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy("_p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = s.groupBy("_p", key).agg(*(FOLDS[f][0](name).alias(name) for name, f in folds.items()))
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("_p", F.col(key).alias("_k"), F.row_number().over(Window.partitionBy(key).orderBy("_p")).alias("_n"), *(FOLDS[f][0](name).over(earlier).alias(f"_o_{name}") for name, f in folds.items()))
    offset = stage(part.where("_n > 1").drop("_n"))
    s = s.select("*", *(FOLDS[f][0](name).over(before).alias(f"_b_{name}") for name, f in folds.items()))
    s = s.join(F.broadcast(offset.withColumnRenamed("_p", "_q")), (F.col("_p") == F.col("_q")) & (F.col(key) == F.col("_k")), "left")
    none = F.lit(0).cast("long")
    return s.select(*df.columns, *(FOLDS[f][1](F.coalesce(f"_o_{name}", none), F.coalesce(f"_b_{name}", none)).alias(f"{name}_before") for name, f in folds.items()))


def turn_table(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), id (hex of the turn's number) and chars (code points of its text) of every turn; staged."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"),
                             F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.char_length(text).cast("long").alias("chars"))
    t = stage(t.where("conv_id is not null").withColumn("pos", F.lit(1).cast("long")))
    r = running(t, "conv_id", ["turn", "id"], {"pos": "sum"})
    return stage(r.select("conv_id", F.col("pos_before").alias("pos"), "id", "chars"))


def _node_id(p1: Column, p2: Column, key: Column, seg: Column) -> tuple[Column, Column]:
    """Hash of all turns up to the end of ``key`` in segment ``seg``, below the prefix (p1, p2)."""
    return p1.bitwiseXOR(F.xxhash64(key, seg)), p2.bitwiseXOR(F.xxhash64(F.lit("second"), key, seg))


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, seg, key, chars, the hash (p1, p2) of the turns before and the node (a, b) that the segment ends at."""
    seg = F.floor(F.col("pos") / SEGMENT).cast("long")
    per = turns.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("t"))  # at most SEGMENT turns
    per = per.select("conv_id", "seg", F.unhex(F.array_join(F.col("t.id"), "")).alias("key"), F.col("t.chars").alias("chars"))
    h = _node_id(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("key"), F.col("seg"))
    per = running(stage(per.select("*", h[0].alias("h1"), h[1].alias("h2"))), "conv_id", ["seg"], {"h1": "bit_xor", "h2": "bit_xor"})
    return stage(per.select("conv_id", "seg", "key", "chars", F.col("h1_before").alias("p1"), F.col("h2_before").alias("p2"),
                            F.col("h1").bitwiseXOR(F.col("h1_before")).alias("a"), F.col("h2").bitwiseXOR(F.col("h2_before")).alias("b")))


def _merged(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
    return x[0] + y[0], min(x[1], y[1])


def _partial_nodes(batches):
    """Nodes of the radix trees over one sorted part: a tree for each run of segments below one prefix."""
    names = ["p1", "p2", "seg", "prefix", "n_convs", "conv_id", "chars"]

    def emit(at, tree, chars):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows = ((*at, prefix, n, conv, chars[prefix[-TURN_BYTES:]]) for prefix, (n, conv) in tree.walk(TURN_BYTES))
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    at, tree, chars = None, RadixTree(_merged), {}
    for b in batches:
        for p1, p2, seg, key, n, conv, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tree.keys and (at != (p1, p2, seg) or tree.keys >= TREE_KEYS):
                yield from emit(at, tree, chars)
                tree, chars = RadixTree(_merged), {}
            at = (p1, p2, seg)
            tree.insert(key, (n, conv))
            for i, c in enumerate(lengths):
                chars[key[i * TURN_BYTES:(i + 1) * TURN_BYTES]] = c
    if tree.keys:
        yield from emit(at, tree, chars)


def _nodes(segs: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, pa, pb (node and parent), depth, chars, n_convs and conv_id of every node."""
    order = ["p1", "p2", "seg", "key"]
    each = stage(segs.groupBy(*order).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars")))
    part = each.repartitionByRange(*order).sortWithinPartitions(*order)
    part = part.mapInArrow(_partial_nodes, "p1 long, p2 long, seg long, prefix binary, n_convs long, conv_id long, chars long")
    d = (F.octet_length("prefix") / TURN_BYTES).cast("long")
    above = F.substring("prefix", F.lit(1), F.octet_length("prefix") - TURN_BYTES)
    p1, p2, seg = F.col("p1"), F.col("p2"), F.col("seg")
    a, b = _node_id(p1, p2, F.col("prefix"), seg)
    ua, ub = _node_id(p1, p2, above, seg)
    part = part.select(a.alias("a"), b.alias("b"), F.when(d > 1, ua).otherwise(p1).alias("pa"), F.when(d > 1, ub).otherwise(p2).alias("pb"), (seg * SEGMENT + d).alias("depth"), "chars", "n_convs", "conv_id")
    nodes = part.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("pa", "pb", "depth", "chars")), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    return stage(nodes.unionByName(root.select(zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), zero.alias("chars"), "n_convs", "conv_id")))


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """a, b and the sums of leaves and saved over all descendants, from (a, b, pa, pb, leaves, saved).

    After round k a row holds the sums over descendants less than 2^k below it
    and the ancestor 2^k above it (the driver sees whether there is one left).
    """
    s = stage(shared)
    while s.where("pa is not null").limit(1).count():
        up = s.where("pa is not null").groupBy("pa", "pb").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = s.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("pa").alias("next_a"), F.col("pb").alias("next_b"))
        s = (s.join(above, (s["pa"] == F.col("x")) & (s["pb"] == F.col("y")), "left")
             .select("a", "b", "next_a", "next_b", "leaves", "saved")
             .join(up, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left")
             .select("a", "b", F.col("next_a").alias("pa"), F.col("next_b").alias("pb"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                     (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        s = stage(s)
    return s.select("a", "b", "leaves", "saved")


def conversation_ends(turns: DataFrame, members: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """conv_id and the node (a, b) that the conversation ends at; without turns, the root."""
    last = (segments(turns) if segs is None else segs).groupBy("conv_id").agg(F.max(F.struct("seg", "a", "b")).alias("end"))
    return members.select("conv_id").join(last, "conv_id", "left").select("conv_id", F.coalesce("end.a", F.lit(0)).alias("a"), F.coalesce("end.b", F.lit(0)).alias("b"))


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie over a turn table (``turn_table``).

    ``members`` (conv_id, distinct) may name conversations without turns.
    Nodes: a, b (the node's id), conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_chars (characters that sharing saves in
    the node's subtree) and chars (of its last turn).  Ends: conv_id, a, b.
    """
    members = stage(members.select("conv_id") if members is not None else turns.select("conv_id").distinct())
    segs = segments(turns)
    nodes = _nodes(segs, members)
    below = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    info = stage(nodes.join(below, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # below a node of one conversation there is one leaf and nothing to save
    shared = info.where("n_convs > 1").select("a", "b", "pa", "pb", (F.coalesce("n_single", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = _subtree_sums(shared)
    parent = nodes.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("conv_id").alias("parent_conv_id"))
    out = info.join(parent, (F.col("pa") == F.col("x")) & (F.col("pb") == F.col("y")), "left").drop("x", "y").join(sums, ["a", "b"], "left")
    out = out.select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                     F.coalesce("saved", F.lit(0)).cast("long").alias("saved_chars"), "chars")
    return out, conversation_ends(turns, members, segs)


def conversation_trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends (``prefix_trie``) of a table of conv_id, turn, role and text."""
    return prefix_trie(turn_table(conversations))


def _list_digests(batches):
    """SHA-256 of each node's comma-joined parts, which come one after the other; a node's list is never held whole."""
    names = ["a", "b", "ends_sha256"]
    at, sha = None, None
    for batch in batches:
        out = []
        for a, b, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (a, b):
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (a, b), hashlib.sha256(part.encode())
            else:
                sha.update(b"," + part.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b and ends_sha256, the digest of the conv_ids (ascending) that end at the node.

    Ids are first joined to pieces of at most 2^CHUNK_BITS, so a node at which
    very many conversations end is few rows, read in order.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")  # one row an id: bounded by the piece's range
    parts = ends.groupBy("a", "b", F.shiftright("conv_id", CHUNK_BITS).alias("piece")).agg(piece.alias("part"))
    parts = parts.repartition("a", "b").sortWithinPartitions("a", "b", "piece")
    return parts.select("a", "b", "part").mapInArrow(_list_digests, "a long, b long, ends_sha256 string")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations, as a turn table and their ids: up to HEAD - 1 first turns of another conversation, then own ones."""
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int")
    heads = turns.where(F.col("pos") < HEAD - 1).groupBy(conv.alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("head"))  # at most HEAD - 1 turns
    convs = turns.select("conv_id").distinct().withColumn("base", conv - conv % 100)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("id"), F.lit(0).cast("long").alias("chars"))), 1, 0))
    convs = stage(convs.join(heads, "base", "left").withColumn("h", h).select("conv_id", "h", head.alias("head")))
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("n_head")), "conv_id").where(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "id", "chars")
    first = convs.select("conv_id", F.inline("head")).select("conv_id", "pos", "id", "chars")
    return stage(own.unionByName(first)), convs.select("conv_id")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = rebuilt(turn_table(read_table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie(turns, members)
    nodes = nodes.join(end_digests(ends), ["a", "b"], "left")
    empty = F.sha2(F.lit(""), 256)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
