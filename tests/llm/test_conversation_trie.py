"""Conversation prefix trie (operator 12) against brute force, and its radix tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tixflow.llm import conversation_trie as C
from tixflow.llm.radix_tree import RadixTree

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(convs):
    """Rows of the contract for {conv_id: [(role, text), ...]}."""
    if not convs:
        return []
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    ends = {p: ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p))) for p, m in members.items()}
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def by_turn(rows):
    found = {}
    for c, n, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((n is not None, n or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in found.items()}


def query_input(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def conversation_rows():
    rng = random.Random(12)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", "ça va", ""]) * rng.randrange(1, 3)) for c in range(0, 420) for t in range(rng.randrange(0, 8))]
    rows += [(500 + c, t, "user", f"same {t}") for c in range(60) for t in range(5)]  # copies
    rows += [(600 + c, t, "user", f"long {t}") for c in range(3) for t in range(70 + 30 * c)]  # share whole segments
    rows += [(700, None, "user", "first"), (700, 3, None, None), (700, 3, None, None), (700, 3, "b", "tie"), (701, 1, "user", "x"), (None, 0, "user", "lost"), (800, 0, "u", "A"), (801, 0, "uA", "")]
    rng.shuffle(rows)
    return rows


def nodes_of(nodes, ends):
    n = nodes.join(C.end_digests(ends), ["a", "b"], "left").select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_chars", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return sorted(map(tuple, n.collect()))


def test_operator(shipped):
    rows = conversation_rows()
    table = shipped.createDataFrame(rows, SCHEMA)
    for c in ("id", "pos", "a", "b", "pa", "seg", "key", "chars", "n_convs"):
        table = table.withColumn(c, F.lit("x"))
    assert nodes_of(*C.conversation_trie(table)) == brute(by_turn(rows))


def test_small_trees_and_segments(shipped, monkeypatch):
    # SEGMENT is read when the plan is made; trees are cut in the workers only by their group
    monkeypatch.setattr(C, "SEGMENT", 2)
    monkeypatch.setattr(C, "CHUNK_BITS", 3)
    rows = [r for r in conversation_rows() if r[0] is None or r[0] < 560]
    assert nodes_of(*C.conversation_trie(shipped.createDataFrame(rows, SCHEMA))) == brute(by_turn(rows))


def test_query(shipped, tmp_path):
    rows = conversation_rows()
    shipped.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, C.op12_conversation_trie(shipped, str(tmp_path)).collect()))
    assert got == brute(query_input(by_turn(rows)))
    assert any(d > 64 for _, d, *_ in got)


def test_empty_and_turnless(shipped):
    none = shipped.createDataFrame([], SCHEMA)
    assert nodes_of(*C.conversation_trie(none)) == []
    some = shipped.createDataFrame([(7,), (3,)], "conv_id long")
    assert nodes_of(*C.prefix_trie(C.turn_table(none), some)) == brute({7: [], 3: []})


def test_one_very_long_conversation(shipped):
    # one key with nearly all rows spreads over range partitions
    rows = [(1, t, "user", f"t{t % 7}") for t in range(3000)] + [(2, t, "user", f"t{t % 7}") for t in range(1500)] + [(3, 0, "user", "t0")]
    assert nodes_of(*C.conversation_trie(shipped.createDataFrame(rows, SCHEMA).repartition(4))) == brute(by_turn(rows))


@pytest.mark.parametrize("width", [1, 2, 4])
def test_radix_tree(width):
    rng = random.Random(width)
    keys = [bytes(rng.randrange(2 if i % 2 else 256) for _ in range(width * rng.randrange(0, 5))) for i in range(3000)]
    tree, want = RadixTree(lambda x, y: x + y), {}
    for k in keys:
        tree.insert(k, 1)
        for d in range(width, len(k) + 1, width):
            want[k[:d]] = want.get(k[:d], 0) + 1
    got = list(tree.walk(width))
    assert len(got) == len(dict(got)) and dict(got) == want
    assert list(RadixTree(max).walk(width)) == []


def test_radix_tree_layouts():
    for n, size in ((4, 4), (5, 16), (16, 16), (17, 48), (48, 48), (49, 256), (256, 256)):
        tree = RadixTree(min)
        for b in range(n):
            tree.insert(bytes([b, 1, 2, 3]), b)
        assert tree.layouts() == {size: 1} and len(tree.root.next.items()) == n
        assert dict(tree.walk(4)) == {bytes([b, 1, 2, 3]): b for b in range(n)}
