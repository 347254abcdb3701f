"""Operators against brute force on small fixtures, and their defined edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from tixflow.llm import decontaminate, fingerprints, lm_scoring, minhash_dedup, packing, secrets, substring_dedup, token_counts


def folded(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def shingle_set(text, k):
    w = folded(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_components(docs_of, corpus, k):
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs_of(corpus, clash=True), words=k).collect()}
    sets = {i: shingle_set(t, k) for i, t in corpus}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_minhash_families_of_near_copies(docs_of):
    """Members that their leader leaves apart still find each other: copies of far copies, truncated copies, extra passages."""
    import random
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    base, extra = [word() for _ in range(150)], [word() for _ in range(40)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = word()
        return w
    texts = [base] + [edited(base, rng.randrange(0, 14)) for _ in range(80)]
    for _ in range(12):  # far copies, each with close copies of its own
        far = edited(base, rng.randrange(5, 16))
        texts += [far] + [edited(far, rng.randrange(0, 4)) for _ in range(4)]
    texts += [base[:rng.randrange(70, 150)] for _ in range(25)]
    texts += [edited(base, 3) + extra[:rng.randrange(10, 40)] for _ in range(25)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingle_set(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(rows))}
    assert 10 < len(set(want.values())) < 120
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs_of(rows), words=4).collect()} == want


def test_minhash_edges(docs_of):
    d = docs_of([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "q r s"), (None, None), (9, "")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, None), (None, None), (9, 9)], key=str)
    kept = minhash_dedup.keep_first(d).collect()
    assert sorted((str(r["doc_id"]) for r in kept)) == ["3", "9", "None", "None"]
    assert minhash_dedup.near_duplicates(docs_of([])).collect() == []


def test_sketch_fills_every_bin_and_estimates():
    import numpy as np
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.sort(v[:600]), np.sort(v[150:750])  # similarity 450 / 750
    sk = minhash_dedup.fast_sketch(np.concatenate([a, b, v[:1]]), np.array([0, 600, 1200, 1201]), 512)
    assert (sk != 0xFFFFFFFF).all()
    assert abs((sk[0] == sk[1]).mean() - 0.6) < 0.1


def removed(rows, window):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][a:a + window]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                keep[a:a + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [12, 50])
def test_substring_dedup(docs_of, corpus, window):
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.dedup_substrings(docs_of(corpus, clash=True), window).collect()}
    assert got == removed(corpus, window)


@pytest.mark.parametrize("window", [50, 12])
def test_substring_factors_are_maximal_copies(docs_of, corpus, window):
    words = {i: (t or "").encode().split() for i, t in corpus}
    got = {r["doc_id"]: (r["factors"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs_of(corpus), window).collect()}
    assert sum(len(f) for f, _ in got.values()) > 20
    for i, (factors, n_removed) in got.items():
        lines, covered = {}, set()
        for f in factors:
            assert f["ref"] < i and f["n"] >= window
            assert words[i][f["at"]:f["at"] + f["n"]] == words[f["ref"]][f["ref_at"]:f["ref_at"] + f["n"]]
            lines.setdefault((f["ref"], f["ref_at"] - f["at"]), []).append((f["at"], f["at"] + f["n"]))
            covered |= set(range(f["at"], f["at"] + f["n"]))
        assert all(a[1] < b[0] for x in lines.values() for a, b in zip(sorted(x), sorted(x)[1:]))
        assert len(covered) == n_removed


def greedy_parse(text, reference, least):
    """The longest match at every word, from left to right; those of ``least`` words and more."""
    out, i = [], 0
    while i < len(text):
        best = (0, 0)
        for a in range(len(reference)):
            n = 0
            while i + n < len(text) and a + n < len(reference) and text[i + n] == reference[a + n]:
                n += 1
            best = max(best, (n, -a))
        if best[0] >= least:
            out.append((i, best[0], -best[1]))
        i += max(1, best[0])
    return out


def test_substring_factors_equal_a_greedy_parser(docs_of):
    import random
    rng = random.Random(8)
    reference = [f"r{i}" for i in range(900)]
    rows = [(1, " ".join(reference))]
    for i in range(2, 30):
        text = []
        for k in range(rng.randrange(1, 6)):
            a = rng.randrange(850)
            text += reference[a:a + rng.randrange(20, 250)] + [f"n{i}_{k}_{x}" for x in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: [(f["at"], f["n"], f["ref_at"]) for f in sorted(r["factors"])] for r in substring_dedup.dedup_substrings(docs_of(rows)).collect()}
    for i, t in rows[1:]:
        assert [f for f in got[i]] == greedy_parse(t.split(), reference, substring_dedup.WINDOW)
    assert got[1] == []


def test_substring_edges(docs_of):
    t = " ".join(f"v{i}" for i in range(60))
    rows = [(2, t), (2, t), (1, t + " end"), (None, t), (None, None)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs_of(rows)).collect())
    assert got == Counter({(2, 60, 60): 2, (1, 61, 0): 1, (None, 60, 0): 1, (None, 0, 0): 1})
    assert substring_dedup.dedup_substrings(docs_of([])).collect() == []


def test_token_counts_and_prefixes(docs_of, corpus):
    wt = token_counts.WordTokens(token_counts.TOKENIZER)
    rows = corpus + [(70, "x <|endoftext|>y 0 00 x0y ０ İI ̈a 'S 's (Foo) [bar], café́ ²"), (70, "again")]
    p = token_counts.prefix_counts(docs_of(rows, clash=True), limit=30)
    got = defaultdict(list)
    for r, c in zip(p.collect(), token_counts.counts(p).collect(), strict=True):
        got[r["doc_id"]].append((r, (c["n_bytes"], c["n_chars"], c["n_tokens"])))
    for i, t in rows:
        t = t or ""
        want = (len(t.encode()), len(t), len(wt.encode(t)))
        r = next(r for r, c in got[i] if c == want)
        assert len(wt.encode(t[:r["limit_chars"]])) <= 30 or want[2] <= 30
        for w in range(0, len(r["piece_end"]), max(1, len(r["piece_end"]) // 20)):
            assert r["prefix_tokens"][w] == len(wt.encode(t[:r["piece_end"][w]]))
        if want[2] > 30:  # every longer prefix is beyond the limit
            assert all(len(wt.encode(t[:n])) > 30 for n in range(r["limit_chars"] + 1, min(len(t), r["limit_chars"] + 25) + 1) if t[:n].rstrip() != t[:r["limit_chars"]].rstrip())
    one = {r["doc_id"]: r["n_pieces"] for r in token_counts.within_budget(p, 30).collect() if r["doc_id"] == 62}
    assert one[62] == sum(x <= 30 for x in got[62][0][0]["prefix_tokens"])
    assert {r["n_tokens"] for r in token_counts.count_at(p.where("doc_id = 7"), "5").collect()} == {len(wt.encode("one"))}
    assert token_counts.prefix_counts(docs_of([])).collect() == []


def test_token_prefixes_inside_words():
    """Every budget's cut and every piece's end against the library on every beginning of odd words."""
    import random
    import numpy as np
    rng, wp = random.Random(3), token_counts.WordPieces(token_counts.TOKENIZER)
    words = ["we'llove", "'rest''re", "a1b22c!!?x", "unbelievablyinternationalization", "日本語テキスト処理", "aa<|endoftext|>bb!!<|x", "😀😀a😀", "ŒUVRE", "İstanbul", "été", "qzxjkvqzxjkw" * 6]
    words += ["".join(rng.choice("abcdeinorst'!.19éßÄ日") for _ in range(rng.randrange(1, 30))) for _ in range(100)]
    for w in words:
        n = [len(wp.encode(w[:k])) for k in range(len(w) + 1)]
        assert all(n[k] == d for k, d in np.frombuffer(wp.word(w.encode()), np.int32).reshape(-1, 2).tolist()), w
        assert [wp.longest_within(w, b) for b in range(7)] == [max(k for k, x in enumerate(n) if x <= b) for b in range(7)], w
    assert wp.longest_within("xa\u0301\u0327b", 2) in (1, 4)  # never between a letter and its marks


def test_token_cut_of_long_unspaced_texts(docs_of):
    import random
    import time
    rng, wt = random.Random(4), token_counts.WordTokens(token_counts.TOKENIZER)
    rows = [(1, "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(1_000_000))), (2, "日本語" * 100_000), (3, "a" * 1_000_000)]
    t0 = time.time()
    got = {r["doc_id"]: r for r in token_counts.counts(token_counts.prefix_counts(docs_of(rows))).collect()}
    assert time.time() - t0 < 60
    for i, t in rows:
        k = got[i]["limit_chars"]
        assert got[i]["n_tokens"] == len(wt.encode(t)) and len(wt.encode(t[:k])) <= token_counts.TOKEN_LIMIT
        assert all(len(wt.encode(t[:n])) > token_counts.TOKEN_LIMIT for n in range(k + 1, k + 40))


@pytest.mark.parametrize("plan_rows", [packing.PLAN_ROWS, 6, 0])
def test_packing(docs_of, corpus, plan_rows):
    wt = token_counts.WordTokens(token_counts.TOKENIZER)
    rows = corpus + [(100 + i, "w1 w2 w3") for i in range(40)] + [(7, "one")]
    got = packing.pack(docs_of(rows, clash=True), capacity=64, plan_rows=plan_rows).collect()
    want = Counter()
    for i, t in rows:
        ids = [*wt.encode(t or "").tolist(), 1]
        want[i, len(ids)] += len(ids)
    assert Counter({k: sum(r["length"] for r in got if (r["doc_id"], r["doc_tokens"]) == k) for k in want}) == want
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(b"".join(int(x).to_bytes(4, "little") for x in [*wt.encode(t or "").tolist(), 1]))
    seqs = defaultdict(list)
    for r in got:
        assert any(zlib.crc32(x[4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"] for x in texts[r["doc_id"]])
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    pads = []
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        pads.append(64 - at)
    assert min(pads) >= 0 and sum(pads) < 64  # only the last one is padded
    assert packing.pack(docs_of([])).collect() == []


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
def test_packing_plan_does_not_grow_with_the_corpus(n):
    import numpy as np
    counts = np.random.default_rng(1).multinomial(n, [1 / 2047] * 2047).tolist()
    rows, n_seq = packing.plan_bins({k + 1: c for k, c in enumerate(counts) if c})
    tokens = sum((k + 1) * c for k, c in enumerate(counts))
    assert len(rows) < 1.2 * packing.PLAN_ROWS
    assert n_seq == -(-tokens // packing.CAPACITY)  # no padding but the last sequence's
    placed = sum((hi - lo) * size for _, lo, hi, _, size, *_ in rows)
    assert placed == tokens
    assert sum(hi - lo for _, lo, hi, *_, laid in rows if laid) <= 0.02 * n


def test_packing_plan_has_one_rule_for_every_size():
    """Patterns end where lengths run short, not at a number of rows: lengths of any frequencies are dealt, not laid."""
    import numpy as np
    rng = np.random.default_rng(3)
    p = rng.permutation(1 / np.arange(1, 2048))
    n = 10**6
    counts = rng.multinomial(n, p / p.sum()).tolist()
    rows, n_seq = packing.plan_bins({k + 1: c for k, c in enumerate(counts) if c})
    tokens = sum((k + 1) * c for k, c in enumerate(counts))
    assert n_seq == -(-tokens // packing.CAPACITY)
    assert sum((hi - lo) * size for _, lo, hi, _, size, *_ in rows) == tokens
    assert sum(hi - lo for _, lo, hi, *_, laid in rows if laid) <= 0.15 * n


@pytest.mark.parametrize("room", [10**6, 700, 0])
def test_known_words_are_kept_in_few_bytes(monkeypatch, room):
    import tracemalloc

    import numpy as np

    from tixflow.llm import kernel
    monkeypatch.setattr(token_counts, "CACHE_WORDS", room)
    wt = token_counts.WordTokens(token_counts.TOKENIZER)
    words = [str(i * 7919 % 1_000_003) for i in range(20_000)] + ["Caf\u00e9,", "", "12ab"]
    kernel.words(np.zeros(1 << 17, np.uint8), np.array([0, 1 << 17]))  # its tables of powers
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for a in (0, 5_000, 0, 10_000, 15_000):  # some words come again
        part = words[a:a + 5_003]
        data = " ".join(part).encode()
        h, s, e, _ = kernel.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        ids, start, size, inv = wt.of(np.frombuffer(data, np.uint8), h, s, e)
        got = [ids[start[k]:start[k] + size[k]].tolist() for k in inv[::97]]
        assert got == [wt.encode(data[x:y].decode()).tolist() for x, y in zip(s[::97].tolist(), e[::97].tolist(), strict=True)]
    del ids, start, size, inv, h, s, e
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(wt.known) == min(room, len({w for w in words if w}))
    assert kept < 90 * 20_000


def test_packing_patterns_are_bounded_by_the_window():
    import random
    rng = random.Random(5)
    for scale in (1, 10**3, 10**6):
        for _ in range(60):
            counts = {rng.randrange(1, 16): rng.randrange(1, 50) * scale for _ in range(rng.randrange(1, 9))}
            rows, n_seq = packing.plan_bins(counts, 16)
            assert n_seq == -(-sum(k * n for k, n in counts.items()) // 16)
            assert len({r[7] for r in rows if not r[9]}) <= packing.SHORT * 15


def test_fill_window_is_closest_subset():
    import itertools
    import random
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= 50)
        got, used = packing.fill_window(counts, 50)
        assert got == best == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def test_decontamination(docs_of, shipped, corpus):
    import re
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b" ".join(folded(t)))
    texts = dict(corpus)
    items = [(1, " ".join(texts[62].split()[5:40])), (2, "Two WORDS!"), (3, None), (4, "  "), (5, "w1"), (6, "Two words"), (7, " ".join(texts[62].split()[100:110]))]
    bench = shipped.createDataFrame(items, "item_id long, text string")
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[a:a + 10])].add(i)
    for limit in (500_000, 7):  # at once, and in parts
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.contamination(docs_of(corpus, clash=True), bench, max_grams=limit).collect()}
        for i, t in corpus:
            w, hit, it = words(t), set(), set()
            for k in {len(g) for g in grams}:
                for a in range(len(w) - k + 1):
                    if tuple(w[a:a + k]) in grams:
                        hit |= set(range(a, a + k))
                        it |= grams[tuple(w[a:a + k])]
            assert got[i] == (len(w), len(hit), sorted(map(str, it))), i
    d = docs_of([(1, "Two words here"), (1, "Two words here"), (None, "Two words"), (None, None), (2, "two, WORDS")], clash=True)
    assert sorted(r["n_hit"] for r in decontaminate.contamination(d, bench).collect()) == [0, 2, 2, 2, 2]
    left = decontaminate.decontaminate(d, bench)
    assert [r["doc_id"] for r in left.collect()] == [None] and left.columns == d.columns
    assert decontaminate.contamination(docs_of([]), bench).collect() == []
    assert {r["n_hit"] for r in decontaminate.contamination(d, bench.limit(0)).collect()} == {0}


def test_fingerprints(docs_of, corpus):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs_of(corpus, clash=True), scale=1).collect()}
    order = sorted(corpus)
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 4
        assert got[i]["edited"] == t[:len(t) - cut] + nxt[:cut]
        words = t.encode().split()
        assert len(got[i]["sketch"]) == len({tuple(words[a:a + 5]) for a in range(max(1, len(words) - 4))} if words else [])
    kept = {r["doc_id"]: r["sketch"] for r in fingerprints.fingerprints(docs_of(corpus), scale=8).collect()}
    assert set(kept[62]) <= set(got[62]["sketch"]) and 0.08 < len(kept[62]) / len(got[62]["sketch"]) < 0.18
    assert kept[1] == kept[2] and kept[7] == kept[8] and len(kept[7]) == 1 and kept[5] == []


def test_fingerprint_edges(docs_of, shipped):
    from pyspark.sql import functions as F
    assert fingerprints.edited_fingerprints(docs_of([])).collect() == []
    one = fingerprints.edited_fingerprints(docs_of([(4, "abcdefgh")])).first()
    assert one["edited"] == "abcdefab"
    rows = fingerprints.edited_fingerprints(docs_of([(None, "nnnn"), (2, "aaaa"), (2, "aaaa"), (7, "zzzz")])).collect()
    assert sorted((r["doc_id"] or 0, r["edited"]) for r in rows) == [(0, "nnna"), (2, "aaaa"), (2, "aaaz"), (7, "zzzn")]
    s = shipped.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([], [1])], "a array<long>, b array<long>")
    got = [tuple(r) for r in s.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.5, 2 / 3), (1.0, 1.0), (0.0, 1.0)]


def test_fingerprint_merge(docs_of, corpus):
    from pyspark.sql import functions as F
    t = dict(corpus)[62].split()
    half = docs_of([(1, " ".join(t[:4004])), (2, " ".join(t[4000:])), (3, " ".join(t))])
    s = fingerprints.fingerprints(half)
    a, b, c = (s.where(F.col("doc_id") == i).select(F.col("sketch").alias(f"s{i}")) for i in (1, 2, 3))
    assert a.join(b).join(c).select((fingerprints.merge(F.col("s1"), F.col("s2")) == F.col("s3")).alias("same")).first()["same"]


def test_secrets(docs_of):
    key = "AKIA" + "Q7" * 8
    rows = [(1, f"token=token=abcdef12 x secret: token: abcdefg ﬀ\U0001f600password='hunter22' {key} " + "0af" * 9), (2, f"see {key}"), (3, f"{key}{key}"), (4, None), (5, ""),
            (6, "api_key: short TOKEN:abcdef"), (7, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 24), (7, "none"), (8, f"see {key}")]
    got = defaultdict(list)
    for r in secrets.scan_documents(docs_of(rows, clash=True)).collect():
        got[r["doc_id"]].append(r)
    one = got[1][0]
    assert one["base"] == "assign:0:20,assign:48:66,access:68:88,hex:89:116" and one["spans"] == one["base"]
    assert (one["n_assign"], one["n_access"], one["n_hex"]) == (2, 1, 1)
    assert got[3][0]["base"] == "access:0:40" and got[4][0]["base"] == got[5][0]["base"] == ""
    assert got[6][0]["base"] == "assign:15:27"
    assert sorted(r["n_added"] for r in got[7]) == [0, 2] and len(got[7]) == 2
    # the key is held by the owners of documents 1, 2 and 8: s1, s2 and s2
    assert got[2][0]["n_live"] == 1 and got[2][0]["n_example"] == 0
    few = {r["doc_id"]: r["n_example"] for r in secrets.scan_documents(docs_of(rows), example_owners=2).collect() if r["doc_id"] == 2}
    assert few[2] == 1
    assert secrets.scan_documents(docs_of([])).collect() == []


def test_secret_owners_of_equal_rows(shipped):
    """One id and text from three sources has three owners; a null owner is one of its own; one very long text."""
    key = "AKIA" + "B" * 16
    rows = [(5, f"see {key}", s) for s in ("a", "b", "c", "a")] + [(6, "token = abcdefgh", None), (6, "token = abcdefgh", ""), (7, "word " * 200_000 + "0123456789abcdef" * 2, "a"), (None, f"{key}", "a")]
    d = shipped.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["n_live"], r["n_example"], r["max_owners"], r["max_repositories"]) for r in secrets.scan_documents(d).collect()}
    assert got == {(5, 0, 1, 3, 4), (None, 0, 1, 3, 4), (6, 1, 0, 2, 2), (7, 1, 0, 1, 1)}
    long = secrets.scan_documents(d).where("doc_id = 7").first()
    assert long["spans"] == "hex:1000000:1000032"


def test_lm_scores(docs_of, corpus):
    rows = corpus + [(7, "one"), (200, "never seen words")]
    got = lm_scoring.lm_scores(docs_of(rows, clash=True)).collect()
    c, toks = Counter(), defaultdict(list)
    for i, t in rows:
        toks[i].append(folded(t) + [b"\n"])
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(toks[i][-1])
    n, v = sum(c.values()), len(c)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        t = next(t for t in toks[r["doc_id"]] if len(t) == r["n_tokens"])
        assert r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    held = [r for r in got if r["fold"] == lm_scoring.HELD_OUT]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.lm_scores(docs_of([])).collect() == []
    assert len(lm_scoring.lm_scores(docs_of([(None, None)])).collect()) == 1


def reference_lm_scores(rows):
    """Deleted interpolation of bigrams, token by token."""
    import math

    import numpy as np
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in rows}
    texts = [(i, [*folded(t), b"\n"]) for i, t in rows]
    pairs = lambda toks: zip([b"\n"] + toks[:-1], toks)  # noqa: E731  (a text begins as often as one ends)
    one, two, kept_one, kept_two = Counter(), Counter(), Counter(), Counter()
    for i, toks in texts:
        if fold[i] != 2:
            one.update(toks)
            two.update((a if k else None, b) for k, (a, b) in enumerate(pairs(toks)))
            if fold[i] != 3:
                kept_one.update(toks)
                kept_two.update((a if k else None, b) for k, (a, b) in enumerate(pairs(toks)))
    bucket = lambda c: min(c.bit_length(), 47)
    step = lambda p: round(math.log(p) / 0.1) if p > 0 else 1
    events = Counter()
    for i, toks in texts:
        if fold[i] == 3:
            for k, (a, b) in enumerate(pairs(toks)):
                c = kept_one[a]
                events[bucket(c), step(kept_two[a if k else None, b] / c if c else 0), step(kept_one[b] / kept_one.total())] += 1
    floor = 1 / (len(one) + 1)
    w = lm_scoring.learn_weights(np.array(sorted((*k, n) for k, n in events.items())).reshape(-1, 4), floor)
    out = Counter()
    for i, toks in texts:
        score = 0.0
        for k, (a, b) in enumerate(pairs(toks)):
            c = one[a]
            p = (two[a if k else None, b] / c if c else 0, one[b] / one.total(), floor)
            score += math.log10(sum(x * y for x, y in zip(w[bucket(c)], p, strict=True)))
        out[i, len(toks), round(score, 4)] += 1
    return out


@pytest.mark.parametrize(("block_bytes", "fan_bits"), [(lm_scoring.BLOCK_BYTES, lm_scoring.FAN_BITS), (1 << 10, 1)])
def test_lm_scores_equal_brute_force_at_any_depth_of_the_tree(docs_of, corpus, block_bytes, fan_bits):
    rows = corpus + [(7, "one"), (200, "never seen words")]
    got = lm_scoring.lm_scores(docs_of(rows).repartition(4), block_bytes, fan_bits).collect()
    assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in got) == reference_lm_scores(rows)


def test_lm_groups_read_few_rows_however_many_blocks(docs_of):
    rows = [(i, " ".join(f"w{i % 7} v{x}" for x in range(40))) for i in range(900)]
    blocks = lm_scoring.make_blocks(docs_of(rows).coalesce(1), 1)
    n, fan = blocks.count(), 16
    assert n == 900
    low = lm_scoring.ask(blocks, -(-n // fan), 4)
    high = lm_scoring.add_up(low, -(-n // fan // fan), 8, 4, 4)
    for asked in (low, high):
        assert asked.groupBy("gram", "node", "range").count().agg({"count": "max"}).first()[0] <= 3 * fan


def test_lm_weights_sum_to_one_and_raise_likelihood():
    import numpy as np
    rng = np.random.default_rng(3)
    ev = np.column_stack([rng.integers(1, 6, 300), -rng.integers(0, 60, 300), -rng.integers(20, 90, 300), rng.integers(1, 9, 300)])
    ev[::7, 1] = 1  # unseen bigrams

    def loss(w):
        p = np.column_stack([np.where(ev[:, 1] > 0, 0, np.exp(ev[:, 1] * lm_scoring.STEP)), np.exp(ev[:, 2] * lm_scoring.STEP), np.full(300, 1e-5)])
        return (ev[:, 3] * np.log((w[ev[:, 0]] * p).sum(axis=1))).sum()
    steps = [loss(lm_scoring.learn_weights(ev, 1e-5, rounds=r)) for r in (1, 5, 60)]
    assert steps == sorted(steps)
    assert np.allclose(lm_scoring.learn_weights(ev, 1e-5).sum(axis=1), 1)


def test_minhash_writes_few_tables(docs_of, monkeypatch):
    """Every written table costs a job of all shuffle partitions, however small it is."""
    from tixflow.llm import graph
    written = []
    for module in (minhash_dedup, graph):
        monkeypatch.setattr(module, "stage", lambda df, f=module.stage: written.append(df.columns) or f(df))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words if i < 3 else [f"{i}{w}" for w in words])) for i in range(6)] + [(7 + i, " ".join([*words, f"x{i}"])) for i in range(4)]
    got = minhash_dedup.near_duplicates(docs_of(rows), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 3 or i > 6 else i for i, _ in rows}
    assert len(written) <= 21
