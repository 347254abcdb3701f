"""Learned and aligned operators, the pipeline and the registration."""

import random

import pytest
from pyspark.sql import functions as F

from tixflow.llm import line_dedup, quality


def test_patience_blocks():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1, 2), (3, 4, 1)]
    assert line_dedup.patience([1, 2], [2, 1]) in ([(0, 1, 1)], [(1, 0, 1)])
    assert line_dedup.patience([5, 5, 5], [5, 5]) == [(0, 0, 2)]
    assert line_dedup.patience([], [1]) == []
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(14))] for _ in range(2))
        i0 = j0 = 0
        for i, j, n in line_dedup.patience(a, b):
            assert a[i:i + n] == b[j:j + n] and i >= i0 and j >= j0
            i0, j0 = i + n, j + n


def test_line_dedup(docs_of):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(150)] + [(200, ""), (201, "\n\n"), (202, "short"), (203, "short")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["text"]) for r in line_dedup.dedup_lines(docs_of(rows, clash=True)).collect()}
    kept = whole_line_dedup(rows)
    count = lambda t: len(t.split("\n")) if t else 0
    assert {i: t for i, (_, _, t) in got.items()} == kept
    assert all(got[i][0] == count(t) for i, t in rows) and all(n - gone == count(t) for i, (n, gone, t) in got.items() if t)
    assert sum(x[1] for x in got.values()) > 100


def test_alignment_deletes(monkeypatch):
    """Blocks leave through the alignment only: without it nothing does."""
    import numpy as np
    a, b = np.array([1, 2, 3, 9, 4, 5], np.int64), np.array([4, 5, 7, 1, 2, 3, 1, 2, 3], np.int64)
    wa, wb = np.full(6, 4), np.full(9, 4)
    cut = lambda: line_dedup.common_lines((a, np.array([0, 6])), wa, (b, np.array([0, 9])), wb, 8).tolist()
    assert cut() == [True, True, False, True, True, True, True, True, True]
    monkeypatch.setattr(line_dedup, "patience", lambda x, y: [])
    assert not any(cut())


def test_line_dedup_edges(docs_of):
    long = "one two three four five six seven eight nine"
    d = docs_of([(1, long), (2, long), (2, long), (None, None), (None, long), (3, f"{long}\nmore"), (4, "")], clash=True)
    left = line_dedup.drop_duplicate_lines(d)
    assert left.columns == d.columns
    # the null id comes first and keeps the line
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in left.collect()) == sorted([("None", "None", 0), ("None", long, len(long)), ("3", "more", 4), ("4", "", 0)])
    assert line_dedup.dedup_lines(docs_of([])).collect() == []


def whole_line_dedup(rows):
    """Kept text per id by brute force: a line goes if a run of at least 8 words around it is in any earlier document."""
    lines = {i: t.split("\n") if t else [] for i, t in rows}
    out = {}
    for i, own in lines.items():
        gone = set()
        for p in (p for p in lines if p < i):
            held = lines[p]
            for j in range(len(own)):
                for k in range(len(held)):
                    n = 0
                    while j + n < len(own) and k + n < len(held) and own[j + n] == held[k + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[j:j + n]) >= 8:
                        gone |= set(range(j, j + n))
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


def kept_lines(docs_of, rows):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(rows)).collect()}


def test_line_dedup_frequent_short_lines(docs_of):
    # each line is in more than 100 other documents; only 500 and 501 hold them as one passage
    rows = [(i, f"own {i}\nsee you soon again\nother {i}\nall the best wishes") for i in range(130)]
    rows += [(500, "left\nsee you soon again\nall the best wishes"), (501, "see you soon again\nall the best wishes\nright")]
    rows += [(600 + i, "left\nsee you soon again\nall the best wishes") for i in range(130)]
    got = kept_lines(docs_of, rows)
    assert got[501] == "right" and got[729] == "" and got[500] == rows[130][1]
    assert got == whole_line_dedup(rows)


def test_line_dedup_repeats(docs_of):
    long = "one two three four five six seven eight nine"
    # no line that is unique in both; both occurrences go, whichever document repeats
    assert line_dedup.patience([7, 1, 8, 1, 7], [9, 1, 6, 1, 9]) == [(1, 1, 1), (3, 3, 1)]
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{long}\ne"), (3, f"f f\n{long} x\ng\n{long} x\nh"), (4, f"k\n{long} x\nm"), (5, "p p p p\nq q q q\nr\np p p p\nq q q q"), (6, "s\np p p p\nq q q q\nt")]
    got = kept_lines(docs_of, rows)
    assert got[2] == "c\nd\ne" and got[4] == "k\nm" and got[6] == "s\nt" and got[5] == rows[4][1]
    assert got == whole_line_dedup(rows)


def test_line_dedup_other_holders(docs_of):
    x, y = "a b c d e f g h i", "j k l m n o p q r"
    rows = [(1, f"{x}\nmiddle\n{y}"), (2, f"{y}\nother\n{x}")]  # crossing lines
    rows += [(3, "see you soon\nu"), (4, "v\nall the best wishes again"), (5, "w\nsee you soon\nall the best wishes again"), (6, "see you soon\nall the best wishes again\nz")]
    rows += [(7, f"{x}\ntail"), (8, f"s\n{x}\ntail")]  # the first holder of x has no tail
    got = kept_lines(docs_of, rows)
    assert got[2] == "other" and got[6] == "z" and got[7] == "tail" and got[8] == "s"
    assert got == whole_line_dedup(rows)


def test_line_dedup_whole(docs_of):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 14))) for _ in range(40)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16)))) for i in range(220)]
    assert kept_lines(docs_of, rows) == whole_line_dedup(rows)


@pytest.fixture(scope="module")
def labelled(docs_of, shipped):
    rng = random.Random(6)
    good = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        y = int(rng.random() < 0.7)
        rows.append((i, " ".join(rng.choice(good) for _ in range(80)) if y else " ".join([f"SPAM{rng.randrange(30)}!!"] * 6 + ["###", "buy"] * 20)))
        labels.append((i, y, 0))
    return docs_of(rows, clash=True), shipped.createDataFrame(labels + [(0, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_quality_held_out_accuracy(labelled):
    import zlib
    docs, labels, truth = labelled
    got = {r["doc_id"]: r["score"] for r in quality.fit(docs, labels).score(docs).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values())


def test_quality_never_learns_from_held_out_rows(labelled, shipped):
    docs, labels, _ = labelled
    from tixflow.llm.common import crc32_mod
    flipped = labels.withColumn("quality", F.when(crc32_mod(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality.fit(docs, x).score(docs).collect()) for x in (labels, flipped))
    assert a == b


def test_quality_reads_long_texts_to_the_end():
    import numpy as np
    rng = random.Random(8)
    said = lambda word, n: " ".join(f"{word}{rng.randrange(900)}" for _ in range(n)).encode()
    dicts = [quality.build_dictionary([said(w, 500) for _ in range(200)]) for w in ("spam", "fine")]
    neutral, bad = rng.randbytes(3 << 20), said("spam", 1500)
    texts = [b"", bad, neutral, neutral + bad]
    off = np.cumsum([0, *map(len, texts)])
    sizes = quality._sizes(np.frombuffer(b"".join(texts), np.uint8), off, dicts)
    diff = sizes[:, 0] - sizes[:, 1]
    assert diff[1] < -100 and abs((diff[3] - diff[2]) / diff[1] - 1) < 0.2


def test_quality_sample_is_one_text_an_id(labelled):
    docs, labels, truth = labelled
    often = docs
    for _ in range(5):  # 32 rows an id
        often = often.union(often.where("doc_id < 100"))
    a, b = quality.fit(docs, labels), quality.fit(often, labels)
    assert a.dicts == b.dicts and (a.weights == b.weights).all()
    other = docs.union(docs.withColumn("text", F.concat(F.lit("another "), "text")))
    assert sum(r["n"] for r in quality._one_text(other.withColumn("y", F.lit(1))).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()) == len(truth)


def test_quality_edges(docs_of, labelled, shipped):
    docs, labels, _ = labelled
    odd = docs_of([(1, None), (1, ""), (None, "x"), (2, "y " * 50_000)])
    assert len(quality.fit(docs, labels).score(odd).collect()) == 4
    none = quality.fit(docs, labels.limit(0)).score(odd).collect()
    assert {r["score"] for r in none} == {0.5}
    only = quality.fit(docs, labels.where("quality = 1")).score(odd).collect()
    assert {r["score"] for r in only} == {1.0}
    left = quality.reject_low_quality(docs, labels)
    assert left.columns == docs.columns and 200 < left.count() < 350
    assert quality.fit(docs_of([]), labels).score(docs_of([])).collect() == []


def test_pipeline_stages(shipped, tmp_path_factory, docs_of, corpus):
    import corpus_pipeline as cp
    d = str(tmp_path_factory.mktemp("sf"))
    bench_item = " ".join(dict(corpus)[62].split()[50:70])
    docs_of(corpus).write.parquet(f"{d}/documents.parquet")
    shipped.createDataFrame([(1, bench_item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    shipped.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    docs = shipped.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, step in cp.STAGES:
        out = step(shipped, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        docs = cp.stage(out)
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert seen["quality_classifier"] == {i for i, _ in corpus}  # no labels, nothing rejected
    assert 2 not in seen["line_dedup"] and 1 in seen["line_dedup"]
    assert {1, 3} & seen["minhash_dedup"] == {1} and 3 in seen["line_dedup"]
    assert seen["minhash_dedup"] < seen["line_dedup"]
    assert 62 in seen["minhash_dedup"] and 62 not in seen["decontamination"]
    assert seen["packing"] == seen["decontamination"]
    whole = cp.run(shipped, d)
    assert {r["doc_id"] for r in whole.collect()} == seen["packing"]


def test_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names
