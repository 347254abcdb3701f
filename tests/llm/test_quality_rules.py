"""Quality rules (operator 13) against brute force, and their defined cases."""

import random
import re

from pyspark.sql import functions as F

from tixflow.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def test_metrics_against_brute_force(docs_of, corpus):
    rng = random.Random(3)
    rows = corpus + [(100 + i, "".join(rng.choice(["ab", "c", "é", " ", " ", "\n", "\t", "#", "|<"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(500 + i, " ".join(rng.choice("ab c d").replace(" ", "") for _ in range(i))) for i in range(40)]
    rows += [(600, "x " * 30_000), (601, " ".join(f"v{i}" for i in range(30_000))), (602, "a b c"), (603, "a b c a b c"), (604, "\x0b \x0c\r\n"), (605, "😀 #😀 |" * 20)]
    got = {r["doc_id"]: r.asDict() for r in Q.apply_rules(docs_of(rows, clash=True)).collect()}
    for i, t in rows:
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, (i, t)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_rules_and_kept_columns(docs_of):
    plain = " ".join(["the house of the bird and a tree in that field was green"] * 1 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of it" for i in range(30)])
    rows = [(1, plain), (2, plain + " ###" * 40), (3, None), (4, plain.replace("the ", "").replace(" of it", "")), (None, plain), (1, plain)]
    judged = Q.apply_rules(docs_of(rows, clash=True))
    got = {(r["doc_id"], r["text"]): r["failed"] for r in judged.collect()}
    assert got[(1, plain)] == [] and "symbols" in got[(2, rows[1][1])] and got[(3, None)][0] == "few_words"
    left = Q.drop_failing(docs_of(rows, clash=True).withColumn("failed", F.lit("own")).withColumn("n_words", F.lit(-1)))
    assert left.columns == [*docs_of(rows, clash=True).columns, "failed", "n_words"]
    assert sorted((str(r["doc_id"]), r["failed"], r["n_words"]) for r in left.collect()) == [("1", "own", -1), ("1", "own", -1), ("None", "own", -1)]
    assert Q.apply_rules(docs_of([])).collect() == [] and Q.drop_failing(docs_of([])).collect() == []


def test_own_table_of_rules(docs_of):
    rules = [Q.Rule("long", "n_words", ">", 2), Q.Rule("loud", "n_symbols", ">", 1, "n_words", 2)]
    got = {r["doc_id"]: (r["failed"], r["base_failed"]) for r in Q.apply_rules(docs_of([(1, "a b"), (2, "a b c"), (3, "#"), (4, "")]), rules).collect()}
    assert got == {1: ([], False), 2: (["long"], False), 3: (["loud"], False), 4: ([], False)}


def test_plan_is_one_native_projection(docs_of):
    plan = Q.apply_rules(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan and "ObjectHashAggregate" not in plan
