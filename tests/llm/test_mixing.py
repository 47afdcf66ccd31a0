"""Apportionment, targets and the mix against brute force."""
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from barweave.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, shard int, target int, cut_start int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """The stated rule in exact arithmetic: share out by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = Fraction(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def brute_seats(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda k: (Fraction(votes[k], 2 * won[k] + 1), -k))
        won[i] += 1
    return won


def test_sainte_lague(spark):
    rng = random.Random(4)
    cases = [([rng.choice([0, 1, 3, 17, 400, 12345]) for _ in range(rng.randint(1, 9))], rng.randint(0, 90)) for _ in range(25)]
    cases = [c for c in cases if sum(c[0])] + [([5, 5, 5], 4), ([1], 7), ([100, 1, 1, 1, 1], 3), ([1] * 30, 2)]
    rows = [(c, i, float(v), s) for c, (votes, s) in enumerate(cases) for i, v in enumerate(votes)]
    got = M.apportion(spark.createDataFrame(rows, "c int, i int, v double, s int"), ["c"], "v", "s", ["i"])
    have = {(r["c"], r["i"]): r["quota"] for r in got.collect()}
    for c, (votes, s) in enumerate(cases):
        assert [have[c, i] for i in range(len(votes))] == brute_seats(votes, s), (votes, s)


def rows_of(seed=2, n=400):
    rng = random.Random(seed)
    text = lambda k: " ".join("w%d" % rng.randrange(999) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60)), "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", "z", None])) for i in range(n)]
    return rows + [(1000, None, "a"), (1001, "", None), (1002, text(9000), "z"), (1003, " \t\n\x0b\x0c\r", "nothing"), (None, text(30), "a"), (1004, "x y\x1fz", "B")]


@pytest.mark.parametrize("how", [{}, {"block": 4, "shard_rows": 25}], ids=["plain", "shards"])
def test_mixture(spark, how):
    rows = rows_of()
    got = M.mixture(docs(spark, rows), **how)
    r = got.collect()
    assert len(r) == len(rows)
    size = {(i, t): len(re.findall(M.WORD, t or "")) for i, t, _ in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i, t]
    goal = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for x in r:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - float(goal[x["source"]])) < 1e-6
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert sorted(x["size"] for x in r) == sorted(size.values())
    slack = 2 * how.get("block", M.BLOCK) * (1 + len(rows) / how.get("shard_rows", 1e9))
    assert all(abs(taken[s] - goal[s]) <= slack for s in sizes), (taken, goal)
    again = M.mixture(docs(spark, rows[::-1]).repartition(3), **how)
    key = lambda x: str((x["doc_id"], x["source"], x["taken"]))
    assert sorted(map(key, again.collect())) == sorted(map(key, r))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_targets_that_all_reach_their_cap_or_are_empty(spark):
    got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame([("a", 10), ("b", 0), (None, 0)], "source string, source_size long")).collect()}
    assert got["a"] == 15.0 and got["b"] == 0 and got[None] == 0
    assert M.mixture(docs(spark, [])).count() == 0 and M.mixed_documents(docs(spark, [])).count() == 0
    zero = M.mixture(docs(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [r["taken"] for r in zero] == [0, 0]


def test_mixed_documents_hold_the_taken_words(spark):
    rows = rows_of() + [(5000, "same row here", "a")] * 3
    d = docs(spark, rows)
    plan = M.mixture(d).groupBy("doc_id").agg(F.sum("taken").alias("taken")).where("taken > 0")
    want = {r["doc_id"]: r["taken"] for r in plan.collect()}
    mix = M.mixed_documents(d)
    assert mix.columns == d.columns
    have, texts = {}, {i: t for i, t, _ in rows}
    for r in mix.collect():
        words = re.findall(M.WORD, r["text"])
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + len(words)
        whole = re.findall(M.WORD, texts[r["doc_id"]])
        assert words == whole or " ".join(words) in " ".join(whole) or len(words) < len(whole)
    assert have == want
    assert "Python" not in mix._jdf.queryExecution().executedPlan().toString()


def test_small_sources_keep_their_words(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(100)), "large") for i in range(20)] + [(100 + i, "a b c", f"small {i}") for i in range(12)]
    taken, goal = {}, {}
    for r in M.mixture(docs(spark, rows)).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal), (taken, goal)
    mix = M.mixed_documents(docs(spark, rows)).groupBy("source").count().collect()
    assert {r["source"] for r in mix} == set(goal)


def test_own_column_names_do_not_clash(spark):
    """Every name that an operator uses inside, as a column of the table."""
    import re as regex
    from barweave.llm import common, exact_dedup, near_dedup, quality
    source = "".join(open(m.__file__).read() for m in (common, exact_dedup, near_dedup, M, quality))
    names = sorted({n for n in regex.findall(r'"([a-z_]\w*)"', source) if n not in ("doc_id", "text", "source", "lang")} | {"c0", "c1", "_keep_rows", "_mix_id", "_piece"})
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, "A b c d e f g", "y"), (4, None, None), (4, None, None)]
    d = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ", ".join(["doc_id long, text string, source string", *(f"`{n}` int" for n in names)]))
    assert [r["doc_id"] for r in exact_dedup.drop_exact(d).orderBy("doc_id").collect()] == [3, 4]
    assert [r["doc_id"] for r in near_dedup.drop_near(d).orderBy("doc_id").collect()] == [1, 4]
    mix = M.mixed_documents(d)
    assert mix.columns == d.columns and {r["doc_id"] for r in mix.collect()} == {1, 2, 3}
    assert exact_dedup.exact_groups(d).count() == near_dedup.near_groups(d).count() == M.mixture(d).count() == 5
    assert quality.keep_good(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).columns == d.columns
