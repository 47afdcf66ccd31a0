"""Exact and near deduplication against brute force on small awkward tables."""
import collections
import hashlib
import itertools

import numpy as np
import pytest

from barweave.llm import exact_dedup as X
from barweave.llm import near_dedup as N

SCHEMA = "doc_id long, text string, fp_a string, text_key int, node string, part int, n_rows int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, 3, 4) for i, t in rows], SCHEMA)


def lowered(t):
    return (t or "").translate(str.maketrans(X.UPPER, X.LOWER))


AWKWARD = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "É"), (8, "É"), (None, "abc"), (None, "solo"), (None, "solo"),
           (9, "ab\0c"), (10, "Ab" * 700_000), (11, "aB" * 700_000), (12, "aB" * 700_000 + "c"), (13, "dup"), (13, "DUP"), (14, "other"), (14, "text")]


def expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda v: (v is None, v)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"part_bytes": 1000}, {"part_bytes": 2, "primes": (3, 5), "bases": (2, 2)}], ids=["plain", "parts", "collisions"])
def test_exact_groups(spark, how):
    rows = AWKWARD if "primes" not in how else [(i, t[:9] if t else t) for i, t in AWKWARD] + [(100 + i, f"{i:03d}") for i in range(60)]
    got = X.exact_groups(docs(spark, rows), **how)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_exact_drop_keeps_one_row_of_each_text(spark):
    d = docs(spark, AWKWARD)
    got = X.drop_exact(d)
    assert got.columns == d.columns
    assert sorted(((r["doc_id"], lowered(r["text"])) for r in got.collect()), key=str) == sorted(
        {(e[0], t) for t in {lowered(t) for _, t in AWKWARD} for e in expected(AWKWARD) if e[3] and e[4] == hashlib.sha256(t.encode()).hexdigest()}, key=str)


def test_exact_empty_table(spark):
    assert X.exact_groups(docs(spark, [])).count() == 0 and X.drop_exact(docs(spark, [])).count() == 0


def test_fingerprints_combine():
    rng, h = np.random.default_rng(3), X.Hasher()
    buf = rng.integers(0, 256, 50_000).astype(np.uint8)
    whole, left, right, empty = h(buf, [0, 0, 12_345, 7], [50_000, 12_345, 50_000, 7])
    assert X.combine(left, right, 50_000 - 12_345) == tuple(map(int, whole)) and not empty.any()
    for c, (b, p) in enumerate(zip(X.BASES, X.PRIMES)):
        v = 0
        for x in buf[:3000].tolist():
            v = (v * b + x) % p
        assert v == int(h(buf, [0], [3000])[0, c])


def brute(rows):
    bags = [N.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or (bags[i] and bags[j] and N.bag_similarity(bags[i], bags[j]) >= N.SIMILARITY):
            parent[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i][0])
    return sorted(sorted(g, key=str) for g in out.values())


def near_rows():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    rows, i = [], 0
    for _ in range(12):  # an original and copies of it, each with edits of its own
        base = [word() for _ in range(int(rng.integers(40, 200)))]
        for _ in range(6):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    shared = " ".join(word() for _ in range(60))
    rows += [(1000 + k, shared + " " + " ".join(word() for _ in range(int(rng.integers(5, 90))))) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "   "), (2003, "one two"), (2004, "One, two!"), (2005, "*** ###"), (2006, "x y z w v " * 400), (2007, "x y z w v " * 480), (2008, "x y z w v " * 700)]
    return rows


@pytest.mark.parametrize("cell", [256, 3])
def test_near_groups_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL", cell)
    rows = near_rows()
    got = N.near_groups(docs(spark, rows))
    r = got.collect()
    groups = collections.defaultdict(list)
    for x in r:
        groups[x["class_id"]].append(x["doc_id"])
    assert sorted(sorted(g, key=str) for g in groups.values()) == brute(rows)
    assert all(x["class_id"] == min(groups[x["class_id"]]) and x["group_size"] == len(groups[x["class_id"]]) and x["kept"] == (x["doc_id"] == x["class_id"]) for x in r)
    d = docs(spark, rows)
    kept = N.drop_near(d)
    assert kept.columns == d.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(x["doc_id"] for x in r if x["kept"])


def test_near_repeats_nulls_and_nothing(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "lonely text"), (3, "A b c d, e f g!")]
    got = sorted(map(tuple, N.near_groups(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 4, True), (1, 1, 4, False), (None, 1, 4, False), (3, 1, 4, False), (None, None, 1, True)], key=str)
    assert N.drop_near(docs(spark, rows)).count() == 2
    assert N.near_groups(docs(spark, [])).count() == 0 and N.near_groups(docs(spark, [(1, None), (2, "")])).where("kept").count() == 1


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for heaviest in (1, 5, 40):
        a = np.repeat(rng.integers(0, 2 ** 63, 150).astype(np.uint64), rng.integers(1, heaviest + 1, 150))
        b = np.concatenate([a[:int(len(a) * 0.8)], rng.integers(0, 2 ** 63, 30).astype(np.uint64)])
        ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
        true = sum((ca & cb).values()) / sum((ca | cb).values())
        s = N.signatures([a, b], 4000)
        assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4000)
        alone = N.signatures([b], 4000)  # what else is signed does not matter
        assert (alone[0] == s[1]).all()


def test_cells_of_a_hot_bucket_grow_with_its_texts(spark):
    """A large class and some strangers: the class is sent once, not once per block; every pair of different classes meets."""
    rows = [("k", f"n{i:05d}", "big") for i in range(3000)] + [("k", f"s{i}", f"s{i % 2}") for i in range(3)] + [("k", f"m{i:04d}", "mid") for i in range(300)] + [("j", "n00001", "big"), ("j", "s1", "s1")]
    open_ = spark.createDataFrame([(k, n.encode(), r.encode()) for k, n, r in rows], "key string, node binary, root binary")
    cells = N._cells(open_).collect()
    assert len(cells) < 5 * len(rows)  # two large classes: 12 blocks meet 2
    met, members = set(), {}
    for c in cells:
        members.setdefault((c["key"], c["lo"], c["hi"]), []).append((c["side"], bytes(c["node"]), bytes(c["root"])))
    for (key, lo, hi), m in members.items():
        assert len(m) <= 2 * 2 * N.CELL
        met |= {(key, *sorted((a[1], b[1]))) for a in m for b in m if a[2] != b[2] and (lo == hi or a[0] != b[0])}
    want = {(k, *sorted((a.encode(), b.encode()))) for k, a, x in rows for q, b, y in rows if k == q and x != y}
    assert met == want
