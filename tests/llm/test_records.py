"""Nearest neighbours, tool calls, fixity and the pipeline against brute force."""
import hashlib
import json
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.llm import ann, fixity
from barweave.llm import tool_calls as C
from barweave.llm.queries import ORACLES, QUERIES

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def brute_nearest(rows, k):
    items = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    dims = [len(v) for _, v in good]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    good = [(i, v) for i, v in good if len(v) == dim]
    for q, x in good:
        if q % 100:
            continue
        best = items.setdefault(q, {})
        for i, v in good:
            if i != q:
                d = math.sqrt(((x - v) ** 2).sum())
                best[i] = min(best.get(i, math.inf), d)
    return {q: sorted(b.items(), key=lambda t: (t[1], t[0]))[:k] for q, b in items.items() if b}


def run_ann(spark, rows, **how):
    d = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, leaf int, v int, q string")
    out = {}
    for r in ann.nearest(d, F.col("vec_id") % 100 == 0, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def test_nearest_with_bad_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(rng.integers(-2, 3, 4))) for i in range(0, 700, 7)] + [(i, f(rng.standard_normal(4))) for i in range(1000, 1300)]
    rows += [(100, None), (200, [0.0] * 4), (300, [1.0, None, 0.0, 2.0]), (5, f([1, 2, 3])), (6, [math.nan, 1.0, 1.0, 1.0]), (8, [math.inf, 1.0, 1.0, 1.0]), (9, []), (None, f([1, 1, 1, 1]))]
    rows += [rows[0]] * 30 + [(7, f([1, 0, 0, 0])), (7, f([0, 1, 0, 0]))]
    got, want = run_ann(spark, rows), brute_nearest(rows, 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = run_ann(spark, rows, max_leaves=1)  # one leaf: everything is searched
    assert {q: [(i, round(s, 12)) for i, s, _ in v] for q, v in exact.items()} == {q: [(i, round(s, 12)) for i, s in v] for q, v in want.items()}
    assert all([r for _, _, r in v] == list(range(1, len(v) + 1)) for v in got.values())


def test_nearest_of_few_and_none(spark):
    assert run_ann(spark, []) == {} and run_ann(spark, [(0, [1.0, 2.0])]) == {} and run_ann(spark, [(0, None), (100, [0.0])]) == {}
    assert run_ann(spark, [(0, [3.0, 4.0]), (1, [0.0, 1.0])]) == {0: [(1, math.sqrt(18), 1)]}
    copies = run_ann(spark, [(i, [1.0, 1.0]) for i in range(0, 6000)] + [(9001, [1.0, 2.0])])
    assert copies[100] == [(i, 0.0, i + 1) for i in range(10)]


@here
def test_recall_on_the_tables(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op6_kmeans_tree_ann"](spark, SF).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in d.collect()]
    want = brute_nearest(rows, 10)
    hits = sum(len(set(g["vec_id"]) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values()))
    true = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(true[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got.itertuples() if (r.query_id, r.vec_id) in true)


# ---- tool calls ----------------------------------------------------------------------------------

def linked(spark, calls, results):
    c = spark.createDataFrame([(*r, "x") for r in calls], "conv long, turn long, call_id string, tool string, arguments string, parent string, level string")
    r = spark.createDataFrame([(*r, 1) for r in results], "conv long, turn long, call_id string, content string, status int")
    out = C.link_calls(c, r, C.TOOLS).collect()
    return {(x["conv"], x["call_id"]): x.asDict() for x in out}, out


GOOD = '{"limit": 5, "query": "a"}'


def test_links_and_statuses(spark):
    calls = [(1, 1, "a", "search", GOOD, None), (1, 3, "b", "search", '{"query":"b","limit":51,"more":1}', "a"), (1, 5, "c", "nope", "{}", "b"), (1, 7, "d", "fetch", "not json", "zz"),
             (1, 9, "a", "search", GOOD, None), (1, 11, None, "search", GOOD, None), (None, 1, "a", "calculate", '{"precision":1.5,"expression":"1+1"}', None),
             (2, 1, "x", "search", GOOD, "y"), (2, 2, "y", "search", GOOD, "x"), (2, 3, "z", "search", GOOD, "x"), (3, 5, "late", "fetch", '{"url":"u","method":"PUT"}', None), (4, 1, "n", None, None, None)]
    results = [(1, 2, "a", '{"z":1,"a":[1,2]}'), (1, 4, "b", "plain é"), (1, 4, "b", "again"), (None, 2, "a", None), (3, 1, "late", "early"), (5, 1, "ghost", "boo"), (5, 2, None, "x")]
    got, rows = linked(spark, calls, results)
    assert len(rows) == 11 and got[1, "a"]["status"] == "linked" and got[1, "a"]["problems"] == ["repeated call id"] and got[1, "a"]["turn"] == 1
    assert got[1, "a"]["json"] == '{"call":{"arguments":{"limit":5,"query":"a"},"name":"search"},"id":"a","result":{"a":[1,2],"z":1}}'
    assert got[1, "b"]["problems"] == ["$.limit: above 50", "$.more: not known", "repeated result"] and json.loads(got[1, "b"]["json"])["result"] == "again"
    assert got[1, "c"]["problems"] == ["no such tool"] and got[1, "c"]["status"] == "unanswered" and got[1, "c"]["level"] == 2
    assert got[1, "d"]["problems"] == ["$: not JSON", "unknown parent"] and got[1, "d"]["level"] == 0
    assert [got[1, x]["place"] for x in "adbc"] == [0, 1, 2, 3]
    assert got[None, "a"]["problems"] == ["$.precision: not of type integer"] and got[None, "a"]["status"] == "linked"
    assert all(got[2, x]["place"] is None and got[2, x]["level"] is None and "cycle" in got[2, x]["problems"] for x in "xyz")
    assert got[3, "late"]["status"] == "early" and got[5, "ghost"]["status"] == "orphan" and not got[5, "ghost"]["valid"]
    assert got[4, "n"]["problems"] == ["$: not JSON"]


def test_levels_of_long_chains_and_hot_conversations(spark):
    rng = random.Random(3)
    calls, level = [], {}
    for t in range(1500):  # one conversation holds most calls, in a chain of a hundred and in random trees
        parent = t - 1 if 0 < t < 100 else rng.choice([None, rng.randrange(t)]) if t else None
        level[t] = 0 if parent is None else level[parent] + 1
        calls.append((7, t, f"k{t}", "search", GOOD, None if parent is None else f"k{parent}"))
    got, _ = linked(spark, calls, [])
    assert {t: got[7, f"k{t}"]["level"] for t in level} == level
    order = sorted(level, key=lambda t: (level[t], t))
    assert [got[7, f"k{t}"]["place"] for t in order] == list(range(1500))


def test_nothing_to_link(spark):
    assert linked(spark, [], []) == ({}, [])


def test_schema_rules():
    s = {"type": "object", "properties": {"a": {"type": "array", "minItems": 2, "items": {"type": "number", "minimum": 0}}, "b": {"type": "boolean"}, "c": {"enum": [1, "x"]}}, "required": ["b"]}
    assert C.violations({"a": [1, -1], "b": 1, "c": "y"}, s) == ["$.a[1]: below 0", "$.b: not of type boolean", "$.c: not among the allowed values"]
    assert C.violations({"a": [True]}, s) == ["$.b: missing", "$.a: too short", "$.a[0]: not of type number"] and C.violations([], s) == ["$: not of type object"]
    assert C.parse("NaN")[1] and C.parse(None)[1] and C.parse("[" * 100_000)[1] and C.canonical({"b": 1, "a": "\ud800"}) == '{"a":"\\ud800","b":1}'


# ---- fixity --------------------------------------------------------------------------------------

def test_audit_finds_every_difference(spark):
    rng = random.Random(6)
    a, b, want = [], [], {}
    for f in range(5):
        at = 0
        for _ in range(300 if f else 2500):
            n = rng.choice([10, 50, 400])
            d = hashlib.sha256(str((f, at)).encode()).hexdigest()
            a.append((f"f{f}", at, n, d))
            fate = rng.random() if f != 2 else 1
            if fate < 0.01:
                want[f"f{f}", at] = "missing"
            elif fate < 0.02:
                b.append((f"f{f}", at, n, "00" + d[2:]))
                want[f"f{f}", at] = "content"
            elif fate < 0.03:
                b.append((f"f{f}", at, n // 2, d))
                want[f"f{f}", at] = "length"
            else:
                b.append((f"f{f}", at, n, d))
                if fate < 0.04:
                    b.append((f"f{f}", at + 1, 3, d))
                    want[f"f{f}", at + 1] = "extra"
            at += n
    b.append(("new", 0, 1, "d"))
    want["new", 0] = "extra"
    a.append(("gone", 7, 1, None))
    want["gone", 7] = "missing"
    a += [(None, 1, 1, "x"), ("f0", None, 1, "x")]
    schema = "file string, offset long, length long, digest string"
    x, y = (spark.createDataFrame(t, schema).withColumn("r", F.lit(1)).withColumn("hash", F.lit("h")) for t in (a, b))
    got = {(r["file"], r["offset"]): r["kind"] for r in fixity.audit(x, y, width=256, fanout=4).collect()}
    assert got == want and fixity.audit(x, y).count() == len(want)
    assert fixity.audit(x, x).count() == 0 and fixity.audit(x.limit(0), y.limit(0)).count() == 0 and fixity.audit(x.limit(0), y).count() == len(b)


def test_page_records(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é", 0), (1, "u", "<p>é", 0), (2, None, None, 0), (1005, "v", "", 0), (None, "w", "x" * 200_000, 0)], "page_id long, url string, html string, offset int")
    r = fixity.page_records(pages).collect()
    assert len(r) == 5 and {x["file"] for x in r if x["page_id"] is not None} == {"seg-0", "seg-1"}
    one = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\nContent-Length: 5\r\n\r\n<p>é\r\n\r\n".encode()
    ones = sorted(x["offset"] for x in r if x["page_id"] == 1)
    assert ones == [0, len(one)] and {x["digest"] for x in r if x["page_id"] == 1} == {hashlib.sha256(one).hexdigest()}
    assert fixity.page_records(pages.limit(0)).count() == 0


# ---- registered queries --------------------------------------------------------------------------

@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import TABLES, diff, normal
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert diff(normal(QUERIES[name](spark, SMALL).toPandas()), normal(con.execute(ORACLES[name]).fetchdf())) == ""


@here
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as P
    from barweave.llm import bpe, exact_dedup, mixing, near_dedup, quality
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = docs.toPandas()
    model = quality.fit_documents(docs, labels)
    good = rows[np.array([quality.scores(model, [t])[0] for t in rows.text]) >= 0.5]
    low = good.text.map(lambda t: t.translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)))
    kept = good[good.doc_id == good.groupby(low).doc_id.transform("max")].reset_index(drop=True)
    bags = [near_dedup.shingles(t) for t in kept.text]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if label[i] != label[j] and near_dedup.bag_similarity(bags[i], bags[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    alone = kept[kept.doc_id == kept.groupby(label).doc_id.transform("min")]
    got = docs
    for name, stage in P.STAGES[:3]:
        got = spark.createDataFrame(stage(spark, got, SMALL).toPandas(), docs.schema)
    assert sorted(got.toPandas().doc_id) == sorted(alone.doc_id) and got.columns == docs.columns
    mix = P.mixing(spark, got, SMALL)
    assert mix.columns == docs.columns
    mixed = mix.toPandas()
    size = lambda t: len(pd.Series(t).str.findall(mixing.WORD).iloc[0])
    words = mixed.text.map(size).groupby(mixed.source).sum()
    goal = mixing.mixture(got).groupBy("source").agg(F.first("target").alias("t")).toPandas().set_index("source").t
    assert (abs(words - goal) <= 2 * mixing.BLOCK + 2).all() and (mixed.n_chars == mixed.text.str.len()).all()
    coder = bpe.Coder(*bpe.default_ranks())
    want = sorted((r.doc_id, len(coder.encode(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.itertuples())
    out = P.run(spark, SMALL)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out.collect()) == want


def test_schema_rules_that_were_passed_over():
    for schema, good, bad in (
            ({"maxLength": 2}, "ab", "abc"), ({"maxItems": 1}, [1], [1, 2]), ({"pattern": "^a"}, "ab", "ba"), ({"const": 1}, 1.0, True),
            ({"exclusiveMinimum": 0}, 0.1, 0), ({"exclusiveMaximum": 5}, 4, 5), ({"type": ["string", "null"]}, None, 3),
            ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 3, 2), ({"oneOf": [{"minimum": 3}, {"maximum": 5}]}, 6, 4),
            ({"allOf": [{"minimum": 3}, {"maximum": 5}]}, 4, 6), ({"enum": [1]}, 1, True), ({"additionalProperties": {"type": "string"}}, {"a": "x"}, {"a": 1})):
        assert C.violations(good, schema) == [] and len(C.violations(bad, schema)) == 1, schema
    C.check_schema({"type": "object", "properties": {"a": {"title": "x", "items": {"const": 1}}}})
    for schema in ({"multipleOf": 2}, {"properties": {"a": {"format": "uri"}}}, {"type": "text"}, {"items": [{}]}):
        with pytest.raises(ValueError):
            C.check_schema(schema)


def test_json_that_is_none_is_refused():
    import json
    from barweave.llm import tool_calls as T
    for bad in ("1e999", '{"a": -1e400}', '{"limit": 3, "limit": 99}', '[{"x": {"k": 1, "k": 1}}]', "NaN", "[Infinity]"):
        assert T.parse(bad) == (None, "$: not JSON"), bad
    assert T.canonical(T.parse('{"b": 1.0, "a": [2.50, 1e2, -0.0, true]}')[0]) == '{"a":[2.5,100,0,true],"b":1}'
    assert json.loads(T.canonical({"id": "x", "call": {"name": "f", "arguments": "1e999"}, "result": None}))["call"]["arguments"] == "1e999"


def test_pipeline_stages_leave_tables_of_others(spark):
    import corpus_pipeline as P
    from barweave.session import reuse
    other = reuse(spark.range(7))
    d = spark.createDataFrame([(1, "a b c d e f", "en", "x"), (2, "A b c d e f", "en", "x"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    kept = P.exact(spark, d, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert P.mixing(spark, d, None).columns == d.columns  # a table without n_chars
    assert other.count() == 7
    for _, stage in P.STAGES[1:]:
        assert stage(spark, d.limit(0), None).count() == 0
