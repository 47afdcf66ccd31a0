"""Word-end byte-pair coding, term-pipeline search and whitening."""
import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from barweave.llm import lexical as X
from barweave.llm import whitening as H
from barweave.llm import word_bpe as W

SF = "/root/testdata/sf0.01"
HARD = ["", "a" * 5000, "ab" * 3000 + "  \n x", "=-" * 2000, "日本語テスト🙂 mixed" * 60, "Σίσυφος ΟΔΟΣ ΣΑΣ", "it's <|endoftext|>x<|startoftext|><|endoftext|>", "é<|endoftext|>́",
        "İstanbul é Å", "<|ENDOFTEXT|>", "<|endoftext|", "\u0000\u0001  \t\r\n ", "they'LL've 12 3", "​­"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(W.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_rank_arrays_agree():
    import public_tokenizers
    coder, rng = W.WordCoder(public_tokenizers.path(W.VOCABULARY)), random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("abcde-") for _ in range(rng.randint(1, 600)))
        assert W.join_parts(s + "</w>", len(s), coder.ranks) == W.join_long(s + "</w>", len(s), coder.ranks, rng.choice([2, 7, 512]))


def test_word_codes_equal_the_library(spark, library):
    import public_tokenizers
    coder = W.WordCoder(public_tokenizers.path(W.VOCABULARY), keep=50)  # so small that words are forgotten
    texts = HARD + ds.dataset(f"{SF}/documents.parquet").to_table(columns=["text"]).column(0).to_pylist()[:150]
    for t in texts:
        ids, text = expected(library, t)
        assert coder.encode(t or "") == ids and coder.decode(ids) == text == coder.decode_words(coder.word_ids(t or ""))
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, "null id", 1, None), (3, None, 2, "y"), (3, "again", 2, "y"), (3, "again", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, value string")
    want = sorted((-1 if r[0] is None else r[0], len(e[0]), hashlib.sha256(np.array(e[0], "<u4").tobytes()).hexdigest(), hashlib.sha256(e[1].encode()).hexdigest())
                  for r in rows for e in [expected(library, r[1])])
    assert sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in W.round_trip(docs).collect()) == want
    back = W.decode_documents(W.encode_documents(docs.where("doc_id < 10"))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((r[0], expected(library, r[1])[1]) for r in rows if r[0] is not None and r[0] < 10)
    assert W.round_trip(docs.limit(0)).count() == 0


def test_characters_equal_the_library(library):
    import unicodedata

    import public_tokenizers
    coder = W.WordCoder(public_tokenizers.path(W.VOCABULARY))
    for c in (chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000):
        if unicodedata.category(c) != "Cn":
            s = f"a{c}b{c}{c}1"
            assert coder.encode(s) == expected(library, s)[0], hex(ord(c))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=10):
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, words = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df, out = collections.Counter(t for _, c in counts for t in c), []
    for item, text in items:
        asked, found = collections.Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // words if c else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * k * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, f[2], -f[0]) for r, f in enumerate(sorted(found)[:top])]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "W%d" % min(int(rng.expovariate(0.02)), 400)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + " Common") for i in range(700)]
    docs += [(1000 + i, "Common copies of Ö-one w3 w4") for i in range(90)]  # ties beyond the tenth place
    docs += [(2000, None), (2001, ""), (2002, " -.! "), (2003, "w1 " * 30000), (None, "w7 common Ö"), (1000, "w9 w9"), (1000, "w9 w9")]
    items = [(i, " ".join(word() for _ in range(25)) + " common") for i in range(30)] + [(50, "copies one w3"), (51, None), (52, "..."), (53, "nowhere"), (54, "ö Ö Ö COMMON common"), (None, "w9 w1"), (50, "w9")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, row int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    want = sorted(brute_search(docs, items), key=str)
    assert rows_of(X.search(d, q)) == want
    assert rows_of(X.search(d, q, slice_rows=40, block_items=4, tiers=(200, 8))) == want  # many slices and blocks
    assert rows_of(X.search(d, q, tiers=())) == want
    assert X.search(d.limit(0), q).count() == 0 and X.search(d, q.limit(0)).count() == 0


def test_accumulators_are_dropped_between_stages(spark):
    """Documents that hold frequent terms only never outlive the stage, once ten better ones are known."""
    docs = spark.createDataFrame([(i, "the of " + ("rare word " * 3 if i < 12 else "filler")) for i in range(3000)], "doc_id long, text string")
    got = X.search(docs, spark.createDataFrame([(1, "the rare word of")], "item_id long, text string"))
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(10))


def test_terms_of_all_characters():
    for c in (chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000):
        s = f"A{c}B"
        assert [t.decode() for t in X.terms_of(s) if t] == TERM.findall(s.translate(LOWER))


@pytest.mark.parametrize("values", [[5.0], [3.0] * 40, [2.0] * 20 + [1.0] * 21, [10.0 ** -i for i in range(30)], list(range(60)), [0.0] * 5, [4.0, -4.0, 4.0, -4.0]])
def test_spectrum(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    e, v = H.spectrum((a + a.T) / 2)
    size = max(1e-30, np.abs(values).max())
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-13 * size
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13 * size


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, component int, v double")


def test_whitening_equals_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    x[:, 11] = 0.25  # a constant dimension gives no component
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[3].tolist()), (500, [0.0] * 11 + [0.25])]
    bad = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [1.0] * 11)]
    got = H.whitened_components(vectors(spark, rows + bad).repartition(5)).toPandas()
    whole = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in rows])
    n = len(whole)
    cov = np.cov((whole - whole.mean(axis=0)).T, bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:11], v[:, ::-1][:, :11]
    assert len(got) == n * 11 and set(got.n) == {n} and set(got.component) == set(range(1, 12)) and (got.identity_error < 1e-9).all()
    want = (whole - whole.mean(axis=0)) @ v / np.sqrt(e)
    for i in (0, 5, 399):
        mine = got[got.vec_id == i].sort_values("component")
        assert np.allclose(np.abs(mine.whitened), np.abs(want[i]), atol=1e-7) and np.allclose(mine.explained, e / np.trace(cov), rtol=1e-9)
        assert set(mine.deviation) == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(whole[i], whole.sum(axis=0)))}
    assert len(got[got.vec_id == 7]) == 22 and got.vec_id.isna().sum() == 11


def test_whitening_of_odd_tables(spark):
    some = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert H.whitened_components(some).count() == 0  # nothing varies
    assert H.whitened_components(some.limit(0)).count() == 0 and H.whitened_components(vectors(spark, [(1, []), (2, None)])).count() == 0
    assert H.whitened_components(some.limit(0)).columns == H.whitened_components(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 3.0])])).columns
    with pytest.raises(ValueError, match="more than one length"):
        H.whitened_components(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="too large"):
        H.whitened_components(vectors(spark, [(1, [1e30, 0.0]), (2, [1.0, 2.0])]))


def test_deviations_that_need_more_than_doubles():
    m = H.Whitening(3, np.array([3000001, 3 * 10 ** 6]), np.ones(1), np.ones((2, 1)), 1.0)
    assert m.deviations(np.array([[1000000, 1000000]])) == [1]
    far = H.Whitening(2 ** 30, np.array([0]), np.ones(1), np.ones((1, 1)), 1.0)
    with pytest.raises(OverflowError):
        far.deviations(np.array([[2 ** 20]]))


def test_queries_on_given_tables(spark):
    from barweave.llm.queries import QUERIES
    got = QUERIES["op12_term_pipeline_search"](spark, SF)
    docs, items = ([tuple(r.values()) for r in ds.dataset(f"{SF}/{t}.parquet").to_table(columns=[c, "text"]).to_pylist()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(got.select("item_id", "rank", "doc_id", "score")) == sorted(brute_search(docs, items), key=str)
    got = QUERIES["op13_qdwh_whitening"](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where(H.usable(F.col("embedding"))).count()
    assert got.count() == 32 * n and got.agg(F.max("identity_error")).first()[0] < 1e-9
