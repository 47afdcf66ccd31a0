"""Token files, byte-pair coding, quality scores and licence notices."""
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import bpe as B
from barweave.llm import licenses as L
from barweave.llm import quality as Q
from barweave.llm import token_scan as T

SF = "/root/testdata/sf0.01"
HARD = ["", "a" * 5000, "ab" * 3000 + "  \n x", "日本語テスト🙂 mixed", "\u0000\u0001  \t\n  ", "é" * 777, "it's 12 o'clock, they'll  say \r\n\r\n", " ", "​­", "<|endoftext|>"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, ids int, file string, score double")


def brute_spans(tokens, end):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("block,scan", [(2, 3), (6, 2), (64, 1024)])
def test_spans_of_flat_files(spark, tmp_path, block, scan):
    rng = random.Random(block)
    files = {}
    for name, n, p in (("dense", 300, 0.5), ("sparse", 900, 0.01), ("none", 50, 0.0), ("only", 40, 1.0), ("one", 1, 0.0)):
        files[name] = [T.END if rng.random() < p else rng.randrange(T.END) for _ in range(n)]
        (tmp_path / f"{name}.bin").write_bytes(np.array(files[name], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = T.spans(T.read_token_files(spark, str(tmp_path), block), scan_blocks=scan)
    have = {}
    for r in got.collect():
        have.setdefault(r["file"].rsplit("/", 1)[-1][:-4], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in have.items()} == {k: brute_spans(v, T.END) for k, v in files.items() if brute_spans(v, T.END)}


def test_spans_of_blocks_that_cut_a_token(spark):
    d = spark.createDataFrame([("f", 0, bytearray(b"\x01\x02\x03"))], "file string, block long, data binary")
    with pytest.raises(Exception, match="inside a token"):
        T.spans(d).collect()
    ok = spark.createDataFrame([("f", 0, None), ("f", 5, bytearray(b"\x01\x00"))], d.schema)
    assert [tuple(r) for r in T.spans(ok).collect()] == [("f", 0, 0, 1, False)]
    assert T.spans(ok.limit(0)).count() == 0


def test_document_spans(spark):
    rows = [(i, " ".join("w%d" % (i * j % 7) for j in range(i % 9))) for i in range(60)] + [(70, None), (71, "\t\n"), (71, "b b"), (71, "b b"), (None, "null id"), (5000, "x " * 3000)]
    got = T.document_spans(docs(spark, rows), block_bytes=64, file_docs=25).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == sorted((i, len((t or "").split())) for i, t in rows if i is not None)
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append((r["ordinal"], r["start"], r["n_tokens"]))
    for spans in by_file.values():
        at = 0
        for k, (o, s, n) in enumerate(sorted(spans)):
            assert (o, s) == (k, at)
            at += n + 1
    assert len(got) == len(rows) and T.document_spans(docs(spark, [])).count() == 0


def reference_coder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = B.default_ranks()
    return ranks, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        return HARD
    return HARD + [r[0] for r in duckdb.connect().execute(f"select text from '{SF}/documents.parquet' order by doc_id limit 150").fetchall()]


def test_codes_equal_the_library(spark):
    ranks, ref = reference_coder()
    rows = list(enumerate(texts())) + [(9000, None), (9000, None), (None, "no id")]
    got = B.round_trip(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = B.encode_documents(docs(spark, rows[:20]))
    assert {r["doc_id"]: list(r["ids"]) for r in coded.collect()} == {i: ref.encode_ordinary(t or "") for i, t in rows[:20]}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in B.decode_documents(coded).collect()} == {i: (t or "").encode() for i, t in rows[:20]}
    assert B.round_trip(docs(spark, [])).count() == 0


def test_a_small_memory_changes_nothing():
    ranks, ref = reference_coder()
    coder = B.Coder(ranks, B.default_pattern(), keep=3)
    assert all(coder.encode(t) == ref.encode_ordinary(t) and b"".join(coder.word_bytes(coder.word_ids(t))) == t.encode() for t in texts()[:40])


def test_long_words_fold_alike():
    ranks, _ = reference_coder()
    rng = random.Random(1)
    for _ in range(20):
        w = bytes(rng.choice(b"abeinrst \xc3\xa9") for _ in range(rng.randint(30, 399)))
        assert B._fold_long(w, ranks) == B.fold(w, ranks)


def test_folds_as_column_code(spark):
    ranks, ref = reference_coder()
    words = sorted({w for t in texts()[5:40] for w in B.Coder(ranks, B.default_pattern()).split.findall(t)}, key=lambda w: hashlib.md5(w.encode()).digest())[:150]
    words = [w for w in words if len(w) < 60] + [""]
    d = spark.createDataFrame([(bytearray(w.encode()),) for w in words] * 2, "word binary")
    got = {bytes(r["word"]).decode(): list(r["ids"]) for r in B.encode_words(d, ranks).collect()}
    assert got == {w: ref.encode_ordinary(w) for w in words}


PROSE = "The river ran slowly past the old mill, and nobody asked why. It was a quiet year for all of us. "
NOISE = ["BUY!! NOW!! THIS!! IS!! GREAT!! ", "word*** other### third$$$ more%%% ", "item | other | third | more | ", "the the the the the of of of of "]


def test_quality_on_planted_noise(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        words = (PROSE if good else rng.choice(NOISE)).split() * rng.randint(1, 9)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), None if i % 5 else 1))
    rows += [(900, None), (901, ""), (None, PROSE), (902, "x" * 300_000), (0, rows[0][1])]
    labels += [(None, 1, 0), (903, 0, 0), (905, None, 1), (1, 0, 0), (1, 1, 0)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs(spark, rows), y).collect()
    truth = {i: int(i % 4 > 0) for i in range(240)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) and len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    import zlib
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    d = docs(spark, rows)
    kept = Q.keep_good(d, y)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in got)


def test_quality_without_labels_or_documents(spark):
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs(spark, [(1, "a b"), (2, None)]), y).collect()
    assert [r["score"] for r in got] == [0.5, 0.5] and Q.quality_scores(docs(spark, []), y).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], y.schema)
    assert {r["score"] for r in Q.quality_scores(docs(spark, [(1, "a b"), (2, None)]), one).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_quality_on_held_out_labels(spark):
    d, y = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    r = Q.quality_scores(d, y).join(y, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert r[0] >= 0.95 and r[1] > 100


def test_license_notices(spark):
    fill = "Nothing to see in this line of words about rivers and mills.\nDie Leute gingen unter der Brücke und das Jahr verging.\n"
    rows = [(i, fill * 5 + L.TEMPLATES[f][0] + "\n" + fill) for i, f in enumerate(sorted(L.TEMPLATES))]
    rows += [(100, fill * 9), (101, None), (102, ""), (None, "Released under the MIT License."), (103, "Licensed under the Frobozz Licence, version 9, see LICENSE."),
             (104, "He lost his driving license.\n" * 3), (105, fill * 2000 + "Licensed under CC BY-NC 4.0.")]
    got = L.license_notices(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, f in enumerate(sorted(L.TEMPLATES)):
        assert [(r["family"], r["confirmed"]) for r in by[i]] == [(f, True)], (f, by.get(i))
    assert [r["family"] for r in by[None]] == ["mit"] and [r["family"] for r in by[105]] == ["cc-by-nc"] and by[105][0]["segment"] == 4000
    assert not {100, 101, 102} & set(by) and not any(r["confirmed"] for i in (103, 104) for r in by.get(i, []))
    assert L.license_notices(docs(spark, [])).count() == 0


def test_wrapped_license_notices(spark):
    fill = "Nothing to see in this line of words about rivers and mills.\nDie Leute gingen unter der Brücke und das Jahr verging."
    wrapped = {
        "bsd": "Use of this source code is governed by a BSD-style license\nthat can be found in the LICENSE file.",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation",
        "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"}
    rows = [(i, f"{fill}{gap}{n}{gap}{fill}") for i, (n, gap) in enumerate((n, gap) for n in wrapped.values() for gap in ("\n\n", "\n"))]
    rows.append((50, "river mill " * 300 + L.TEMPLATES["mit"][2] + " stone" * 300))
    by = {}
    for r in L.license_notices(docs(spark, rows)).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for i, f in enumerate(f for f in wrapped for _ in range(2)):
        assert [(r["family"], r["confirmed"], r["notice"]) for r in by[i]] == [(f, True, wrapped[f])], (f, by.get(i))
    assert all(by[i][0]["similarity"] > 0.95 for i in range(6))
    assert [(r["family"], r["confirmed"]) for r in by[50]] == [("mit", True)]


def test_repeated_ids_give_one_model(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x", "!!", "9"]) for _ in range(rng.randint(1, 40)))) for i in range(40) for _ in range(2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = [Q.fit_documents(docs(spark, r).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5), (rows, 7))]
    assert all(np.allclose(m["weights"], models[0]["weights"], atol=1e-9) for m in models[1:])


FOREIGN = [*L.OTHERS, "GNU Affero General Public License, version 3", "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the EUPL, Version 1.2",
           "Licensed under the Boost Software License, Version 1.0.", "Licensed under the Frobozz Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
           "SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under the Unknown General Public License, version 3."]
IDENTIFIERS = {"Apache-2.0": "apache-2.0", "MIT": "mit", "GPL-3.0-or-later": "gpl", "LGPL-2.1-only": "lgpl", "BSD-3-Clause": "bsd", "MPL-2.0": "mpl-2.0", "CC-BY-SA-4.0": "cc-by-sa"}


def test_licences_of_no_family_are_not_confirmed(spark):
    fill = "Nothing to see in this line of words about rivers and mills.\n"
    rows = [(i, fill + t + "\n" + fill) for i, t in enumerate(FOREIGN)] + [(100 + i, f"{fill}// SPDX-License-Identifier: {n}\n{fill}") for i, n in enumerate(IDENTIFIERS)]
    got = L.license_notices(docs(spark, rows)).collect()
    assert not [(FOREIGN[r["doc_id"]], r["family"]) for r in got if r["doc_id"] < 100 and r["confirmed"]]
    have = {r["doc_id"]: (r["family"], r["confirmed"]) for r in got if r["doc_id"] >= 100}
    assert have == {100 + i: (f, True) for i, f in enumerate(IDENTIFIERS.values())}


def test_licence_lines_of_the_documents(spark):
    """Every line that is a template's wording is found, and nothing is confirmed where no licence word stands."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in L.license_notices(d).collect():
        got.setdefault(r["doc_id"], []).append(r)
    planted, missed, false = 0, [], []
    for r in d.select("doc_id", "text").collect():
        text = r["text"] or ""
        want = {f for f, ts in L.TEMPLATES.items() for t in ts if any(line.strip() == t for line in text.split("\n"))}
        planted += len(want)
        have = {x["family"] for x in got.get(r["doc_id"], []) if x["confirmed"]}
        missed += [(r["doc_id"], f) for f in want - have]
        false += [(r["doc_id"], f) for f in have if not L._CUE.search(text)]
    assert len(missed) <= 0.02 * planted and not false, (planted, missed, false)
