"""Licence notices in documents, by a trained classifier of text segments.

Segments are sentences within lines; blank lines end a paragraph. What is classified are the segments and, as notices are wrapped at any place,
all runs of segments of a paragraph up to ``WINDOW`` words, with single newlines as spaces; longer segments also in overlapping windows. Their word one- and two-grams, of the vocabulary that the licence templates use, enter a sparse
multinomial logistic regression fitted by Spark on variants of the templates (cut, thinned, and set among other words) and on segments of
the corpus without licence words (a bounded sample: ``MAX_PLAIN``). A family's probability must pass a threshold calibrated on held-out variants
and plain segments and on licences of families that the fit has not seen; other licences have a class of their own, "unknown", which also takes a
notice below the threshold. A prediction is confirmed when the whole joined notice contains enough of one of the family's templates, more than of any
other family's, and at least half of what sets that template apart from all other families.
"""
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PLAIN, PLAIN_LENGTH = 3000, 2000
VARIANTS = 40
SURE = 0.99  # share of held-out family predictions above the threshold that are right
CONFIRMED = 0.6
WINDOW = 48  # words of a run of segments; the longest template has 29
NONE, UNKNOWN = "none", "unknown"

# Customary wording of licence notices.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited.",
                    "This material may not be reproduced, distributed or transmitted without the prior written permission of the publisher."],
}
# SPDX identifiers of the families.
IDENTIFIERS = {"apache-2.0": ["Apache-2.0"], "mit": ["MIT"], "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"],
               "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.1"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl-2.0": ["MPL-2.0"],
               "cc-by": ["CC-BY-4.0", "CC-BY-3.0"], "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"], "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-3.0"]}
# Licences that are none of the families. Every third one is not fitted but calibrates the threshold.
OTHERS = ["Licensed under the Eclipse Public License, version 2.0.", "This work is licensed under the GNU Affero General Public License, version 3.",
          "Licensed under the European Union Public Licence, version 1.2.", "Distributed under the Boost Software License, version 1.0.",
          "Licensed under the Artistic License 2.0.", "Licensed under the Common Development and Distribution License, version 1.0.",
          "Released into the public domain under CC0 1.0 Universal.", "Licensed under the Open Software License, version 3.0.",
          "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted under the ISC License.",
          "Licensed under the Microsoft Public License.", "This font software is licensed under the SIL Open Font License, version 1.1.",
          "Licensed under the Academic Free License, version 3.0.", "This software is provided as-is under the zlib License.",
          "Licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."]
# Uses of licence words that are no notice.
PLAIN = ["She got her driving license last year and drove to the sea.", "The public was free to copy the work in this version.",
         "He used the source of the river as a general sign of the following conditions.", "A poetic license may be used with permission.",
         "The common people met under the old bridge and the work began.", "You may find a copy of the book along with this letter."]
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {n}" for n in _names]
_CUE = re.compile(r"licen[cs]|copyright|rights reserved|creative commons|spdx|redistribut", re.I)
_CUT = re.compile(r"\n|(?<=[.;:!?])\s+(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def tokens(segment):
    return _TOKEN.findall(segment.lower())


def segments(text):
    return _CUT.split(text) if text else []


def grams(words):
    return {*words, *map(" ".join, zip(words, words[1:]))}


def vocabulary(templates=TEMPLATES, others=()):
    return {g: i for i, g in enumerate(sorted({g for ts in [*templates.values(), others] for t in ts for g in grams(tokens(t))}))}


def feature_ids(words, vocab):
    return sorted({vocab[g] for g in grams(words) if g in vocab})


def _variants(template, plain, rng, n):
    """The template whole, cut to a run of at least two thirds, thinned by a tenth, and among words of plain segments."""
    words = template.split()
    out = [words]
    while len(out) < n:
        size = rng.randint(max(2, -(-2 * len(words) // 3)), len(words)) if len(words) > 6 else len(words)
        at = rng.randint(0, len(words) - size)
        w = words[at:at + size]
        if len(w) > 6:
            w = [x for x in w if rng.random() > 0.1] or w
        if plain and rng.random() < 0.4:
            other = rng.choice(plain).split()[:rng.randint(0, 8)]
            w = other + w if rng.random() < 0.5 else w + other
        out.append(w)
    return [" ".join(w) for w in out]


def plain_segments(docs: DataFrame, id_col="doc_id", text_col="text", limit=MAX_PLAIN) -> list:
    """At most ``limit`` whole segments of up to ``PLAIN_LENGTH`` characters without licence words, one of each of the documents with lowest digests."""
    def first(text):
        fit = [s for s in segments(text) if s.strip() and len(s) <= PLAIN_LENGTH and not _CUE.search(s)]
        return min(fit, key=lambda s: zlib.crc32(s.encode("utf-8", "replace")), default=None)

    @F.pandas_udf("string")
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(first)

    chosen = docs.select(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string"))).alias("d"), F.col(text_col).alias("t"))
    picked = chosen.select("d").orderBy("d").limit(limit)  # a digest each: bounded
    rows = chosen.join(F.broadcast(picked), "d").select("d", one("t").alias("s")).where("s is not null").dropDuplicates(["d"]).orderBy("d")
    return [r["s"] for r in rows.collect()]


class Model:
    def __init__(self, families, vocab, weights, bias, threshold, templates, others=()):
        self.families, self.vocab, self.weights, self.bias, self.threshold = families, vocab, weights, bias, threshold
        self.columns = np.ascontiguousarray(weights.T)
        self.grams = {f: [(grams(tokens(t)), tokens(t)) for t in ts] for f, ts in templates.items()}
        of = {f: {g for t, _ in ts for g in t} for f, ts in self.grams.items()} | {UNKNOWN: {g for t in others for g in grams(tokens(t))}}
        self.apart = {f: [t - set().union(*(g for o, g in of.items() if o != f)) for t, _ in ts] for f, ts in self.grams.items()}
        self.others = [grams(tokens(t)) for t in others]

    def probabilities(self, ids):
        z = self.bias + (self.weights[:, ids].sum(axis=1) / np.sqrt(len(ids)) if ids else 0.0)
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, words, family):
        """The largest share of a template's grams that the segment has."""
        have = grams(words)
        return max(len(g & have) / len(g) for g, _ in self.grams[family])

    def confirms(self, words, family):
        """Whether the words hold enough of a template of the family, more than of any other licence, and half of what only this family's has."""
        have = grams(words)
        share = lambda g: len(g & have) / len(g)
        rival = max((share(g) for f, ts in self.grams.items() if f != family for g, _ in ts), default=0.0)
        rival = max([rival, *map(share, self.others)])
        return any(share(g) >= max(CONFIRMED, rival) and (not own or share(own) >= 0.5) for (g, _), own in zip(self.grams[family], self.apart[family]))

    def label(self, p):
        """(family, probability) of a unit by its probabilities, or None for plain text."""
        if p[0] >= 0.5 or p.argmax() == 0:
            return None
        other = p[1] if self.families[1] == UNKNOWN else 0.0
        known = 2 if self.families[1] == UNKNOWN else 1
        best = known + int(p[known:].argmax())
        sure = p[best] >= self.threshold and p[best] > other
        return (self.families[best] if sure else UNKNOWN), float(p[best] if sure else max(other, p[best])), self.families[best]

    def score(self, units):
        """Probabilities of many units, each a set of feature ids."""
        n = np.array([len(u) for u in units])
        flat = np.fromiter((i for u in units for i in u), dtype=np.int64, count=int(n.sum()))
        z = np.add.reduceat(self.columns[flat], np.r_[0, np.cumsum(n)[:-1]], axis=0) / np.sqrt(n)[:, None] + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def adds(self, words, more, family):
        """Whether ``more`` brings a pair of words of the family's template nearest to the joined words that ``words`` lack."""
        have, rest = grams(words[0] + words[1]), grams(more)
        near = max((g for g, _ in self.grams[family]), key=lambda g: len(g & have) / len(g))
        return any(" " in x for x in (near & have) - rest)

    def notices(self, text):
        """[first segment, family, probability, similarity, confirmed, words of the notice] of every notice of a text."""
        parts = segments(text)
        words = [tokens(s) for s in parts]
        lookup, units, where = self.vocab.get, [], []

        def ids(w):
            return {i for i in map(lookup, grams(w)) if i is not None}
        own = [ids(w) for w in words]
        last = len(parts)
        for i, w in enumerate(words):
            if not w:
                continue
            if own[i]:
                units.append(own[i])
                where.append((i, i))
                if len(w) > WINDOW:
                    for at in range(0, len(w) - WINDOW // 2, WINDOW // 2):
                        u = ids(w[at:at + WINDOW])
                        if u:
                            units.append(u)
                            where.append((i, i))
            # a run starts and ends with a segment that has words of the vocabulary
            size, u, j = len(w), own[i], i + 1
            while own[i] and j < last and words[j] and size + len(words[j]) <= WINDOW:
                seam = lookup(f"{words[j - 1][-1]} {words[j][0]}")
                u = u | own[j] if seam is None else u | own[j] | {seam}
                size += len(words[j])
                if own[j]:
                    units.append(u)
                    where.append((i, j))
                j += 1
        if not units:
            return []
        p = self.score(units)
        none = self.families.index(NONE)
        single, runs = {}, []
        for k in np.flatnonzero(p[:, none] < 0.5):
            (i, j), hit = where[k], self.label(p[k])
            if hit is None:
                continue
            if i < j:
                if hit[0] != UNKNOWN:
                    runs.append((j - i, i, j, hit))
            elif i not in single or (hit[0] != UNKNOWN, hit[1]) > (single[i][0] != UNKNOWN, single[i][1]):
                single[i] = hit

        def joined(i, j):
            return [x for w in words[i:j + 1] for x in w]

        def similar(i, j, family):
            return self.similarity(joined(i, j), family)
        # shortest runs first; a run counts where it holds no notice that is whole already, and both its ends belong to it
        whole = {i for i, (f, _, best) in single.items() if f != UNKNOWN and similar(i, i, best) >= CONFIRMED}
        found = []
        for _, i, j, hit in sorted(runs, key=lambda r: (r[0], -r[3][1], r[1])):
            f = hit[0]
            if whole.isdisjoint(range(i, j + 1)) and self.adds((words[i], joined(i + 1, j)), joined(i + 1, j), f) and self.adds(
                    (joined(i, j - 1), words[j]), joined(i, j - 1), f):
                if similar(i, j, f) >= CONFIRMED or not any(k in single for k in range(i, j + 1)):
                    found.append([i, j, hit])
                    whole.update(range(i, j + 1))
        taken = {k for i, j, _ in found for k in range(i, j + 1)}
        found += [[i, i, hit] for i, hit in single.items() if i not in taken]
        out = []
        for i, j, (f, prob, best) in sorted(found, key=lambda x: x[0]):
            if out and out[-1][1] == i - 1 and out[-1][2] == f:  # neighbours of one family are one notice
                out[-1][1], out[-1][3] = j, max(out[-1][3], prob)
            else:
                out.append([i, j, f, prob, best])
        # a wrapped notice also takes the lines beside it that go on with its template, whatever they are judged alone; whole ones take first
        order = sorted(range(len(out)), key=lambda n: out[n][2] == UNKNOWN or similar(out[n][0], out[n][1], out[n][2]) < CONFIRMED)
        claimed = {}
        for n in order:
            i, j, f = out[n][:3]
            if f != UNKNOWN and similar(i, j, f) >= CONFIRMED:
                claimed.update(dict.fromkeys(range(i, j + 1), n))
        for n in order:
            i, j, f = out[n][:3]
            if f == UNKNOWN or any(claimed.get(k, n) != n for k in range(i, j + 1)):
                continue
            claimed.update(dict.fromkeys(range(i, j + 1), n))
            while j + 1 < last and words[j + 1] and j + 1 not in claimed and self.adds((joined(i, j), words[j + 1]), joined(i, j), f):
                j += 1
                claimed[j] = n
            while i > 0 and words[i - 1] and i - 1 not in claimed and self.adds((words[i - 1], joined(i, j)), joined(i, j), f):
                i -= 1
                claimed[i] = n
            out[n][:2] = i, j
        grown = []
        for n, (i, j, f, prob, best) in sorted(enumerate(out), key=lambda x: x[1][0]):
            if any(claimed.get(k, n) != n for k in range(i, j + 1)):
                continue  # another notice has taken it
            if grown and grown[-1][1] == i - 1 and grown[-1][2] == f:
                grown[-1][1], grown[-1][3] = j, max(grown[-1][3], prob)
            else:
                grown.append([i, j, f, prob, best])
        rows = []
        for i, j, f, prob, best in grown:
            sim = similar(i, j, best)
            rows.append([i, f, prob, sim, f != UNKNOWN and self.confirms(joined(i, j), f), "\n".join(parts[i:j + 1])])
        return rows


def train(spark, plain, templates=TEMPLATES, variants=VARIANTS, seed=11, others=OTHERS) -> Model:
    """Fits on two thirds of the variants, plain segments and other licences, and calibrates the threshold on the rest.

    A held-out licence of no family counts as wrong where a family is predicted. The threshold is the lowest above which the share ``SURE`` of such
    predictions is right. Equal probabilities go to the first family by name.
    """
    rng = random.Random(seed)
    vocab, families = vocabulary(templates, [t for i, t in enumerate(others) if i % 3 != 2]), [NONE, UNKNOWN, *sorted(templates)]
    rows = [(NONE, s, None) for s in [*PLAIN, *plain]]
    rows += [(f, v, None) for f in sorted(templates) for t in templates[f] for v in _variants(t, plain, rng, variants)]
    rows += [(UNKNOWN, v, i % 3 == 2) for i, t in enumerate(others) for v in _variants(t, plain, rng, variants)]
    made = []
    for i, (f, s, held) in enumerate(rows):
        ids = feature_ids(tokens(s), vocab)
        made.append((float(families.index(f)), ids, 1 / np.sqrt(len(ids)) if ids else 0.0, held if held is not None else i % 3 == 2 and s not in templates.get(f, ())))
    size = len(vocab)
    fit_rows = [(y, Vectors.sparse(size, ids, [v] * len(ids))) for y, ids, v, held in made if not held]
    frame = spark.createDataFrame(fit_rows, ["label", "features"])
    lr = LogisticRegression(family="multinomial", regParam=1e-4, standardization=False, maxIter=80).fit(frame)
    model = Model(families, vocab, lr.coefficientMatrix.toArray(), lr.interceptVector.toArray(), 0.0, templates, others)
    seen = []
    for y, ids, _, held in made:
        p = model.probabilities(ids)
        hit = model.label(p) if held else None
        if hit and hit[0] != UNKNOWN:
            seen.append((hit[1], hit[0] == families[int(y)]))
    seen.sort(reverse=True)
    right, model.threshold = 0, 1.0 if seen else 0.5
    for n, (p, ok) in enumerate(seen, 1):
        right += ok
        if right / n >= SURE:
            model.threshold = p
    return model


def license_notices(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES, max_plain=MAX_PLAIN) -> DataFrame:
    """One row per notice: doc_id, segment, family, probability, similarity, confirmed, notice.

    Every segment of every whole text is scored, alone and in runs. Neighbouring segments of one family are one notice, with the largest probability of
    them and the similarity of all its words. ``segment`` counts from 0. Null and empty texts have no notices; repeated rows repeat theirs; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    model = train(docs.sparkSession, plain_segments(docs, id_col, text_col, max_plain), templates)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # families x vocabulary of the templates

    def scan(batches):
        m = shared.value
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [[i, *r] for r in m.notices(t)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "segment", "family", "probability", "similarity", "confirmed", "notice"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, segment long, family string, probability double, similarity double, confirmed boolean, notice string")
