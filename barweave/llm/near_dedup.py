"""Near-duplicate detection on word shingles by BagMinHash.

A text is a bag of five-word shingles. Each unit of a shingle's weight carries a Poisson process of points in time, every point
dealt to one of the signature's components; a component keeps its earliest point, so two bags agree in a component with
probability equal to their weighted Jaccard similarity. Weights are discretised in units and grouped in doubling intervals
[0,1), [1,2), [2,4), ...: a heavy shingle needs one process per interval, not per unit, and an interval that the weight covers
in part keeps the points below the weight. Points come in ascending time, so a process stops once it is behind every component.

Bands of components name buckets. The distinct texts of a bucket are compared with its first text, then with the text
that has most links so far; what remains in different classes is compared within bounded cells of a bucket, which give only links that
join classes. So a group of near copies of one original costs about one comparison for each of its texts, no list of pairs is made, and no
class is missed. Pairs are estimated from signatures (five standard errors of slack) and then verified by the overlap of their shingle bags.
"""
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reuse
from .common import same, stayers

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
POINTS = 1 << 18  # points held at a time
TEXTS = 256  # texts signed at a time
_WORD = re.compile(r"[^\W_]+")
_G = np.uint64(0x9E3779B97F4A7C15)


def words(text):
    """Runs of letters and digits in lower case; the parts between white space for a text without any."""
    low = (text or "").lower()
    return _WORD.findall(low) or low.split()


def shingles(text, k=SHINGLE):
    """The bag of k-word shingles; a shorter text is one shingle, an empty one none."""
    w = words(text)
    n = len(w) - k + 1
    if n < 1:
        return {" ".join(w): 1} if w else {}
    bag = {}
    for s in map(" ".join, zip(*[w[i:] for i in range(k)])):
        bag[s] = bag.get(s, 0) + 1
    return bag


def bag_similarity(a, b):
    """Weighted Jaccard of two bags; two empty bags are alike."""
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b.get(s, 0)) for s, n in a.items())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 1.0


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(w, k):
    """One hash per shingle position from per-word hashes, and the words' hashes from their text."""
    h = np.fromiter(map(_word_hash, w), np.uint64, len(w))
    if len(w) < k:
        k = len(w)
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * _G + h[i:len(w) - k + 1 + i])
    return out


_WORDS = {}


def _word_hash(w):
    h = _WORDS.get(w)
    if h is None:
        if len(_WORDS) > 100_000:
            _WORDS.clear()
        import xxhash
        h = _WORDS[w] = xxhash.xxh64_intdigest(w)
    return h


def _processes(bags):
    """A process for each (document, shingle, doubling interval): document, key, length, start of the interval, weight."""
    doc, key, weight = [], [], []
    for i, h in enumerate(bags):
        u, n = np.unique(h, return_counts=True)
        doc.append(np.full(len(u), i)), key.append(u), weight.append(n)
    doc, key, weight = map(np.concatenate, (doc, key, weight))
    parts, j = [(doc, _mix(key + _G), np.ones(len(doc)), np.zeros(len(doc), np.int64), weight)], 1
    heavy = np.flatnonzero(weight > 1)
    while len(heavy):
        low = 1 << (j - 1)
        parts.append((doc[heavy], _mix(key[heavy] + np.uint64(int(_G) * (j + 1) & (1 << 64) - 1)), np.full(len(heavy), float(low)), np.full(len(heavy), low), weight[heavy]))
        heavy = heavy[weight[heavy] > (1 << j)]
        j += 1
    return [np.concatenate(x) for x in zip(*parts)]


def signatures(bags, m):
    """The (documents x m) matrix of winning points of non-empty bags given as arrays of shingle hashes."""
    out = np.zeros((len(bags), m), np.uint64)
    per_doc = m * (np.log(m) + 1.0)
    i = 0
    while i < len(bags):
        j, held = i, 0
        while j < len(bags) and (j == i or held < POINTS):
            held += max(per_doc, len(bags[j]))
            j += 1
        out[i:j] = _slice(bags[i:j], m, per_doc)
        i = j
    return out


def _slice(bags, m, per_doc):
    doc, key, length, low, weight = _processes(bags)
    units = np.array([len(h) for h in bags], float)
    time, who = np.full(len(bags) * m, np.inf), np.zeros(len(bags) * m, np.uint64)
    t, k = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    ask = np.maximum(1, np.ceil(per_doc / units[doc] * length)).astype(np.int64)
    live = np.arange(len(doc))
    while len(live):
        for a in _runs(ask[live]):
            p = live[a]
            n = ask[p]
            first = np.cumsum(n) - n
            at = np.repeat(np.arange(len(p)), n)
            step = (np.arange(len(at)) - first[at]).astype(np.uint64)
            q = p[at]
            h = _mix(key[q] + (k[q] + step) * _G)
            gap = -np.log(((h >> np.uint64(11)).astype(float) + 1.0) * 2.0 ** -53) / length[q]
            run = np.cumsum(gap)
            run += (t[p] - (run[first] - gap[first]))[at]
            t[p] = run[first + n - 1]
            k[p] += n.astype(np.uint64)
            g = _mix(h ^ _G)
            slot = doc[q] * m + ((g >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            unit = low[q] + ((g & np.uint64(0xFFFFFFFF)).astype(float) * length[q] * 2.0 ** -32).astype(np.int64)
            in_weight = (unit < weight[q]) | (low[q] == 0)
            slot, run, h = slot[in_weight], run[in_weight], h[in_weight]
            np.minimum.at(time, slot, run)
            won = time[slot] == run
            who[slot[won]] = h[won]
        last = time.reshape(-1, m).max(axis=1)
        live = live[t[live] <= last[doc[live]]]
        ask[live] = np.maximum(1, ask[live] // 3)
    return who.reshape(-1, m)


def _runs(ask):
    ends = np.cumsum(ask)
    a = 0
    while a < len(ask):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POINTS, side="right")))
        yield slice(a, b)
        a = b


def band_keys(sig, bands, rows):
    out = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _G
    for r in range(rows):
        out = _mix(out * _G + sig[:, r:bands * rows:rows])
    return out.view(np.int64)


def _slices(batches, n):
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def _sign(bands, rows, k):
    def run(batches):
        for batch in _slices(batches, TEXTS):
            ids = batch.column(0)
            fresh, bags, seen = [], [], set()
            for i, (node, text) in enumerate(zip(ids.to_pylist(), batch.column(1))):
                if node in seen:  # copies side by side are signed once
                    continue
                seen.add(node)
                w = words(text.as_py())
                if w:
                    fresh.append(i), bags.append(_hashes(w, k))
            if fresh:
                sig = signatures(bags, bands * rows)
                keys = band_keys(sig, bands, rows)
                small = (sig & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(fresh)), pa.array([s.tobytes() for s in small], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(fresh) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))],
                    names=["node", "sig", "keys"])
    return run


def node_of(text: Column) -> Column:
    """A text's identity: the digest of its bytes, null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signed(texts: DataFrame, bands=BANDS, rows=ROWS, k=SHINGLE) -> DataFrame:
    """(node, sig, keys) of each distinct non-empty text of (node, text)."""
    return (texts.select("node", "text").mapInArrow(_sign(bands, rows, k), "node binary, sig binary, keys array<long>").dropDuplicates(["node"]))


def _agreeing(pairs, sigs, floor, bands, rows):
    """Pairs whose signatures leave the similarity possible. One byte per component is kept, so one in 256 agrees by chance."""
    a = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    m = bands * rows

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        u = np.frombuffer(b"".join(x), np.uint8).reshape(-1, m)
        v = np.frombuffer(b"".join(y), np.uint8).reshape(-1, m)
        return pd.Series(((u == v).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    return pairs.join(a, "a").join(b, "b").where(estimate("sa", "sb") >= floor).select("a", "b")


def _verified(pairs, texts, similarity, k):
    def run(batches):
        for batch in batches:
            held, found = {}, []
            a, b, ta, tb = batch.columns

            def bag(node, text):  # the first of a bucket comes up again and again
                if node not in held:
                    if len(held) >= 8:
                        held.pop(next(iter(held)))
                    held[node] = shingles(text.as_py(), k)
                return held[node]

            for p, q, x, y in zip(a.to_pylist(), b.to_pylist(), ta, tb):
                found.append(bag_similarity(bag(p, x), bag(q, y)))
            keep = np.flatnonzero(np.array(found) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep)), b.take(pa.array(keep)), pa.array(np.array(found)[keep])], names=["a", "b", "similarity"])

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, similarity double")


CONTRACT = 100_000  # links that are merged by themselves first


def _contracted(links):
    """The same classes with shorter paths: links read together become links to the smallest node they join. No shuffle."""
    def run(batches):
        parent, seen = {}, 0

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        def stars():
            nodes = [x for x in parent if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= CONTRACT:
                yield stars()
                parent, seen = {}, 0
        yield stars()

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each linked node; root is the smallest node it reaches.

    Links read together are contracted first. Then every node takes the smallest root among its own and its neighbours', until none changes; every third time it also takes its root's root, so
    long chains shorten by halves. Only an emptiness test comes to the driver.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("peer")), F.struct(F.col("b").alias("node"), F.col("a").alias("peer")))
    edges = reuse(_contracted(links).select(F.explode(ends).alias("e")).select("e.*"))
    roots, turn = edges.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("root")), 0
    roots = reuse(roots)
    while True:
        heard = edges.join(roots.select(F.col("node").alias("peer"), "root"), "peer").select("node", "root", F.lit(None).cast("binary").alias("was"))
        own = roots.select("node", "root", F.col("root").alias("was"))
        new = heard.unionByName(own).groupBy("node").agg(F.min("root").alias("root"), F.max("was").alias("was"))
        turn += 1
        if turn % 3 == 0:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            new = new.join(up, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was")
        new = reuse(new)
        if new.where(F.col("was") != F.col("root")).isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


CELL = 256  # texts of a bucket that are compared with as many others in one task


def _bag(text, k):
    """Sorted hashes of a text's shingle occurrences: the n-th occurrence of a shingle has a hash of its own, so bags compare as sets."""
    h = np.sort(_hashes(words(text), k))
    first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(_mix(h + nth.astype(np.uint64) * _G))


def _cell_links(rows, key, within, slack, similarity):
    """Links that join different classes among the texts of one cell: rows (node, root, side, sig, keys, bag).

    A pair counts in the first bucket it shares only, and not if its classes have met in this cell already: so a cell gives fewer links than texts.
    """
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    side = np.array([r[2] for r in rows])
    keys = [np.sort(r[4]) for r in rows]
    out = []
    for i in range(len(rows) - 1):
        rest = sig[i + 1:]
        likely = ((rest == sig[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= slack
        if not within:
            likely &= side[i + 1:] != side[i]
        for j in np.flatnonzero(likely) + i + 1:
            a, b = find(rows[i][1]), find(rows[j][1])
            if a == b or np.intersect1d(keys[i], keys[j], assume_unique=True)[0] != key:
                continue
            x, y = rows[i][5], rows[j][5]
            both = len(np.intersect1d(x, y, assume_unique=True))
            alike = both / (len(x) + len(y) - both)
            if alike >= similarity - 1e-12:
                parent[max(a, b)] = min(a, b)
                out.append((rows[i][0], rows[j][0], alike))
    return out


def _cells(open_):
    """The entries (key, node, root) of mixed buckets at every pair of blocks (lo, hi) that they are compared in.

    A class with many texts in a bucket has blocks of its own, smaller classes share blocks; two blocks of one class never meet, since its texts are linked
    already. So a bucket of many copies and a few strangers sends the copies once and the strangers once per block.
    """
    sizes = open_.groupBy("key", "root").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") * 2 < CELL).groupBy("key").agg(F.ceil(F.sum("n") / CELL).alias("shared"))
    sizes = sizes.join(small, "key", "left").withColumn("own", F.when(F.col("n") * 2 >= CELL, F.ceil(F.col("n") / CELL)))
    name = F.hex(F.col("root").cast("binary"))
    side = F.when(F.col("own").isNotNull(), F.concat_ws(":", name, F.pmod(F.xxhash64("node"), F.col("own")))).otherwise(F.concat_ws(":", F.lit(""), F.pmod(F.xxhash64("root"), F.col("shared"))))
    placed = reuse(open_.join(sizes, ["key", "root"]).select("key", "node", "root", side.alias("side"), F.when(F.col("own").isNotNull(), F.col("root")).alias("only")))
    blocks = placed.select("key", "side", "only").distinct()
    a, b = blocks.select("key", F.col("side").alias("lo"), F.col("only").alias("x")), blocks.select("key", F.col("side").alias("hi"), F.col("only").alias("y"))
    pairs = a.join(b, "key").where((F.col("lo") <= F.col("hi")) & F.coalesce(F.col("x") != F.col("y"), F.lit(True))).select("key", "lo", "hi")
    ends = pairs.withColumn("side", F.explode(F.array_distinct(F.array("lo", "hi"))))
    return placed.drop("only").join(ends, ["key", "side"]).select("key", "lo", "hi", "side", "node", "root")


def _links_in_cells(open_, sigs, texts, similarity, slack, k):
    """Links between the classes that still share a bucket, from the pairs of blocks that ``_cells`` names; no pair leaves a task but the links."""
    def bags(batches):
        for batch in _slices(batches, TEXTS):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_bag(t.as_py(), k).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["node", "bag"])

    held = texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(bags, "node binary, bag array<long>")
    whole = held.join(sigs, "node")
    cells = _cells(open_).join(whole, "node").select("key", "lo", "hi", "side", "node", "root", "sig", "keys", "bag")

    def run(batches):
        at, rows = None, []

        def done():
            found = _cell_links(rows, at[0], at[1] == at[2], slack, similarity) if len({r[1] for r in rows}) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.binary(), pa.float64()))], names=["a", "b", "similarity"])

        for batch in batches:
            key, lo, hi, side, node, root, sig, keys, bag = (batch.column(c) for c in range(9))
            for i, cell in enumerate(zip(key.to_pylist(), lo.to_pylist(), hi.to_pylist())):
                if cell != at:
                    if rows:
                        yield from done()
                    at, rows = cell, []
                rows.append((node[i].as_py(), root[i].as_py(), side[i].as_py(), sig[i].as_py(), np.array(keys[i].values), np.array(bag[i].values).view(np.uint64)))
        if rows:
            yield from done()

    dealt = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return dealt.mapInArrow(run, "a binary, b binary, similarity double")


def near_links(docs: DataFrame, id_col="doc_id", text_col="text", similarity=SIMILARITY, bands=BANDS, rows=ROWS, k=SHINGLE):
    """(texts, links, roots): the node of each row, links between distinct texts, and the root of each linked text."""
    owners = reuse(docs.select(F.col(id_col).alias("doc_id"), node_of(F.col(text_col)).alias("node")))
    pairs_of = docs.select(node_of(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sigs = reuse(signed(pairs_of, bands, rows, k))
    entries = sigs.select("node", F.explode("keys").alias("key"))
    buckets = reuse(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    entries = reuse(entries.join(buckets.select("key", "pivot"), "key"))
    # One row of each candidate text brings the text along; copies stay where they are.
    wanted = entries.select("node").distinct()
    bearer = owners.groupBy("node").agg(F.min("doc_id").alias("bearer")).join(wanted, "node")
    full = docs.select(F.col(id_col).alias("_id"), node_of(F.col(text_col)).alias("_node"), F.col(text_col).alias("text"))
    texts = reuse(full.join(bearer, same(F.col("_id"), F.col("bearer")) & (F.col("_node") == F.col("node"))).select("node", "text").dropDuplicates(["node"]))
    slack = similarity - 5 * float(np.sqrt(similarity * (1 - similarity) / (bands * rows)))

    def checked(pairs):
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        close = reuse(_agreeing(pairs, sigs, slack, bands, rows))
        return reuse(_verified(close, texts, similarity, k))

    links = checked(entries.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    # A first guess of the classes: it only decides which pairs need not be looked at again.
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    roots = reuse(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = reuse(ends.groupBy("node").agg(F.count("*").alias("degree")))
    open_ = reuse(_undecided(entries, roots))
    if open_.isEmpty():
        roots = components(links)
    else:
        hubs = (open_.join(degree, "node", "left").groupBy("key")
                .agg(F.max_by(F.struct("node", "root"), F.struct(F.coalesce("degree", F.lit(0)), "node")).alias("hub")))
        star = open_.join(reuse(hubs), "key").where("root <> hub.root").select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        more = checked(star)
        links = reuse(links.unionByName(more).distinct())
        roots = components(links)
        open_ = reuse(_undecided(entries, roots))
        last = reuse(_links_in_cells(open_, sigs, texts, similarity, slack, k))
        if not last.isEmpty():
            links = reuse(links.unionByName(last).distinct())
            roots = components(links)
    return owners, links, roots


def _undecided(entries, roots):
    """Entries of buckets that still hold several classes."""
    e = entries.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = e.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return e.join(reuse(mixed), "key")


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """One row per input row: doc_id, class_id, group_size, kept.

    A class joins texts linked by similar shingle bags, directly or over others; equal texts are in one class, all texts without words in
    one too when equal. class_id is the smallest doc_id of the class, whose row is kept (null only if all ids are null); of rows that repeat it,
    one is kept. Null texts count as empty; other columns are ignored; an empty table gives no rows.
    """
    c = _classes(docs, id_col, text_col, **how)
    return c.withColumn("copy", F.explode(F.expr("sequence(1L, n_rows)"))).select(
        "doc_id", "class_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"))


def _classes(docs, id_col, text_col, **how):
    owners, _, roots = near_links(docs, id_col, text_col, **how)
    rows = owners.groupBy("doc_id", "node").agg(F.count("*").alias("n_rows"))
    rows = reuse(rows.join(roots, "node", "left").select("doc_id", "node", "n_rows", F.coalesce("root", "node").alias("root")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first")
    of = reuse(rows.groupBy("root").agg(first, F.sum("n_rows").alias("group_size")))
    stays = same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return rows.join(of, "root").select("doc_id", "node", "n_rows", F.col("first.doc_id").alias("class_id"), "group_size", stays.alias("stays"))


def drop_near(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The row that stays of each class, with all columns of ``docs``."""
    return stayers(docs, id_col, text_col, node_of, lambda d, i, t: _classes(d, i, t, **how).where("stays").select("doc_id", F.col("node").alias("key"), "n_rows"))
