"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and routes every row to a leaf. A query walks the tree best bin first: a priority queue
holds branches by the distance to their centres, and leaves are visited in the order they come off it. How many leaves to visit is
calibrated: for some sample vectors the exact neighbours over all rows are found once, and visits widen until the wanted share
of them lies in visited leaves. The first leaves of a query are searched exactly and give it k neighbours; the further ones give only rows
that are no farther than the k-th of these. Searches run in slices of bounded size on both sides, so a leaf with a third of all
rows or queries spreads over many tasks.

Sizes the driver and the broadcast tree may reach: ``MAX_SAMPLE`` vectors (fewer when wide), ``MAX_LEAVES`` leaves.
"""
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse

MAX_SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
MAX_LEAVES = 4096
LEAF_ROWS = 256
BRANCHES = 8
PROBES = 100
RECALL = 0.95
FIRST = 4  # leaves that bound the distance for the others
SLICE_ROWS, SLICE_QUERIES = 4096, 1024


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


class Tree:
    def __init__(self, centres, children, leaf_no):
        self.centres, self.children, self.leaf_no = centres, children, leaf_no
        self.leaves = int(leaf_no.max()) + 1

    def route(self, x):
        """The leaf of each row: the nearest child's subtree at every level."""
        node, out = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
        live = np.arange(len(x))
        while len(live):
            order = np.argsort(node[live], kind="stable")
            live = live[order]
            cuts = np.flatnonzero(np.diff(node[live])) + 1
            for rows in np.split(live, cuts):
                at = node[rows[0]]
                kids = self.children[at]
                if kids is None:
                    out[rows] = self.leaf_no[at]
                else:
                    c = self.centres[kids]
                    node[rows] = np.asarray(kids)[np.argmin(-2 * (x[rows] @ c.T) + (c * c).sum(axis=1), axis=1)]
            live = live[out[live] < 0]
        return out

    def visits(self, q):
        """Leaves in best-bin-first order."""
        queue = [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            kids = self.children[at]
            if kids is None:
                yield int(self.leaf_no[at])
            else:
                for d, k in zip(((self.centres[kids] - q) ** 2).sum(axis=1).tolist(), kids):
                    heapq.heappush(queue, (d, k))


def _kmeans(x, k, rng, rounds=12):
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin(-2 * (x @ c.T) + (c * c).sum(axis=1), axis=1)
        new = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        if np.array_equal(new, c):
            break
        c = new
    return c, np.argmin(-2 * (x @ c.T) + (c * c).sum(axis=1), axis=1)


def fit_tree(sample, rows, leaf_rows=LEAF_ROWS, branches=BRANCHES, max_leaves=MAX_LEAVES, seed=7) -> Tree:
    """Splits the largest node by k-means until leaves hold about ``leaf_rows`` of ``rows`` rows, or ``max_leaves`` are reached."""
    rng = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [None]
    held = [(-len(sample), 0, np.arange(len(sample)))]
    scale, leaves = rows / max(1, len(sample)), 1
    while held and leaves + branches - 1 <= max_leaves:
        n, at, idx = heapq.heappop(held)
        if -n * scale <= leaf_rows or -n < 2 * branches:
            break
        c, near = _kmeans(sample[idx], branches, rng)
        kept = [j for j in range(branches) if (near == j).any()]
        if len(kept) < 2:
            continue  # equal vectors stay together
        children[at] = []
        for j in kept:
            children[at].append(len(centres))
            heapq.heappush(held, (-int((near == j).sum()), len(centres), idx[near == j]))
            centres.append(c[j])
            children.append(None)
        leaves += len(kept) - 1
    leaf_no, n = np.full(len(centres), -1, np.int64), 0
    for i, kids in enumerate(children):
        if kids is None:
            leaf_no[i], n = n, n + 1
    return Tree(np.array(centres), children, leaf_no)


def _matrix(col):
    return np.array(col.tolist(), dtype=np.float64) if len(col) else np.zeros((0, 1))


def _distances(x, q):
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _search(ids, x, query_ids, q, bounds, k):
    """(query_id, vec_id, score) of the k nearest rows for each query, no farther than its bound.

    A matrix product finds the rows that may be within the bound; only their distances are then computed term by term.
    """
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    near = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
    near -= 1e-9 * (qq[:, None] + xx[None, :]) + np.square(np.minimum(bounds, 1e150))[:, None]
    out = []
    for j, i in enumerate(query_ids):
        some = np.flatnonzero(near[j] <= 0)
        some = some[ids[some] != i]
        if len(some):
            d = _distances(x[some], q[j])
            best = _nearest(ids[some], d, k)
            best = best[d[best] <= bounds[j]]
            out.append((np.full(len(best), i), ids[some][best], d[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _nearest(ids, d, k):
    """Positions of the k least distances, ties to the smaller id, an id once."""
    if len(d) > 8 * k:
        cut = np.partition(d, 4 * k - 1)[4 * k - 1]
        some = np.flatnonzero(d <= cut)
        if len(np.unique(ids[some])) < k:
            some = np.arange(len(d))
    else:
        some = np.arange(len(d))
    some = some[np.lexsort((ids[some], d[some]))]
    _, first = np.unique(ids[some], return_index=True)
    return some[np.sort(first)[:k]]


def _top(df, keys, k):
    """The k best rows of each key by score and id, an id once."""
    once = df.groupBy(*keys, "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_neighbours(data: DataFrame, ids, vectors, k, extra=()) -> DataFrame:
    """The k nearest rows of ``data`` for each of a bounded number of vectors, in one pass: query_id, vec_id, score, rank."""
    ids, vectors = list(map(int, ids)), np.asarray(vectors)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            found = _search(b["vec_id"].to_numpy(), _matrix(b["v"]), ids, vectors, np.full(len(ids), np.inf), k)
            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = data.select("vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score double")
    return _top(found, ["query_id"], k)


def _calibrate(routed, tree, ids, vectors, k, recall):
    """Leaves to visit so that the wanted share of the probes' exact neighbours is met."""
    if not len(ids) or tree.leaves == 1:
        return 1
    true = exact_neighbours(routed, ids, vectors, k).select("query_id", "vec_id").join(routed.select("vec_id", "leaf"), "vec_id")
    place = {}
    for i, q in zip(ids, vectors):
        place[int(i)] = {leaf: n + 1 for n, leaf in enumerate(tree.visits(q))}
    need = np.sort([place[r["query_id"]][r["leaf"]] for r in true.select("query_id", "leaf").collect()])  # PROBES * k rows
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)))]) if len(need) else 1


def nearest(vectors: DataFrame, is_query: Column, k=10, id_col="vec_id", vector_col="embedding", leaf_rows=LEAF_ROWS, recall=RECALL,
            max_leaves=MAX_LEAVES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` holds, by Euclidean distance in double precision.

    Every row but the query's own is a candidate; ties go to the smaller id. Null ids and unusable vectors (``usable``) take no part, nor do
    vectors of another length than the most common one (the shorter of equals). Rows that share an id count as one item at their least distance. With fewer than k candidates
    all are returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = (vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("is_query")))
    shape = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = shape["dim"], shape["count"]
    good = good.where(F.size("v") == dim)
    take = max(1, min(MAX_SAMPLE, SAMPLE_VALUES // dim))
    sample = good.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).toPandas()
    x = _matrix(sample["v"])
    tree = fit_tree(x, rows, leaf_rows, max_leaves=max_leaves)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches):
        for b in batches:
            if len(b):
                yield b.assign(leaf=shared.value.route(_matrix(b["v"])))

    routed = reuse(good.mapInPandas(route, "vec_id long, v array<double>, is_query boolean, leaf long"))
    sizes = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}  # max_leaves rows
    probes = slice(0, PROBES)
    visits = _calibrate(routed, tree, sample["vec_id"].to_numpy()[probes], x[probes], k, recall)
    enough = 4 * k + 1

    def walk(batches):
        for b in batches:
            q, leaf, turn = [], [], []
            for i, v in enumerate(_matrix(b["v"])):
                seen, n = 0, 0
                for at in shared.value.visits(v):
                    if n >= visits and seen >= enough:
                        break
                    if at in sizes:
                        q.append(i), leaf.append(at), turn.append(n)
                        seen += sizes[at]
                    n += 1
            yield pd.DataFrame({"query_id": b["vec_id"].to_numpy()[q], "q": b["v"].to_numpy()[q], "leaf": np.array(leaf, np.int64), "turn": np.array(turn, np.int64)})

    asked = reuse(routed.where("is_query").select("vec_id", "v").mapInPandas(walk, "query_id long, q array<double>, leaf long, turn long"))
    first = reuse(_top(_in_leaves(asked.where(F.col("turn") < FIRST).withColumn("bound", F.lit(float("inf"))), routed, k), ["query_id"], k))
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    rest = asked.where(F.col("turn") >= FIRST).join(bounds, "query_id", "left").fillna({"bound": float("inf")})
    found = first.select("query_id", "vec_id", "score").unionByName(_in_leaves(reuse(rest), routed, k))
    return _top(found, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _in_leaves(asked, routed, k):
    """(query_id, vec_id, score) candidates of (query_id, q, leaf, bound) in the rows of those leaves, at most k from each slice."""
    # One row per leaf: both counts are bounded by max_leaves, so every task can hold this table.
    parts = (asked.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE_QUERIES).alias("q_parts"))
             .join(routed.groupBy("leaf").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("d_parts")), "leaf"))
    parts = F.broadcast(reuse(parts))
    left = (asked.select("leaf", "query_id", "q", "bound").join(parts, "leaf").withColumn("qp", F.pmod(F.xxhash64("query_id"), F.col("q_parts")))
            .withColumn("dp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d_parts") - 1))).select("leaf", "qp", "dp", "query_id", "q", "bound"))
    right = (routed.select("leaf", "vec_id", "v").join(parts, "leaf").withColumn("dp", F.pmod(F.xxhash64("vec_id"), F.col("d_parts")))
             .withColumn("qp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1))).select("leaf", "qp", "dp", "vec_id", "v"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            found = _search(b["vec_id"].to_numpy(), _matrix(b["v"]), a["query_id"].to_numpy(), _matrix(a["q"]), a["bound"].to_numpy(), k)
        else:
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["leaf", "qp", "dp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
