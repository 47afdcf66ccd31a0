"""Exact quantiles of the values whose time lies in a range, for many ranges at once.

Rows are dealt into value buckets of about ``BUCKET_ROWS`` rows. A bucket tells how many of its values every range holds; running over the
buckets of a key, those counts give the bucket and the place of every wanted rank, and only those buckets are opened again. A key
that fits one bucket needs one look. So a group holds a bucket's rows and the ranges that ask for them, however many rows a key has.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import _borders, _bucket

BUCKET_ROWS = 20_000


def _held(values, queries):
    """Values in time order, and where each range begins and ends among them."""
    t, v = values.column("t").to_numpy(), values.column("v").to_numpy()
    order = np.argsort(t, kind="stable")
    t, v = t[order], v[order]
    return v, np.searchsorted(t, queries.column("lo").to_numpy(), "left"), np.searchsorted(t, queries.column("hi").to_numpy(), "left")


def _ranked(v, a, b, ranks):
    """The values of the given ranks within v[a:b]; NaN where there are fewer."""
    seg = v[a:b]
    ok = [r for r in ranks if 0 <= r < len(seg)]
    part = np.partition(seg, sorted(set(ok))) if ok else seg
    return [part[r] if 0 <= r < len(seg) else np.nan for r in ranks]


def _with_keys(keys, key, columns):
    n = len(next(iter(columns.values())))
    return pa.table({**{k: pa.array([s.as_py()] * n, s.type) for k, s in zip(keys, key)}, **columns})


def range_quantiles(values: DataFrame, queries: DataFrame, keys, qs, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """(keys, win, n, q): count and linearly interpolated quantiles of the values of a key with lo <= t < hi.

    ``values``: keys, t (long), v (double, no nulls). ``queries``: keys, win, lo, hi. A range without values gets n = 0 and NaN quantiles; queries
    of a key without values give no row.
    """
    keys = list(keys)
    kinds = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # may come from the values themselves
    most = values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= bucket_rows:
        def look(key, left, right):
            right = right if len(left) else right.slice(0, 0)
            v, a, b = _held(left, right)
            n, out = b - a, []
            for i, j, m in zip(a.tolist(), b.tolist(), n.tolist()):
                at = [q * (m - 1) for q in qs]
                got = _ranked(v, i, j, [int(f(x)) for x in at for f in (np.floor, np.ceil)])
                out.append([lo + (hi - lo) * (x - np.floor(x)) for lo, hi, x in zip(got[::2], got[1::2], at)])
            return _with_keys(keys, key, {"win": right.column("win"), "n": pa.array(n, pa.int64()), "q": pa.array(out, pa.list_(pa.float64()))})

        return values.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(look, f"{kinds}, win long, n long, q array<double>")
    return _bucketed(values, queries, keys, kinds, qs, most, bucket_rows)


def _bucketed(values, queries, keys, kinds, qs, most, bucket_rows):
    buckets = 1 << int(np.ceil(np.log2(-(-most // bucket_rows) + 1)))
    cuts = values.groupBy(*keys).agg(_borders("v", buckets).alias("_cuts"))
    held = values.join(cuts, keys).withColumn("bucket", _bucket("v", F.col("_cuts"), buckets)).drop("_cuts")
    asked = queries.select(*keys, "win", "lo", "hi").join(held.select(*keys, "bucket").distinct(), keys).select(
        *[F.col(c).alias(c) for c in (*keys, "bucket", "win", "lo", "hi")])

    def count(key, left, right):
        _, a, b = _held(left, right)
        return _with_keys([*keys, "bucket"], key, {"win": right.column("win"), "lo": right.column("lo"), "hi": right.column("hi"), "c": pa.array(b - a, pa.int64())})

    group = [*keys, "bucket"]
    counts = held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(count, f"{kinds}, bucket int, win long, lo long, hi long, c long")
    whole = W.partitionBy(*keys, "win")
    start = F.sum("c").over(whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumns({"n": F.sum("c").over(whole), "start": F.coalesce(start, F.lit(0))})
    places = F.explode(F.array(*[F.struct(F.lit(2 * i + j).alias("slot"), f(F.lit(float(q)) * (F.col("n") - 1)).cast("long").alias("rank"))
                                 for i, q in enumerate(qs) for j, f in enumerate((F.floor, F.ceil))]))
    picks = (counts.withColumn("p", places).where((F.col("p.rank") >= F.col("start")) & (F.col("p.rank") < F.col("start") + F.col("c")))
             .select(*group, "win", "lo", "hi", "n", F.col("p.slot").alias("slot"), (F.col("p.rank") - F.col("start")).alias("rank")))

    def look(key, left, right):
        v, a, b = _held(left, right)
        found = [_ranked(v, i, j, [r])[0] for i, j, r in zip(a.tolist(), b.tolist(), right.column("rank").to_pylist())]
        return _with_keys(group, key, {"win": right.column("win"), "n": right.column("n"), "slot": right.column("slot"), "v": pa.array(found, pa.float64())})

    picks = picks.select(*[F.col(c).alias(c) for c in picks.columns])
    found = held.join(picks.select(*[F.col(c).alias(c) for c in group]).distinct(), group, "left_semi").groupBy(*group).cogroup(picks.groupBy(*group)).applyInArrow(
        look, f"{kinds}, bucket int, win long, n long, slot int, v double")
    at = [F.max(F.when(F.col("slot") == s, F.col("v"))) for s in range(2 * len(qs))]
    part = [F.lit(float(q)) * (F.max("n") - 1) for q in qs]
    some = found.groupBy(*keys, "win").agg(F.max("n").alias("n"), F.array(*[at[2 * i] + (at[2 * i + 1] - at[2 * i]) * (p - F.floor(p)) for i, p in enumerate(part)]).alias("q"))
    none = counts.where("n = 0").select(*keys, "win", "n").distinct().withColumn("q", F.array(*[F.lit(float("nan"))] * len(qs)))
    return some.unionByName(none)
