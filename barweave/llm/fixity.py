"""Merkle fixity audit of record archives.

A file's records lie at offsets. Ranges of ``RANGE`` bytes hash their records in offset order, ``FANOUT`` neighbouring ranges hash into one range of
the next level, up to a root per file. Two replicas compare roots; below a root that differs only the children of differing
ranges are compared, level by level, and at the bottom the records of differing ranges. A group holds the records that start in
one range, or the children of one node, whatever the file's size.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import same

RANGE = 1 << 16
FANOUT = 256
FILE_PAGES = 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as bytes; null fields are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).cast("binary")


def page_records(pages: DataFrame, also=None) -> DataFrame:
    """The archive files of a page table: (file, offset, page_id, length, digest), ``FILE_PAGES`` consecutive ids to a file, in id order.

    ``also`` maps names to functions of the record's bytes, for further columns. Pages without an id are spread over files by their content.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    more = {name: fn(F.col("record")) for name, fn in (also or {}).items()}
    p = p.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *[c.alias(n) for n, c in more.items()])
    file = (F.when(F.col("page_id").isNotNull(), F.concat(F.lit("seg-"), F.floor(F.col("page_id") / FILE_PAGES).cast("string")))
            .otherwise(F.concat(F.lit("seg-x"), F.substring("digest", 1, 3))))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("file", file).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def ranges(records: DataFrame, width=RANGE, fanout=FANOUT, levels=None) -> list:
    """Tables (file, r, hash) of each level from the lowest to the roots, of (file, offset, length, digest)."""
    entry = F.struct("offset", "length", "digest")
    low = (records.groupBy("file", F.expr(f"offset div {width}").alias("r")).agg(F.sort_array(F.collect_list(entry)).alias("all"))
           .select("file", "r", F.sha2(F.concat(F.lit("0"), F.to_json("all")), 256).alias("hash")))
    out = [reuse(low)]
    for _ in range(levels - 1):
        up = (out[-1].groupBy("file", F.expr(f"r div {fanout}").alias("r")).agg(F.sort_array(F.collect_list(F.struct("r", "hash"))).alias("all"))
              .select("file", "r", F.sha2(F.concat(F.lit("1"), F.to_json("all")), 256).alias("hash")))
        out.append(reuse(up))
    return out


def height(last_offset, width=RANGE, fanout=FANOUT):
    n = 1
    while last_offset // (width * fanout ** (n - 1)):
        n += 1
    return n


def audit(a: DataFrame, b: DataFrame, width=RANGE, fanout=FANOUT) -> DataFrame:
    """Records in which replica ``b`` differs from ``a``: file, offset, kind, length_a, digest_a, length_b, digest_b.

    Both are tables (file, offset, length, digest) with any further columns. Kinds: missing, extra, length, content. Records that share an offset are compared
    as a sorted list (its first entry is shown). Rows with null file or offset cannot be placed and are ignored; two empty replicas agree.
    """
    cols = ["file", "offset", "length", "digest"]
    a, b = (x.select(*cols).where("file is not null and offset is not null") for x in (a, b))
    top = a.agg(F.max("offset").alias("m")).unionByName(b.agg(F.max("offset").alias("m"))).agg(F.max("m")).first()[0]
    levels = height(top or 0, width, fanout)
    tree_a, tree_b = ranges(a, width, fanout, levels), ranges(b, width, fanout, levels)
    bad = None
    for level in reversed(range(levels)):
        x, y = tree_a[level], tree_b[level]
        if bad is not None:
            up = F.expr(f"r div {fanout}")
            x, y = (t.withColumn("up", up).join(bad.withColumnRenamed("r", "up"), ["file", "up"], "left_semi").drop("up") for t in (x, y))
        x, y = x.withColumnRenamed("hash", "hash_a"), y.withColumnRenamed("hash", "hash_b")
        bad = reuse(x.join(y, ["file", "r"], "full").where(~same(F.col("hash_a"), F.col("hash_b"))).select("file", "r"))

    def records(t, s):
        near = t.withColumn("r", F.expr(f"offset div {width}")).join(bad, ["file", "r"], "left_semi")
        return near.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("length", "digest"))).alias(s))

    both = records(a, "x").join(records(b, "y"), ["file", "offset"], "full").where(~same(F.col("x"), F.col("y")))
    kind = (F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra")
            .when(~same(F.col("x.length"), F.col("y.length")), "length").otherwise("content"))
    return both.select("file", "offset", kind.alias("kind"), F.expr("x[0].length").alias("length_a"), F.expr("x[0].digest").alias("digest_a"),
                       F.expr("y[0].length").alias("length_b"), F.expr("y[0].digest").alias("digest_b"))
