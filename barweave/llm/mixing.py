"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share a token budget by weight, capped at a multiple of each source's size. Blocks of equal token count are the
seats: highest quotients v / (2k - 1) give each source its blocks, and each shard of a source its share of them. The block is so
small that the least target above zero holds ``FINE`` blocks, down to single words, so rounding loses no source. Within a
shard the documents stand in a seeded order; every block is taken ``quota div blocks`` times, and the rest of the quota is
a run of neighbouring blocks from a seeded start, so at most two documents of a shard are cut. Everything is DataFrame code.

Sources are split into shards of bounded row count, so a source with a third of all rows spreads over many tasks; windows
see one shard, one source's shards, or the table of sources.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse
from .common import same

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK, FINE = 16, 32  # words of a block at most; blocks that the least target holds
SHARD_ROWS = 1500
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def as_number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Adds ``target`` to a table (source, source_size): weights repeat over sources by code point, null last.

    The budget is ``share`` of all sizes. A source whose part would exceed ``cap`` times its size stops there, and the excess is shared
    by weight among the others until none is above: sources sorted by size per weight fill up in that order, so the water
    level is the first one that the next source does not reach. One row per source meets in the window.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                              ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_full", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    t = t.withColumn("_level", (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    t = t.withColumn("_rank", F.row_number().over(fill))
    reached = F.when(F.col("_level") <= F.col("_full"), F.struct("_rank", "_level"))
    level = F.coalesce(F.min(reached).over(every)["_level"], F.lit(float("inf")))
    return t.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).drop("_w", "_cap", "_full", "_level", "_rank")


def apportion(df: DataFrame, keys, votes, seats, order, name="quota") -> DataFrame:
    """Adds the Sainte-Lague seats of each row among the rows of its ``keys`` group.

    ``seats`` holds the group's seat total. Rounding votes / d down and up for two divisors d that seat too few and too many bounds
    each row's result, so only the few seats between the bounds compete by quotient; ties go to the smaller ``order``.
    """
    group = Window.partitionBy(*keys)
    total, rivals, s = F.sum(votes).over(group), F.count_if(F.col(votes) > 0).over(group), F.col(seats).cast("double")
    d = df.withColumns({"_t": total, "_s": s, "_n": rivals.cast("double")})
    part = F.when(F.col("_t") > 0, F.col(votes) / F.col("_t")).otherwise(F.lit(0.0))
    low = F.floor(part * (F.col("_s") - F.col("_n") / 2) + 0.5) - 1
    high = F.floor(part * (F.col("_s") + F.col("_n") / 2) + 0.5) + 1
    d = d.withColumn("_low", F.greatest(low, F.lit(0)).cast("long"))
    d = d.withColumn("_high", F.when(part > 0, F.greatest(high, F.col("_low"))).otherwise(F.col("_low")).cast("long"))
    open_seats = F.col("_s").cast("long") - F.sum("_low").over(group)
    d = d.withColumn("_open", open_seats)
    row = Window.partitionBy(*keys).orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in order])
    won = (d.where("_high > _low").select(*keys, *order, votes, "_open", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
           .withColumn("_place", F.row_number().over(row)).where("_place <= _open")
           .groupBy(*keys, *order).agg(F.count("*").alias("_won")))
    on = None
    d, won = d.alias("d"), won.alias("w")
    for c in [*keys, *order]:
        term = same(F.col(f"d.{c}"), F.col(f"w.{c}"))
        on = term if on is None else on & term
    return (d.join(won, on, "left").select("d.*", (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(name))
            .drop("_t", "_s", "_n", "_low", "_high", "_open"))


def mixture(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, cap=CAP,
            block=None, shard_rows=SHARD_ROWS) -> DataFrame:
    """One row per input row: doc_id, source, text_key, size, source_size, target, taken, and where the taken words lie.

    ``block`` fixes the words of a block, which else follow from the least target. ``passes`` full copies are taken, then words [start_1, end_1) and [start_2, end_2) of the document. Sizes count words of any text, null
    as empty; a null source is a source of its own; rows without words get taken 0. Rows are ordered by a digest of seed, id
    and text, so reruns agree and rows that repeat both are interchangeable. Other columns are ignored.
    """
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = reuse(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("text_key"))
        .withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
        .withColumn("place", seeded(F.col("doc_id").cast("string"), F.col("text_key"))))
    sizes = rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    words = F.lit(block) if block else F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.coalesce(least, F.lit(0.0)) / FINE)))
    goal = (targets(sizes, weights, share, cap).withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("long"))
            .withColumn("block", words.cast("long")).withColumn("blocks_wanted", F.col("target") / F.col("block")))
    goal = goal.withColumn("seats", F.round(F.sum("blocks_wanted").over(Window.partitionBy())).cast("long"))
    goal = reuse(apportion(goal.withColumn("all", F.lit(1)), ["all"], "blocks_wanted", "seats", ["src"], "source_quota")
                 .select("src", "source_size", "target", "shards", "block", "source_quota"))
    placed = (rows.join(goal.select("src", "source_size", "target", "shards", "block"), "src")
              .withColumn("shard", as_number(F.col("place")) % F.col("shards")))
    placed = reuse(placed)
    shards = (placed.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"))
              .withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long")).join(goal.select("src", "source_quota"), "src"))
    shards = shards.withColumn("votes", F.col("blocks").cast("double"))
    limit = F.sum("blocks").over(Window.partitionBy("src")) * cap
    shards = shards.withColumn("seats", F.least(F.col("source_quota"), limit))
    quota = (apportion(shards, ["src"], "votes", "seats", ["shard"])
             .select("src", "shard", "shard_size", "blocks", "quota",
                     F.when(F.col("blocks") > 0, as_number(seeded(F.col("src"), F.col("shard").cast("string"))) % F.col("blocks"))
                     .otherwise(F.lit(0)).alias("first")))
    order = Window.partitionBy("src", "shard").orderBy("place", "doc_id", "size")
    d, block = placed.join(quota, ["src", "shard"]), F.col("block")
    d = d.withColumn("b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("size"))
    passes = F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0))
    extra = F.when(F.col("blocks") > 0, F.expr("quota % blocks")).otherwise(F.lit(0))
    d = d.withColumns({"passes": passes.cast("long"), "extra": extra.cast("long")})
    tail_end = F.least(F.col("shard_size"), (F.col("first") + F.col("extra")) * block)
    head_end = F.greatest(F.lit(0), F.col("first") + F.col("extra") - F.col("blocks")) * block

    def inside(lo, hi):
        start = F.least(F.greatest(lo, F.col("a")), F.col("b")) - F.col("a")
        return start, F.greatest(start, F.least(hi, F.col("b")) - F.col("a"))

    s1, e1 = inside(F.lit(0).cast("long"), head_end)
    s2, e2 = inside(F.col("first") * block, tail_end)
    d = d.withColumns({"start_1": s1, "end_1": e1, "start_2": s2, "end_2": e2})
    taken = F.col("passes") * F.col("size") + F.col("end_1") - F.col("start_1") + F.col("end_2") - F.col("start_2")
    return d.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.alias("taken"),
                    "passes", "start_1", "end_1", "start_2", "end_2")


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document once for each whole copy taken, and once more with the words of its cut.

    A cut joins its words by single blanks; whole copies keep their text. Documents of which nothing is taken are left out.
    """
    names = docs.columns
    given = {n: F.col(f"c{i}") for i, n in enumerate(names)}  # own names cannot clash with these
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text, source = (f"c{names.index(n)}" for n in (id_col, text_col, source_col))
    cut = F.col("end_1") - F.col("start_1") + F.col("end_2") - F.col("start_2")
    whole = F.col("passes") + F.when(cut >= F.col("size"), 1).otherwise(0)
    pieces = F.array(*[F.struct(F.col(f"start_{i}").alias("start"), F.col(f"end_{i}").alias("end")) for i in (1, 2)])
    cuts = F.when(cut < F.col("size"), F.filter(pieces, lambda p: p["end"] > p["start"])).otherwise(F.expr("array()"))
    uncut = F.array_repeat(F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")), whole.cast("int"))
    plan = (mixture(docs, id_, text, source, **how).where("taken > 0")
            .select("doc_id", "source", "text_key", F.explode(F.concat(uncut, cuts)).alias("piece"))
            .groupBy("doc_id", "source", "text_key").agg(F.collect_list("piece").alias("pieces")))
    keyed = docs.withColumn("key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    # Rows that repeat id, source and text share one list of pieces, so one of them carries it.
    repeats = keyed.groupBy(id_, source, "key").agg(F.count("*").alias("many")).where("many > 1").select(
        F.col(id_).alias("rep_id"), F.col(source).alias("rep_source"), F.col("key").alias("rep_key"))
    match = same(F.col(id_), F.col("rep_id")) & same(F.col(source), F.col("rep_source")) & (F.col("key") == F.col("rep_key"))
    once = keyed.join(repeats, match, "left_anti")
    first = keyed.join(repeats, match, "left_semi").dropDuplicates([id_, source, "key"])
    on = same(F.col(id_), F.col("doc_id")) & same(F.col(source), F.col("source")) & (F.col("key") == F.col("text_key"))
    taken = once.unionByName(first).join(plan, on).withColumn("piece", F.explode("pieces"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    a, b = F.col("piece.start"), F.col("piece.end")
    part = F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), " ")
    return taken.withColumn(text, F.when(a.isNull(), F.col(text)).otherwise(part)).select(*[c.alias(n) for n, c in given.items()])
