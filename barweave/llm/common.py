"""Helpers shared by the training-data operators."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import use_utc


BATCH_ROWS = 1000  # rows that travel to Python at a time; texts can be long


def prepared(spark):
    """The session with UTC times and batches that stay small with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return use_utc(spark)


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null; usable as a hash-join key."""
    return a.eqNullSafe(b)


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their text."""
    return F.xxhash64(text)


def stayers(docs: DataFrame, id_col, text_col, key_of, choose) -> DataFrame:
    """The rows of ``docs`` that ``choose(docs, id, text)`` names by (doc_id, key, n_rows), one each, with all their columns.

    ``key_of`` makes the key of a text. Meanwhile the columns have positional names, so none of the table's own can clash.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    stay = choose(docs, id_, text).withColumnRenamed("key", "stay_key")
    kept = docs.withColumn("key", key_of(F.col(text))).join(stay, same(F.col(id_), F.col("doc_id")) & (F.col("key") == F.col("stay_key")))
    once, many = kept.where("n_rows = 1"), kept.where("n_rows > 1").dropDuplicates([id_, "key"])
    return once.unionByName(many).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
