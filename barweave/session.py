"""Session settings shared by jobs, tests and the bench."""
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN = []


def build_session(app="barweave", master=None, shuffle_partitions=None, extra=None):
    """A session with adaptive execution, Arrow transfer and UTC timestamps.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit settings apply and
    adaptive execution sizes the reduce side from the bytes it sees.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.parquet.nanosAsLong", "true")  # nanosecond columns arrive as epoch numbers
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def use_utc(spark):
    """Bar arithmetic works on UTC instants; pin the session zone before a plan is built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark):
    """The folder for intermediate tables, which every executor reaches: spark.checkpoint.dir, or the warehouse if that is unset.

    A warehouse in the driver's own file system serves local runs only; on a cluster it raises, since executors would not find what others wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    named = spark.conf.get("spark.sql.warehouse.dir")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")) and re.match(r"file:|/|[^:]*$", named):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    return named.rstrip("/")


def store(df: DataFrame):
    """Write a table to the shared folder; gives the table read back and its path, which the caller hands to ``drop``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def reuse(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches of a plan read, and go on from the table.

    Branches then scan just the columns they need instead of repeating the work and the planning behind
    them, sizes are known to the join planner, and a lost executor costs nothing but the scan.
    """
    table, path = store(df)
    _WRITTEN.append((df.sparkSession, path))
    return table


def scratch_path(spark) -> str:
    """A new path in the shared folder for files that Spark writes by itself, deleted by ``release``."""
    path = f"{shared_folder(spark)}/barweave-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def drop(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def collecting():
    """Gives a list that, when the block ends, holds the intermediate tables written in it."""
    mine, before = [], len(_WRITTEN)
    yield mine
    mine += _WRITTEN[before:]


def release(tables=None):
    """Delete intermediate tables once their readers are done: those of ``collecting``, or else all written so far."""
    for entry in list(_WRITTEN if tables is None else tables):
        if entry in _WRITTEN:
            _WRITTEN.remove(entry)
            drop(*entry)
