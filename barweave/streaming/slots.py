"""Slot aggregates over a stream of scored posts.

The watermark plays the part of the observation cutoff: a slot is emitted once, when its whole interval
lies behind the watermark, and later posts of it are dropped. State is bounded by the delay: open
slots and the post ids seen within it.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slots import SCORERS, blend_posts

WIDTHS = {"15min": "15 minutes", "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}


def read_posts(spark: SparkSession, folder, schema, glob="*.parquet", files_per_trigger=None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def stream_slots(posts: DataFrame, horizon, delay="2 hours", scorers=SCORERS, key="post_id") -> DataFrame:
    """Per completed (ticker, slot): counts, bullishness, mean, approximate median and deviation of the scores."""
    p = posts.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", delay).dropDuplicatesWithinWatermark([key])
    p = blend_posts(p, scorers)
    aggs = [F.count(F.lit(1)).alias("post_count")]
    for m in scorers:
        s = F.col(f"{m}_title_sentiment")
        pos, neg = F.count_if(s == "positive"), F.count_if(s == "negative")
        aggs += [F.try_divide(pos, pos + neg).alias(f"{m}_bullishness_ratio"), (pos + neg).alias(f"{m}_directional_post_count")]
        for v in ("title_score", "selftext_score", "combined_score"):
            c = F.col(f"{m}_{v}")
            aggs += [F.avg(c).alias(f"{m}_{v}_mean"), F.percentile_approx(c, 0.5, 10000).alias(f"{m}_{v}_median"),
                     F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)).alias(f"{m}_{v}_std")]
    g = p.groupBy("ticker", F.window("date", WIDTHS[horizon]).alias("w")).agg(*aggs)
    return g.withColumn("timestamp", F.col("w.start").cast("timestamp_ntz")).drop("w")


def write_available(slots: DataFrame, path, checkpoint):
    """Process everything there is and stop; a restart goes on from the checkpoint, writing each slot once."""
    q = slots.writeStream.format("parquet").outputMode("append").option("path", path) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
