"""The streaming form of the slot aggregate."""
from ..session import scratch_path
from ..sources import standins as S
from ..streaming import slots as Z
from .base import query
from .features import SLOT_DOUBLES, SLOT_LONGS

KEEP = [c for c in SLOT_DOUBLES.split() if not c.endswith("_median")]


class _StreamTables(S.Tables):
    def __getattr__(self, name):
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return Z.read_posts(self.spark, self.sf_dir, schema, f"{name}.parquet")


@query("stream_slot_sentiment", f"SELECT ticker, timestamp, {', '.join(KEEP + SLOT_LONGS.split())} FROM slots_6h WHERE timestamp + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
       ["slots_6h"], doubles=" ".join(KEEP), longs=SLOT_LONGS, dp=9)
def _(t):
    posts = S.scored_posts(_StreamTables(t.spark, t.sf_dir))
    base = scratch_path(t.spark)
    Z.write_available(Z.stream_slots(posts, "6h"), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out").select("ticker", "timestamp", *KEEP, *SLOT_LONGS.split())
