"""Drift of closed sessions against an index of what their servers showed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.catalogue import ScanConfig
from ..operators.detectors import Sessions
from ..operators.drift import drift, fingerprint_items, fingerprints
from ..plans.durable import discard, written
from .live import BUCKETS, FRAME_NAMES, BucketTable

PRINTS = (
    "session_id string, server_key string, first_ts string, last_ts string, server_name string, "
    "server_version string, protocol_version string, event_count bigint, tail_only boolean"
)
ITEMS = "session_id string, kind string, item string, hash string, server_key string"
SERVERS = "server_key string"


def history_digest(prints: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sessions and items that decide the drift of any later session of their server.

    These are the first session to show an item, a schema, a name or a version, the first
    session of the server, and the last listing with all it declared.  An index of them grows
    with what servers show, not with their sessions.
    """
    position = F.struct(F.coalesce("first_ts", F.lit("")).alias("at"), F.col("session_id"))
    placed = items.join(prints.select("session_id", "server_key", position.alias("position")), "session_id")
    first = placed.groupBy("server_key", "kind", "item", "hash").agg(F.min("position").alias("position"))
    last = placed.filter("kind = 'declared'").groupBy("server_key").agg(F.max("position").alias("position"))
    listed = placed.filter("kind = 'declared'").join(last, ["server_key", "position"])
    names = ["server_key", "kind", "item", "hash", "position"]
    kept = first.select(*names).unionByName(listed.select(*names)).distinct()
    kept_items = kept.select(F.col("position.session_id").alias("session_id"), "kind", "item", "hash", "server_key")

    def firsts(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy("server_key", *key).agg(F.min(position).alias("p")).select(F.col("p.session_id").alias("session_id"))

    versioned = prints.filter("coalesce(server_version, '') <> ''")
    sessions = kept_items.select("session_id").unionByName(firsts(prints)).unionByName(firsts(prints, "server_name")).unionByName(
        firsts(versioned, "server_name", "server_version")
    )
    return prints.join(sessions.distinct(), "session_id", "left_semi"), kept_items


class LiveDrift:
    """Drift of the sessions of each batch, which are closed, against all closed before them.

    The index of a server is written anew when a batch touches it, in buckets of servers, and
    only touched buckets are read.  Batches are expected in the order of their sessions'
    beginnings: a session that comes late is compared by its place, but findings of sessions
    reported before stay as they are.  A repeated batch overwrites its own parts.
    """

    def __init__(
        self, spark: SparkSession, folder: str, server_key: Column | None = None,
        config: ScanConfig = ScanConfig(), buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self.server_key, self.config = spark, folder, server_key, config
        self.prints, self.items = (
            BucketTable(spark, f"{folder}/{name}", buckets, "server_key", spread="session_id") for name in ("prints", "items")
        )
        self.servers = BucketTable(spark, f"{folder}/servers", buckets, "server_key")

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Write the drift of a batch's sessions, and the index after them."""
        names = [c for c in FRAME_NAMES if c != "epoch"]
        s = Sessions(batch.select(*names), self.config).stored()
        prints = written(fingerprints(s, self.server_key).select(*[c.split()[0] for c in PRINTS.split(", ")]))
        items = written(fingerprint_items(s))
        self.servers.write(prints.select("server_key").distinct(), number)
        touched = self.servers.read(SERVERS, batch=number)
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]
        before = self.servers.read(SERVERS, buckets).filter(F.col("batch") < number)
        newest = before.join(touched.select("server_key"), "server_key", "left_semi").groupBy("server_key").agg(F.max("batch").alias("batch"))

        def indexed(table: BucketTable, schema: str) -> DataFrame:
            return table.read(schema, buckets).join(newest, ["server_key", "batch"]).drop("batch", "bucket")

        all_prints = written(indexed(self.prints, PRINTS).unionByName(prints))
        all_items = written(indexed(self.items, ITEMS).drop("server_key").unionByName(items))
        found = drift(all_prints, all_items).join(prints.select("session_id"), "session_id", "left_semi")
        found.drop("nth").write.mode("overwrite").parquet(f"{self.folder}/drift/batch={number}")
        kept_prints, kept_items = history_digest(all_prints, all_items)
        self.prints.write(kept_prints, number)
        self.items.write(kept_items, number)
        discard(s.lines_table, s.events_table, prints, items, all_prints, all_items)

    def findings(self) -> DataFrame:
        """The drift of all sessions so far, with the batch that closed them."""
        return self.spark.read.parquet(f"{self.folder}/drift")

    def start(self, frames: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of the frames of closed sessions."""
        return (
            frames.writeStream.foreachBatch(self.absorb)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
