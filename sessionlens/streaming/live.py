"""Views of sessions kept current while logs grow, with a table of their changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import MapType

from ..functions.catalogue import ScanConfig
from ..operators.detectors import DETECTORS, Detector, Sessions, detect
from ..operators.events import FRAME_COLUMNS, ROLE_TYPES, with_roles

FRAME_TYPES = (
    "session_id string, epoch bigint, block bigint, ord bigint, seq bigint, ts string, dir string, "
    "frame variant, raw string, gate variant"
)
FRAME_NAMES = [c.split()[0] for c in FRAME_TYPES.split(", ")]
LINE_TYPES = f"{FRAME_TYPES}, {ROLE_TYPES}"
LINE_COLUMNS = [*FRAME_COLUMNS, *(c.split()[0] for c in ROLE_TYPES.split(", "))]
VERSIONS = "session_id string, epoch bigint"
BUCKETS = 64


class BucketTable:
    """A table of rows by bucket of their key, a session by default, and by batch.

    A batch overwrites its own parts only, so repeating it changes nothing, and readers of
    some keys list and read only the buckets of these.  A bucket is written by several tasks,
    which share its rows by ``spread``, so that few buckets do not mean few tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, key: str = "session_id", spread: str | None = None):
        self.spark, self.folder, self.buckets, self.key = spark, folder, buckets, key
        self.spread = spread or key
        path = spark._jvm.org.apache.hadoop.fs.Path
        system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._exists = lambda place: system.exists(path(place))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, number: int) -> None:
        placed = rows.withColumn("bucket", self.bucket()).withColumn("batch", F.lit(number).cast("bigint"))
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        part = F.pmod(F.xxhash64(F.lit("slice"), self.spread), F.lit(slices))
        placed.repartition("bucket", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "batch"
        ).parquet(self.folder)

    def read(self, schema: str, buckets: Sequence[int] | None = None, batch: int | None = None) -> DataFrame:
        """Rows of some buckets (all by default), of one batch if named, with ``batch`` and ``bucket``."""
        part = "" if batch is None else f"/batch={batch}"
        chosen = range(self.buckets) if buckets is None else buckets
        paths = [p for b in chosen if self._exists(p := f"{self.folder}/bucket={b}{part}")]
        schema = f"{schema}, bucket int, batch bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*paths)


class LiveView:
    """Rows of a view over a stream of frames, and what each batch changed of them.

    ``view`` turns ``Sessions`` into rows with a ``session_id``; a session's rows must depend
    on its own frames only.  A later frame can change an earlier answer (a tool declared after
    its call, a second frame with the same id), so a batch computes the view anew for the
    sessions it touches, over all their frames, with the batch plan.  Frames, versions and
    rows lie in buckets of sessions and only the touched buckets are read.  The difference
    between the new rows and the last ones, as bags, is written under the batch number:
    ``op`` insert or retract, ``copies``, and the columns of the view.

    A frame of a higher ``epoch`` replaces all earlier ones of its session.  A repeated batch
    overwrites its own parts and compares with the versions before it, so tables are exact
    after a restart.
    """

    def __init__(
        self, spark: SparkSession, folder: str, view: Callable[[Sessions], DataFrame],
        config: ScanConfig = ScanConfig(), buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self.view, self.config = spark, folder, view, config
        self.frames = BucketTable(spark, f"{folder}/frames", buckets, spread="ord")
        self.versions, self.rows = (BucketTable(spark, f"{folder}/{name}", buckets) for name in ("versions", "rows"))

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Add a batch of frames, and write the new rows of its sessions and the changes."""
        if "epoch" not in batch.columns:
            batch = batch.withColumn("epoch", F.lit(0).cast("bigint"))
        # a frame is parsed when it arrives and not again by the detectors of later batches
        self.frames.write(with_roles(batch.select(*FRAME_NAMES), "epoch"), number)
        # a batch is read back by its number, as its source may not give the same rows again
        arrived = self.frames.read(LINE_TYPES, batch=number)
        self.versions.write(arrived.groupBy("session_id").agg(F.max("epoch").alias("epoch")), number)
        versions = self.versions.read(VERSIONS, batch=number)
        touched = [r.bucket for r in versions.select("bucket").distinct().collect()]
        now = versions.select("session_id", "epoch")
        counting = self.frames.read(LINE_TYPES, touched).filter(F.col("batch") <= number).join(now, ["session_id", "epoch"])
        lines = counting.filter("role IS NOT NULL").select(*LINE_COLUMNS)
        made = plain_columns(self.view(Sessions(counting.select(*FRAME_COLUMNS), self.config, lines_table=lines)))
        self.rows.write(made, number)
        schema = sql_schema(made)
        new = self.rows.read(schema, touched, number).drop("batch", "bucket")
        last = self._newest(touched, number - 1).join(now.select("session_id"), "session_id", "left_semi")
        old = self.rows.read(schema, touched).join(last, ["session_id", "batch"]).select(*made.columns)
        bag_difference(new, old).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")

    def _newest(self, buckets: Sequence[int] | None, upto: int | None = None) -> DataFrame:
        versions = self.versions.read(VERSIONS, buckets)
        if upto is not None:
            versions = versions.filter(F.col("batch") <= upto)
        return versions.groupBy("session_id").agg(F.max("batch").alias("batch"))

    def changes(self) -> DataFrame:
        """``batch, op, copies`` and the columns of the view, for every change of every batch."""
        return self.spark.read.parquet(f"{self.folder}/changes")

    def current(self) -> DataFrame:
        """The view now."""
        schema = sql_schema(self.changes().drop("op", "copies", "batch"))
        rows = self.rows.read(schema).join(self._newest(None), ["session_id", "batch"])
        return rows.drop("batch", "bucket")

    def replayed(self, upto: int) -> DataFrame:
        """The view after a batch, from the changes alone."""
        changes = self.changes().filter(F.col("batch") <= upto)
        names = [c for c in changes.columns if c not in ("batch", "op", "copies")]
        sign = F.when(F.col("op") == "insert", F.col("copies")).otherwise(-F.col("copies"))
        kept = changes.groupBy(*names).agg(F.sum(sign).alias("copies")).filter("copies > 0")
        return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names)

    def feed(self, *key: str) -> DataFrame:
        """Changes of a view whose rows have a key: ``batch, op`` (insert, update or delete), the
        key and ``row``, the new row, or the last one of a deleted key."""
        changes = self.changes()
        row = F.struct(*[c for c in changes.columns if c not in ("batch", "op", "copies")])
        inserted = F.col("op") == "insert"
        return changes.groupBy("batch", *key).agg(
            F.max(F.when(inserted, row)).alias("made"), F.max(F.when(~inserted, row)).alias("gone")
        ).select(
            "batch",
            F.when(F.col("gone").isNull(), "insert").when(F.col("made").isNull(), "delete").otherwise("update").alias("op"),
            *key, F.coalesce("made", "gone").alias("row"),
        )

    def start(self, frames: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of frames; ``trigger`` as for ``DataStreamWriter.trigger``."""
        return (
            frames.writeStream.foreachBatch(self.absorb)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


class LiveFindings(LiveView):
    """The findings of the sessions of a stream; ``detail`` is a list of entries."""

    def __init__(
        self, spark: SparkSession, folder: str, detectors: Sequence[Detector] = DETECTORS,
        config: ScanConfig = ScanConfig(), buckets: int = BUCKETS,
    ):
        super().__init__(spark, folder, lambda s: detect(s, detectors), config, buckets)

    def findings(self) -> DataFrame:
        """The newest findings of every session."""
        return self.current()


def plain_columns(rows: DataFrame) -> DataFrame:
    """Maps as sorted lists of entries, which can be compared."""
    maps = {f.name for f in rows.schema.fields if isinstance(f.dataType, MapType)}
    return rows.select(*[F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rows.columns])


def sql_schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def bag_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """``op, copies`` and the columns: what has to be inserted and retracted to get from the
    rows of ``old`` to those of ``new``."""
    signed = new.withColumn("copies", F.lit(1)).unionByName(old.withColumn("copies", F.lit(-1)))
    net = signed.groupBy(*new.columns).agg(F.sum("copies").alias("copies")).filter("copies <> 0")
    return net.select(
        F.when(F.col("copies") > 0, "insert").otherwise("retract").alias("op"), F.abs("copies").alias("copies"), *new.columns
    )
