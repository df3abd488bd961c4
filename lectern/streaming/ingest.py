"""Incremental forms with Structured Streaming: upserts, refresh of artifacts by title, recomputed stale chunks, feeds of the last rows.

Each micro-batch writes new versions of the buckets that it touches, so a batch that is run again leaves the same store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.embed import with_vectors
from lectern.operators.setops import one_per_key, upsert
from lectern.schemas import CHUNK


def chunk_stream(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def versioned_batches(stream: DataFrame, store: str, checkpoint: str, deal_by: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64, mode: str = "append") -> StreamingQuery:
    """Merge each micro-batch into the store: merge(rows of the buckets that it touches, or None, and the batch) to their new rows. Runs what is there, then stops.

    Rows are dealt to buckets by a hash of deal_by; a batch writes store/v=<batch>/bucket=<b> for the buckets that it touches only. What
    two later versions of a bucket have replaced is deleted. Both frames have the column bucket, which merge must keep.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("bucket", F.pmod(F.xxhash64(*deal_by), F.lit(buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())
        if not touched:
            return
        after = merge(latest(spark, store, below=number, buckets=touched, keep_bucket=True), marked)
        after.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/v={number}")
        _drop_replaced(spark, store, number)

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, store: str, checkpoint: str, keys: list[str], buckets: int = 64, order: Column | None = None, mode: str = "append") -> StreamingQuery:
    """Upsert each micro-batch into the store by keys. Of repeated keys in a batch the last in the order counts, by default as JSON."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return one_per_key(batch, keys, order) if before is None else upsert(before, batch, keys, order)

    return versioned_batches(stream, store, checkpoint, keys, merge, buckets, mode)


def refresh_batches(stream: DataFrame, store: str, checkpoint: str, order: Column, buckets: int = 64) -> StreamingQuery:
    """Artifacts (parent_key, title, ...) replaced by title: of each title of a parent the last in the order stays, whenever it comes."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return one_per_key(batch if before is None else before.unionByName(batch), ["parent_key", "title"], order)

    return versioned_batches(stream, store, checkpoint, ["parent_key", "title"], merge, buckets)


def feed_batches(stream: DataFrame, store: str, checkpoint: str, group: str, order: list[Column], most: int, buckets: int = 64) -> StreamingQuery:
    """The `most` first rows of each group in an order that must be total: a feed of what was added or changed last, kept as it goes on."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return rows.dropDuplicates().withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")

    return versioned_batches(stream, store, checkpoint, [group], merge, buckets)


def recompute_batches(chunks: DataFrame, stored: DataFrame, store: str, checkpoint: str, provider: str = "hashing", buckets: int = 64, **options) -> StreamingQuery:
    """Chunks (chunk_id, text, ...) of a stream whose stored digest is missing or differs, with new digests and vectors, upserted into the store."""
    stale = stale_stream(chunks, stored).withColumn("text_sha256", F.sha2("text", 256))

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        fresh = with_vectors(one_per_key(batch, ["chunk_id"]), provider, **options)
        return fresh if before is None else upsert(before, fresh, ["chunk_id"])

    return versioned_batches(stale, store, checkpoint, ["chunk_id"], merge, buckets)


def _versions(spark: SparkSession, store: str) -> dict[int, list[int]]:
    """The versions of each bucket, ascending; only those of finished writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if fs.exists(path):
        for v in fs.listStatus(path):
            if v.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
                for b in fs.listStatus(v.getPath()):
                    if (name := b.getPath().getName()).startswith("bucket="):
                        found.setdefault(int(name[7:]), []).append(int(v.getPath().getName()[2:]))
    return {b: sorted(v) for b, v in found.items()}


def _drop_replaced(spark: SparkSession, store: str, number: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, versions in _versions(spark, store).items():
        for old in [v for v in versions if v <= number][:-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/v={old}/bucket={bucket}"), True)


def latest(spark: SparkSession, store: str, below: int | None = None, buckets: list[int] | None = None, keep_bucket: bool = False) -> DataFrame | None:
    """The store: of each bucket the newest version (below a batch number), None if there is none."""
    found = {b: [v for v in own if below is None or v < below] for b, own in _versions(spark, store).items() if buckets is None or b in buckets}
    paths = [f"{store}/v={own[-1]}/bucket={b}" for b, own in sorted(found.items()) if own]
    if not paths:
        return None
    # the bucket's folder name isn't a column of its files, since versions differ
    rows = spark.read.parquet(*paths)
    if not keep_bucket:
        return rows
    return rows.withColumn("bucket", F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int"))


def stale_stream(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks of a stream whose text differs from the stored digest, or that have none: stream-static join."""
    known = stored.select("chunk_id", "text_sha256")
    joined = chunks.join(known, "chunk_id", "left")
    return joined.where(~F.col("text_sha256").eqNullSafe(F.sha2("text", 256))).drop("text_sha256")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and sums by tumbling window and type, with a watermark."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
