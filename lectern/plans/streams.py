"""Streams over the tables' files, run to their end, and the state they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.bind import table
from lectern.plans.query import registrar
from lectern.stages import Stages
from lectern.streaming import ingest

QUERIES, query = registrar()


def _stream(spark, sf, name, files=1):
    """A table as a stream of its files. The path is a pattern, as a stream takes a single file only by one."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("maxFilesPerTrigger", files).parquet(f"{sf}/{name}.parque[t]")


@query("R2 K12", "SELECT source AS parent_key, lang AS title, max(doc_id) AS version, arg_max(md5(text), doc_id) AS digest FROM documents GROUP BY source, lang")
def refresh_stream(spark, sf):
    """Every document as an artifact titled by its language: the last version of each title of a source."""
    path = Stages(spark, "refresh").path
    rows = _stream(spark, sf, "documents", 64).select(F.col("source").alias("parent_key"), F.col("lang").alias("title"), F.col("doc_id").alias("version"), F.md5("text").alias("digest"))
    ingest.refresh_batches(rows, f"{path}/store", f"{path}/checkpoint", F.col("version"), buckets=8).awaitTermination()
    return ingest.latest(spark, f"{path}/store")


@query("R3 J17 X23", "SELECT doc_id AS id, sha256(text) AS text_sha256, 'hashing-16' AS model FROM documents WHERE doc_id % 101 = 7 OR doc_id % 97 = 3")
def stale_recomputed(spark, sf):
    """Chunks whose text changed since, or that have no vector yet, with new digests and vectors."""
    path = Stages(spark, "recomputed").path
    docs = table(spark, sf, "documents")
    stored = docs.where("doc_id % 97 <> 3").select(F.col("doc_id").cast("string").alias("chunk_id"), F.sha2(F.when(F.col("doc_id") % 101 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    chunks = _stream(spark, sf, "documents", 64).select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    ingest.recompute_batches(chunks, stored, f"{path}/store", f"{path}/checkpoint", dim=16, buckets=8).awaitTermination()
    return ingest.latest(spark, f"{path}/store").where(F.size("vector") == 16).select(F.col("chunk_id").cast("long").alias("id"), "text_sha256", "model")


@query("R4 O2", "SELECT source, doc_id, r AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 104729) % 1000 DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def recent_feed(spark, sf):
    """The five documents of each source that were modified last, kept while files come in."""
    path = Stages(spark, "feed").path
    rows = _stream(spark, sf, "documents", 64).select("source", "doc_id", ((F.col("doc_id") * 104729) % 1000).alias("modified"))
    ingest.feed_batches(rows, f"{path}/store", f"{path}/checkpoint", "source", [F.desc("modified"), F.asc("doc_id")], 5, buckets=8).awaitTermination()
    kept = ingest.latest(spark, f"{path}/store")
    # five rows of a source
    better = kept.select(F.col("source").alias("s"), F.col("modified").alias("m"), F.col("doc_id").alias("d"))
    before = (F.col("m") > F.col("modified")) | ((F.col("m") == F.col("modified")) & (F.col("d") <= F.col("doc_id")))
    return kept.join(better, (F.col("source") == F.col("s")) & before).groupBy("source", "doc_id").agg(F.count("*").alias("place"))


@query("R1 U1", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS starts, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Events by day and type in a stateful stream, whose updates are upserted."""
    path = Stages(spark, "windows").path
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = ingest.event_counts(events, "1 day", "2 days")
    rows = counts.select("event_type", F.col("window.start").cast("timestamp").cast("long").alias("starts"), "n")
    ingest.upsert_batches(rows, f"{path}/store", f"{path}/checkpoint", ["event_type", "starts"], buckets=4, order=F.col("n"), mode="update").awaitTermination()
    return ingest.latest(spark, f"{path}/store").select("event_type", "starts", "n")
