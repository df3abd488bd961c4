"""Streams over several files and runs: the state they leave equals that of all rows at once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.hashes import text_sha256
from lectern.streaming import ingest

SCHEMA = "source string, chunk_id string, text string, n int"


@pytest.fixture
def files(tmp_path):
    """put(k): another file of rows; all rows so far."""
    r, rows = random.Random(4), []
    (tmp_path / "in").mkdir()

    def put(k):
        own = [{"source": f"s{r.randint(0, 3)}", "chunk_id": f"c{r.randint(0, 40)}", "text": f"text {r.randint(0, 5)}", "n": k * 1000 + j} for j in range(60)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, own)))
        rows.extend(own)
        return rows

    return put


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def test_refresh_by_title(spark, tmp_path, files):
    files(0)
    for k in (1, 2):
        rows = files(k)
        own = stream(spark, tmp_path).select(F.col("source").alias("parent_key"), F.col("chunk_id").alias("title"), "n", "text")
        ingest.refresh_batches(own, f"{tmp_path}/store", f"{tmp_path}/check", F.col("n"), buckets=3).awaitTermination()
        want = {(x["source"], x["chunk_id"]): (x["n"], x["text"]) for x in rows}
        assert {(x.parent_key, x.title): (x.n, x.text) for x in ingest.latest(spark, f"{tmp_path}/store").collect()} == want


def test_feed(spark, tmp_path, files):
    for k in range(4):
        rows = files(k)
        ingest.feed_batches(stream(spark, tmp_path), f"{tmp_path}/store", f"{tmp_path}/check", "source", [F.desc("n")], 7, buckets=2).awaitTermination()
        want = sorted(x["n"] for s in {x["source"] for x in rows} for x in [x for x in rows if x["source"] == s][-7:])
        assert sorted(x.n for x in ingest.latest(spark, f"{tmp_path}/store").collect()) == want


def test_stale_chunks_are_recomputed(spark, tmp_path, files):
    rows = files(0)
    first = {x["chunk_id"]: x["text"] for x in rows[:20]}
    stored = spark.createDataFrame(list(first.items()), "chunk_id string, text string").select("chunk_id", text_sha256(F.col("text")).alias("text_sha256"))
    own = stream(spark, tmp_path).select("chunk_id", "text")
    ingest.recompute_batches(own, stored, f"{tmp_path}/store", f"{tmp_path}/check", dim=8, buckets=4).awaitTermination()
    got = {x.chunk_id: x for x in ingest.latest(spark, f"{tmp_path}/store").collect()}
    stale = {x["chunk_id"] for x in rows if first.get(x["chunk_id"]) != x["text"]}
    assert set(got) == stale and all(len(x.vector) == 8 and x.model == "hashing-8" for x in got.values())
    again = {x.chunk_id: x.text for x in got.values()}
    assert all(any(x["text"] == again[c] and x["chunk_id"] == c for x in rows) for c in again)
    # a second run has nothing to do
    ingest.recompute_batches(own, stored, f"{tmp_path}/store", f"{tmp_path}/check", dim=8, buckets=4).awaitTermination()
    assert {x.chunk_id for x in ingest.latest(spark, f"{tmp_path}/store").collect()} == stale


def test_event_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    times = [f"2024-01-{d:02d}T0{h}:00:00" for d in range(1, 6) for h in range(8)]
    for k in range(5):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"ts": t, "event_type": "ab"[j % 2], "value": 1.5}) for j, t in enumerate(times[k * 8 : k * 8 + 8])))
        # files come in the order of their times
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    counts = ingest.event_counts(events, "1 day", "2 hours").select("event_type", F.col("window.start").alias("start"), "n", "total")
    ingest.upsert_batches(counts, f"{tmp_path}/store", f"{tmp_path}/check", ["event_type", "start"], buckets=2, order=F.col("n"), mode="update").awaitTermination()
    got = {(x.event_type, x.start.day): (x.n, x.total) for x in ingest.latest(spark, f"{tmp_path}/store").collect()}
    assert got == {(t, d): (4, 6.0) for t in "ab" for d in range(1, 6)}
