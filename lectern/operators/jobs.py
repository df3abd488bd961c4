"""Batch jobs end to end: indexing texts into a store, and turning recognised text into blocks and chunks.

A job takes state and returns new state with a report of one row an item. Items that are done are left out unless asked for
again, so a job that broke off is simply run again; an item's error is its status and doesn't stop the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.embed import with_vectors
from lectern.functions.hashes import text_sha256
from lectern.functions.text import author_line, trim
from lectern.operators.blocks import block_rows, block_sizes, cut_blocks, gather_chunks, with_blocks
from lectern.operators.chunks import chunk_documents
from lectern.operators.lookups import first_pdf
from lectern.operators.mutations import pending
from lectern.operators.setops import clear_items
from lectern.sources.providers import recognised
from lectern.stages import Stages

REPORT = ["item_key", "status", "chunks"]


def index_job(items: DataFrame, texts: DataFrame, store: DataFrame | None = None, provider: str = "hashing", size: int = 512, overlap: int = 64, rebuild: bool = False, put=lambda df, name: df, done: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(store, report) after indexing items (key, title, creators) with texts (key, text).

    Items with rows in the store are skipped unless rebuild is set, which first clears the rows of all items asked for; items
    without text are skipped too, so after a rebuild they have no rows. Text of headings alone gives no rows: done (key), the items that a report
    lists as ok, keeps such items from being read again. put(df, name) writes a frame and reads it back: chunks are embedded once.
    """
    stored = store.select(F.col("item_key").alias("key")).distinct() if store is not None else items.select("key").limit(0)
    known = stored if done is None else stored.union(done.select("key"))
    todo = pending(items.select("key", "title", "creators"), known, rebuild).join(texts.select("key", "text"), "key", "left")
    filled = todo.where(trim(F.coalesce("text", F.lit(""))) != "")
    own = filled.select(F.col("key").alias("item_key"), "title", author_line(F.col("creators")).alias("authors"), "text")
    chunks = chunk_documents(own, size, overlap).withColumn("text_sha256", text_sha256(F.col("text")))
    rows = put(with_vectors(chunks, provider, **options), "indexed")
    counts = rows.groupBy("item_key").agg(F.count("*").alias("chunks"))
    report = items.select(F.col("key").alias("item_key")).join(filled.select(F.col("key").alias("item_key"), F.lit(True).alias("__filled")), "item_key", "left").join(counts, "item_key", "left")
    report = report.select("item_key", F.when(F.col("__filled"), "ok").otherwise("skipped").alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    if store is None:
        return rows, report
    kept = clear_items(store, items.select(F.col("key").alias("item_key"))) if rebuild else store
    return kept.unionByName(rows, allowMissingColumns=True), report


def ocr_job(items: DataFrame, attachments: DataFrame, payloads: DataFrame, done: DataFrame, force: bool = False, max_chars: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, chunks, report) for items (key) whose first PDF attachment has a provider's response.

    payloads: attachment_key, provider, payload, error. done: key of items with a result. status: ok, skipped, or error with
    its reason. Every response is read once, and its blocks are written to the shared folder in one row; what finds the items and cuts the chunks
    does without texts, which only move for who asks for blocks or chunks.
    """
    space = Stages(items.sparkSession, "ocr")
    own = payloads.select("attachment_key", "provider", "payload", "error").withColumn("content", recognised(F.col("provider"), F.col("payload"))["content"])
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error")))
        .when(F.col("payload").isNull(), "error: no response")
        # what has no structure is read as the markdown that the provider's reader finds
        .when(F.col("content").isNull() & ~F.col("structured"), F.concat(F.lit("error: unreadable response of "), F.coalesce("provider", F.lit("no provider"))))
    )
    found = with_blocks(own, F.col("content"))
    read = space.put(found.select(F.monotonically_increasing_id().alias("__read"), "attachment_key", "provider", reason.alias("reason"), F.when(reason.isNull(), F.col("blocks")).alias("blocks")), "read")
    pdfs = first_pdf(attachments).select(F.col("parent_key").alias("key"), F.col("key").alias("attachment_key"))
    todo = pending(items.select("key"), done, force).join(pdfs, "key", "left").join(read.select("attachment_key", "__read", "reason"), "attachment_key", "left")
    reason = F.when(F.col("attachment_key").isNull(), "error: no PDF attachment found").when(F.col("__read").isNull(), "error: no response").otherwise(F.col("reason"))
    state = space.put(todo.select(F.monotonically_increasing_id().alias("__row"), F.col("key").alias("item_key"), "__read", reason.alias("reason")), "state")
    whole = block_rows(read.where("reason IS NULL").select("__read", "attachment_key", "provider", "blocks"), "__read")
    asked = state.where("reason IS NULL").select("__row", "__read", "item_key")
    # sizes are taken before the join, which no text passes
    cut = cut_blocks(block_sizes(whole, "__read").join(asked, "__read"), max_chars)
    chunks = gather_chunks(whole, cut, ["__read", "reading_order"])
    counts = cut.where("first").groupBy("item_key").agg(F.count("*").alias("chunks"))
    status = state.select("item_key", F.coalesce("reason", F.lit("ok")).alias("status"))
    report = items.select(F.col("key").alias("item_key")).join(status, "item_key", "left").join(counts, "item_key", "left")
    columns = ["item_key" if c == "__read" else c for c in whole.columns]
    return whole.join(asked, "__read").select(*columns), chunks, report.select("item_key", F.coalesce("status", F.lit("skipped")).alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
