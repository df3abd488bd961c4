"""Vector stores: chunk rows with their vectors, saved, loaded, and built from the artifacts of items.

A store's own form is Parquet, partitioned by collection, so that a search reads the columns and collections it needs. The
interchange form is one JSON document for each collection, or several where it is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, StaleArtifact
from lectern.functions.text import first_filled, none_if_empty
from lectern.operators.lookups import check_zip
from lectern.operators.ranks import positions
from lectern.operators.retrieval import stale_items
from lectern.operators.setops import union_stores

ROW = "item_key string, title string, authors string, section string, chunk_index int, text string, vector array<float>"
DOCUMENT = f"collection string, collection_id string, model string, chunks array<struct<{ROW}>>"
#: What an item hands on to its chunks; a chunk's own value wins.
PROVENANCE = ("attachment_id", "attachment_key", "doi", "venue", "year", "uri")


def save_store(store: DataFrame, path: str) -> None:
    """store: ROW with collection, collection_id and model."""
    store.write.partitionBy("collection").mode("overwrite").parquet(path)


def load_store(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """The store, or one collection of it: other collections' folders aren't read."""
    own = spark.read.parquet(path).withColumn("collection", F.col("collection").cast("string"))
    return own if collection is None else own.where(F.col("collection") == collection)


#: Chunks of a document in the interchange form.
CHUNKS_PER_DOCUMENT = 10_000


def store_documents(store: DataFrame, most: int = CHUNKS_PER_DOCUMENT) -> DataFrame:
    """collection, part, document: the interchange form, chunks by item and index.

    A collection of more than `most` chunks has several documents, numbered from 0, each of the same form.
    """
    names = [f.split()[0] for f in ROW.split(", ")]
    group = ["collection", "collection_id", "model"]
    placed = positions(store.select(*group, *names), group, ["item_key", "chunk_index", "text"], "place").withColumn("part", F.floor(F.col("place") / most))
    chunks = F.array_sort(F.collect_list(F.struct(*names)))
    own = placed.groupBy(*group, "part").agg(chunks.alias("chunks"))
    return own.select("collection", "part", F.to_json(F.struct(*group, "chunks")).alias("document"))


def export_store(store: DataFrame, path: str, most: int = CHUNKS_PER_DOCUMENT) -> None:
    """One JSON document a line."""
    store_documents(store, most).select("document").write.mode("overwrite").text(path)


def import_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON documents: one a line, or a file that holds a single one over many lines."""
    lines = spark.read.schema(DOCUMENT).option("multiLine", str(path.endswith(".json")).lower()).option("mode", "FAILFAST").json(path)
    return lines.select("collection", "collection_id", "model", F.explode("chunks").alias("c")).select("collection", "collection_id", "model", "c.*")


def artifact_store(chunks: DataFrame, vectors: DataFrame, items: DataFrame) -> DataFrame:
    """A store from chunks (item_key, ordinal, chunk_id, text, ...), vectors as read from NPZ files, and items' metadata.

    Items whose counts differ, whose embeddings are stale, or that mix models are errors. A chunk's own title, authors,
    section and provenance win over its item's; chunk_index defaults to the place.
    """
    bad = check_zip(chunks, vectors).orderBy("item_key").first()
    if bad:
        raise InvalidParams(f"{bad['item_key']}: {bad['n_chunks']} chunks, {bad['n_vectors']} vectors")
    stale = stale_items(vectors, chunks).where("stale").orderBy("item_key").first()
    if stale:
        raise StaleArtifact(f"embeddings of {stale['item_key']} don't fit its chunks")
    meta = items.select("item_key", *[F.col(c).alias(f"__{c}") for c in ("title", "authors", *PROVENANCE) if c in items.columns])
    joined = chunks.join(vectors.select("item_key", "ordinal", "vector", "model"), ["item_key", "ordinal"]).join(meta, "item_key", "left")

    def both(name: str):
        own = none_if_empty(F.col(name).cast("string")) if name in chunks.columns else F.lit(None).cast("string")
        return F.coalesce(own, F.col(f"__{name}").cast("string")) if f"__{name}" in joined.columns else own

    section = first_filled(*[c for c in ("section_heading", "section") if c in chunks.columns], F.lit(""))
    index = F.coalesce("chunk_index", "ordinal") if "chunk_index" in chunks.columns else F.col("ordinal")
    return joined.select(
        "item_key", F.coalesce(both("title"), F.lit("")).alias("title"), F.coalesce(both("authors"), F.lit("")).alias("authors"), F.coalesce(section, F.lit("")).alias("section"),
        index.cast("int").alias("chunk_index"), "text", "vector", "model", "chunk_id", *[both(c).alias(c) for c in PROVENANCE],
    )


def united(stores: list[DataFrame]) -> DataFrame:
    """One store of several; different models don't mix."""
    return union_stores(stores)
