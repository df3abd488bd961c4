"""Lexical and vector retrieval, hits, citations, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, StaleArtifact
from lectern.functions.names import creator_name
from lectern.functions.text import authors_list, item_uri, lexical_score, none_if_empty, venue_of, year_of


def capped(scored: DataFrame, group: str, order: list[Column], per_group: int, limit: int) -> DataFrame:
    """The best per_group rows of each group, then the best limit rows of all. The order must be total.

    Spark keeps per_group rows of a group before the shuffle (window group limit) and takes the limit by partial top lists.
    """
    if per_group < 1 or limit < 1:
        raise InvalidParams("caps must be at least 1")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return scored.withColumn("__rank", rank).where(F.col("__rank") <= per_group).drop("__rank").orderBy(*order).limit(limit)


def lexical_hits(chunks: DataFrame, query: str, per_item: int = 3, limit: int = 50, icu: bool = True) -> DataFrame:
    """chunks (item_key, chunk_id, text, ...) with score, best first; ties by chunk id in ICU order (or binary order)."""
    scored = chunks.withColumn("score", lexical_score(F.col("text"), F.lit(query))).where("score > 0")
    tie = F.collate("chunk_id", "UNICODE") if icu else F.col("chunk_id")
    return capped(scored, "item_key", [F.desc("score"), tie, F.col("chunk_id")], max(1, per_item), max(1, limit))


def vector_hits(vectors: DataFrame, query: list[float], k: int = 10, per_item: int | None = None) -> DataFrame:
    """vectors (item_key, chunk_id, vector) with score = cosine to the query, the best k. Zero rows score 0, a zero query is an error."""
    size = sum(x * x for x in query) ** 0.5
    if not size:
        raise InvalidParams("a zero vector has no direction")
    unit = F.array(*[F.lit(float(x) / size) for x in query])
    checked = F.when(F.size("vector") == len(query), F.col("vector")).otherwise(F.raise_error(F.lit("vectors of another dimension")).cast("array<float>"))
    pair = F.aggregate(
        F.zip_with(checked, unit, lambda a, b: F.struct((a.cast("double") * b).alias("d"), (a.cast("double") * a.cast("double")).alias("n"))),
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n")),
        lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["n"] + x["n"]).alias("n")),
        lambda s: F.when(s["n"] > 0, s["d"] / F.sqrt(s["n"])).otherwise(F.lit(0.0)),
    )
    scored = vectors.withColumn("score", pair)
    order = [F.desc("score"), F.col("chunk_id")]
    return scored.orderBy(*order).limit(k) if per_item is None else capped(scored, "item_key", order, per_item, k)


def hits(rows: DataFrame, items: DataFrame, query: str) -> DataFrame:
    """Retrieval hits: the chunk's own values first, then the item's, then defaults; empty values are null."""
    names = F.transform("creators", creator_name)
    meta = items.select(F.col("key").alias("item_key"), F.col("title").alias("__title"), names.alias("__authors"), year_of(F.col("fields")["date"]).alias("__year"), venue_of(F.col("fields")).alias("__venue"), none_if_empty(F.col("fields")["DOI"]).alias("__doi"))
    own = lambda c, other: F.coalesce(none_if_empty(F.col(c)), other) if c in rows.columns else other
    return rows.join(meta, "item_key", "left").select(
        "item_key",
        own("title", F.col("__title")).alias("title"),
        "text",
        F.col("__authors").alias("authors"),
        F.col("__year").alias("year"),
        F.col("__venue").alias("venue"),
        F.col("__doi").alias("doi"),
        item_uri(F.col("item_key")).alias("uri"),
        own("section_heading", F.lit("")).alias("section_heading"),
        F.coalesce("chunk_id", F.concat(F.col("item_key"), F.lit(":c0"))).alias("chunk_id"),
        F.lit(query).alias("query"),
        "score",
    )


def rows_to_hits(rows: DataFrame, query: str) -> DataFrame:
    """Hits of store rows whose authors are a list or a semicolon-separated string; venue and doi may stay empty strings."""
    kind = rows.schema["authors"].dataType.simpleString()
    authors = F.col("authors") if kind.startswith("array") else authors_list(F.col("authors"))
    default = F.when(F.col("chunk_index").isNotNull(), F.concat(F.col("item_key"), F.lit(":c"), F.col("chunk_index").cast("string")))
    filled = F.when(F.size(authors) > 0, authors)
    return rows.select("item_key", "title", "text", filled.alias("authors"), "year", "venue", "doi", item_uri(F.col("item_key")).alias("uri"), none_if_empty(F.col("section")).alias("section_heading"), F.coalesce(none_if_empty(F.col("chunk_id")), default).alias("chunk_id"), F.lit(query).alias("query"), "score")


def citations(rows: DataFrame) -> DataFrame:
    return rows.select("item_key", "attachment_id", "title", "authors", "section", "chunk_index", "text", "score")


def citation_markdown(c: DataFrame) -> DataFrame:
    """c with markdown: title, authors, key, section and score, then the text as a quotation."""
    return c.withColumn("markdown", F.format_string("**%s** — %s [item:%s] (section: %s, score: %.2f)\n\n> %s\n", "title", "authors", "item_key", "section", F.col("score").cast("double"), "text"))


def citation_json(c: DataFrame) -> DataFrame:
    names = {"item_key": "itemKey", "attachment_id": "attachmentId", "title": "title", "authors": "authors", "section": "section", "chunk_index": "chunkIndex", "text": "text", "score": "score"}
    return c.withColumn("json", F.to_json(F.struct(*[F.col(a).alias(b) for a, b in names.items()], item_uri(F.col("item_key")).alias("uri")), {"ignoreNullFields": "false"}))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """chunks without their text, with its digest."""
    return chunks.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def merge_artifact_rows(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows joined by (item_key, ordinal); the chunk's values win; chunk_id and chunk_index have defaults."""
    shared = [c for c in chunks.columns if c in meta.columns and c not in ("item_key", "ordinal")]
    m = meta.select("item_key", "ordinal", *[F.col(c).alias(f"__m_{c}") for c in meta.columns if c not in ("item_key", "ordinal")])
    joined = chunks.join(m, ["item_key", "ordinal"])
    values = {c: F.coalesce(F.col(c), F.col(f"__m_{c}")) if c in shared else F.col(c) if c in chunks.columns else F.col(f"__m_{c}") for c in dict.fromkeys([*chunks.columns, *meta.columns])}
    values["chunk_id"] = F.coalesce(values.get("chunk_id", F.lit(None)), F.concat(F.col("item_key"), F.lit(":c"), F.col("ordinal").cast("string")))
    values["chunk_index"] = F.coalesce(values.get("chunk_index", F.lit(None).cast("int")), F.col("ordinal"))
    return joined.select(*[v.alias(c) for c, v in values.items()])


def stale_items(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_key, stale: stored metadata (ordinal, chunk_id, text_sha256) against the chunks' present text, place by place."""
    now = chunks.select("item_key", "ordinal", F.col("chunk_id").alias("now_id"), F.sha2("text", 256).alias("now_sha"))
    both = meta.select("item_key", "ordinal", "chunk_id", "text_sha256").join(now, ["item_key", "ordinal"], "full_outer")
    differs = ~F.col("chunk_id").eqNullSafe(F.col("now_id")) | (F.col("text_sha256").isNotNull() & ~F.col("text_sha256").eqNullSafe(F.col("now_sha")))
    return both.groupBy("item_key").agg(F.bool_or(differs).alias("stale"))


def require_fresh(meta: DataFrame, chunks: DataFrame) -> None:
    bad = stale_items(meta, chunks).where("stale").orderBy("item_key").first()
    if bad:
        raise StaleArtifact(f"embeddings of {bad['item_key']} don't fit its chunks")
