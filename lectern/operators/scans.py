"""Scans over the library tables. Filters are plain predicates, so they reach the file scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.functions.text import first_filled, strip_tags, trim

CHILD_TYPES = ("note", "attachment")


def live(items: DataFrame, trash: DataFrame | None = None) -> DataFrame:
    """Items that aren't trashed: by their own flag, and by a table of trashed keys if there is one."""
    kept = items.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return kept if trash is None else kept.join(trash.select("key"), "key", "left_anti")


def library_items(items: DataFrame, trash: DataFrame | None = None, library_id: int | None = None) -> DataFrame:
    """Neither notes nor attachments (annotations do count), not trashed."""
    own = items if library_id is None else items.where(F.col("library_id") == library_id)
    return live(own.where(~F.col("item_type").isin(*CHILD_TYPES)), trash)


def trashed(items: DataFrame) -> DataFrame:
    """All trashed rows, notes and attachments too."""
    return items.where(F.coalesce(F.col("deleted"), F.lit(False)))


def top_level_collections(collections: DataFrame) -> DataFrame:
    return collections.where(F.col("parent_key").isNull())


def tag_list(items: DataFrame) -> DataFrame:
    """Distinct (tag, type) of items; a missing type is 0."""
    return items.select(F.explode("tags").alias("t")).select(F.col("t.tag").alias("tag"), F.coalesce("t.type", F.lit(0)).alias("type")).distinct()


def dictionary(table: DataFrame, name_col: str, wanted: str | None = None, of: str | None = None) -> DataFrame:
    """Rows of a dimension table, for one type if given; an unknown type is an error."""
    if wanted is None:
        return table
    own = table.where(F.col(of or name_col) == wanted)
    if own.isEmpty():
        raise InvalidParams(f"unknown type: {wanted}")
    return own


def fulltext(attachments: DataFrame, texts: DataFrame) -> DataFrame:
    """key, content, indexed_chars, total_chars of attachments; without a cached text "" and zeros."""
    return attachments.select("key").join(texts, "key", "left").select(
        "key", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("indexed_chars", F.lit(0)).alias("indexed_chars"), F.coalesce("total_chars", F.lit(0)).alias("total_chars")
    )


def item_texts(items: DataFrame, children: DataFrame, texts: DataFrame) -> DataFrame:
    """key, text: the first filled of a note tagged `ocr` (tags stripped) and the full text of an attachment."""
    ocr = F.exists(F.coalesce("tags", F.array().cast("array<struct<tag:string,type:int>>")), lambda t: t["tag"] == "ocr")
    notes = children.where((F.col("item_type") == "note") & ocr).groupBy("parent_key").agg(F.min_by(trim(strip_tags("note")), F.col("key")).alias("note_text"))
    own = children.where(F.col("item_type") == "attachment").join(texts.select("key", "content"), "key").where(trim(F.col("content")) != "")
    full = own.groupBy("parent_key").agg(F.min_by("content", "key").alias("full_text"))
    joined = items.select("key").join(notes, F.col("key") == notes.parent_key, "left").drop("parent_key").join(full, F.col("key") == full.parent_key, "left")
    return joined.select("key", first_filled("note_text", "full_text").alias("text"))


def with_suffix(names: Column, suffix: str) -> Column:
    return F.endswith(names, F.lit(suffix))


def first_per_group(df: DataFrame, group: str, order: list) -> DataFrame:
    """One row a group, the first in the order."""
    from pyspark.sql import Window

    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__rn = 1").drop("__rn")


def attachment_rows(attachments: DataFrame) -> DataFrame:
    """key, parent_key, title, content_type, link_mode, path: empty values are null."""
    return attachments.select("key", "parent_key", "title", F.nullif("content_type", F.lit("")).alias("content_type"), "link_mode", F.nullif("path", F.lit("")).alias("path"))


def annotation_rows(annotations: DataFrame) -> DataFrame:
    """key, parent_key, type, text, comment, color and position: missing texts are empty, the position is read as a variant (null without one)."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    position = F.when(F.coalesce("annotation_position", F.lit("")) != "", F.try_parse_json("annotation_position"))
    return annotations.select("key", "parent_key", "annotation_type", text("annotation_text"), text("annotation_comment"), text("annotation_color"), position.alias("annotation_position"))
