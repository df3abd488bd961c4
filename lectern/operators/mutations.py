"""Mutations as functions from state and change to new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, NotFound
from lectern.functions.names import auto_split_creator
from lectern.operators.filters import annotation_error, is_pdf
from lectern.operators.lookups import find_duplicates_of
from lectern.operators.setops import add_members, one_per_key


def check_keys(items: DataFrame, keys: DataFrame) -> None:
    missing = keys.select("key").join(items.select("key"), "key", "left_anti").orderBy("key").first()
    if missing:
        raise NotFound(f"item not found: {missing['key']}")


def create_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """items and new; Chinese creators given as one name are split."""
    if "creators" in new.columns:
        new = new.withColumn("creators", F.transform("creators", auto_split_creator))
    return items.unionByName(new, allowMissingColumns=True)


def update_items(items: DataFrame, changes: DataFrame, order: Column | None = None) -> DataFrame:
    """changes: key, fields, and optionally title, creators, tags. Fields patch (an empty value clears), creators replace, tags replace unless empty.

    Of several changes of a key the last in the order counts.
    """
    names = [c for c in ("title", "creators", "tags") if c in changes.columns]
    change = one_per_key(changes, ["key"], order).select("key", F.col("fields").alias("__fields"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = items.join(change, "key", "left")
    old = F.map_filter("fields", lambda k, v: ~F.coalesce(F.map_contains_key("__fields", k), F.lit(False)))
    out = {"fields": F.when(F.col("__fields").isNull(), F.col("fields")).otherwise(F.map_concat(old, F.map_filter("__fields", lambda k, v: v != "")))}
    for c in names:
        new = F.col(f"__{c}")
        out[c] = F.when(new.isNotNull() & (F.size(new) > 0 if c == "tags" else F.lit(True)), new).otherwise(F.col(c))
    return joined.withColumns(out).select(*items.columns)


def delete_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    return items.join(keys.select("key").distinct(), "key", "left_anti")


def set_deleted(items: DataFrame, keys: DataFrame, deleted: bool) -> DataFrame:
    """Trash or restore; nothing happens if a key is unknown but an error."""
    check_keys(items, keys)
    marked = items.join(keys.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")
    return marked.withColumn("deleted", F.when(F.col("__hit"), F.lit(deleted)).otherwise(F.col("deleted"))).select(*items.columns)


def plan_push(new: DataFrame, items: DataFrame, on_duplicate: str = "skip", attachments: DataFrame | None = None, put=lambda df, name: df) -> DataFrame:
    """new (ref, doi, title, ...) with dup_key, status (created, updated, skipped_duplicate), key and attach_pdf.

    attach_pdf: a file was given (has_file) and the item it goes to has no PDF yet; updates leave files alone. put: see
    find_duplicates_of.
    """
    if on_duplicate not in ("skip", "update", "create"):
        raise InvalidParams(f"unknown choice for duplicates: {on_duplicate}")
    found = find_duplicates_of(new, items, put=put)
    if on_duplicate == "create":
        found = found.withColumn("dup_key", F.lit(None).cast("string"))
    status = F.when(F.col("dup_key").isNull(), "created").otherwise("updated" if on_duplicate == "update" else "skipped_duplicate")
    out = found.withColumns({"status": status, "key": F.coalesce("dup_key", F.concat(F.lit("new-"), F.col("ref").cast("string")))})
    if "has_file" not in new.columns:
        return out
    if attachments is None:
        return out.withColumn("attach_pdf", F.col("has_file"))
    pdfs = attachments.where(is_pdf(F.col("content_type"), F.col("path"))).select(F.col("parent_key").alias("key")).distinct().withColumn("__pdf", F.lit(True))
    return out.join(pdfs, "key", "left").withColumn("attach_pdf", F.col("has_file") & F.col("__pdf").isNull() & (F.col("status") != "updated")).drop("__pdf")


def push_items(items: DataFrame, members: DataFrame, new: DataFrame, on_duplicate: str = "skip", collection_key: str | None = None, put=lambda df, name: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, memberships, results) after pushing new (ref, doi, title, fields, ...). Empty fields aren't pushed; a skipped item is still put into the collection."""
    filled = new.withColumn("fields", F.map_filter("fields", lambda k, v: v.isNotNull() & (v != "")))
    plan = plan_push(filled, items, on_duplicate, put=put)
    fresh = plan.where("status = 'created'").select("key", "title", "fields", F.lit("journalArticle").alias("item_type"), F.lit(False).alias("deleted"))
    after = create_items(items, fresh)
    if on_duplicate == "update":
        changes = plan.where("status = 'updated'").groupBy("key").agg(F.min_by("fields", "ref").alias("fields"))
        after = update_items(after, changes)
    if collection_key:
        members = add_members(members, plan.select(F.lit(collection_key).alias("collection_key"), F.col("key").alias("item_key")))
    return after, members, plan.select("ref", "status", "key")


def create_collection(collections: DataFrame, key: str, name: str, parent_key: str | None = None, library_id: int = 1) -> DataFrame:
    new = collections.sparkSession.createDataFrame([(key, 1, name, parent_key, library_id)], "key string, version int, name string, parent_key string, library_id int")
    return collections.unionByName(new, allowMissingColumns=True)


def rename_collection(collections: DataFrame, key: str, name: str) -> DataFrame:
    return collections.withColumn("name", F.when(F.col("key") == key, F.lit(name)).otherwise(F.col("name")))


def move_collection(collections: DataFrame, key: str, parent_key: str | None) -> DataFrame:
    """None moves to the top."""
    return collections.withColumn("parent_key", F.when(F.col("key") == key, F.lit(parent_key).cast("string")).otherwise(F.col("parent_key")))


def delete_collection(collections: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Without the collection; its items stay in the library."""
    return collections.where(F.col("key") != key), members.where(F.col("collection_key") != key)


def update_note(items: DataFrame, key: str, html: str) -> DataFrame:
    return items.withColumn("note", F.when((F.col("key") == key) & (F.col("item_type") == "note"), F.lit(html)).otherwise(F.col("note")))


def create_annotations(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """Valid new annotations are added; the first invalid one is an error."""
    checked = new.withColumn("__error", annotation_error(F.col("annotation_type"), F.col("annotation_text"), F.col("annotation_color")))
    bad = checked.where("__error IS NOT NULL").orderBy("key").first()
    if bad:
        raise InvalidParams(bad["__error"])
    return annotations.unionByName(new, allowMissingColumns=True)


def replace_artifacts(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """New artifacts take the place of those with the same parent and title."""
    return artifacts.join(new.select("parent_key", "title").distinct(), ["parent_key", "title"], "left_anti").unionByName(new)


def pending(items: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Items that a batch job still has to do."""
    return items if force else items.join(done.select("key").distinct(), "key", "left_anti")
