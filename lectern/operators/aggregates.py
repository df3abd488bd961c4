"""Counts, groups and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.scans import CHILD_TYPES, live


def collection_stats(collections: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """key, items, attachments, notes, subcollections: of live members and direct subcollections."""
    own = members.distinct().join(live(items).select(F.col("key").alias("item_key"), "item_type"), "item_key")
    counts = own.groupBy(F.col("collection_key").alias("key")).agg(
        F.count_if(~F.col("item_type").isin(*CHILD_TYPES)).alias("items"),
        F.count_if(F.col("item_type") == "attachment").alias("attachments"),
        F.count_if(F.col("item_type") == "note").alias("notes"),
    )
    subs = collections.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("subcollections"))
    joined = collections.select("key").join(counts, "key", "left").join(subs, "key", "left")
    return joined.select("key", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("items", "attachments", "notes", "subcollections")])


def library_stats(items: DataFrame, collections: DataFrame) -> DataFrame:
    """library_id, items (live, children too), collections."""
    a = live(items).groupBy("library_id").agg(F.count("*").alias("items"))
    b = collections.groupBy("library_id").agg(F.count("*").alias("collections"))
    both = a.join(b, "library_id", "full_outer")
    return both.select("library_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("collections", F.lit(0)).alias("collections"))


def collection_rows(collections: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """key, name, parent_key, child_keys (sorted), item_count (live members)."""
    subs = collections.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.sort_array(F.collect_list("key")).alias("child_keys"))
    own = members.distinct().join(live(items).select(F.col("key").alias("item_key")), "item_key", "left_semi")
    counts = own.groupBy(F.col("collection_key").alias("key")).agg(F.count("*").alias("item_count"))
    joined = collections.select("key", "name", "parent_key").join(subs, "key", "left").join(counts, "key", "left")
    return joined.withColumns({"child_keys": F.coalesce("child_keys", F.array().cast("array<string>")), "item_count": F.coalesce("item_count", F.lit(0).cast("long"))})


def index_status(chunks: DataFrame, exact: bool = True) -> DataFrame:
    """chunks and different items."""
    distinct = F.count_distinct("item_key") if exact else F.approx_count_distinct("item_key")
    return chunks.agg(F.count("*").alias("chunks"), distinct.alias("items"))


def ocr_status(items_with_ocr: DataFrame) -> DataFrame:
    """total, has_ocr, missing_ocr over all items."""
    return items_with_ocr.agg(F.count("*").alias("total"), F.count_if("has_ocr").alias("has_ocr"), F.count_if(~F.col("has_ocr")).alias("missing_ocr"))


def job_summary(results: DataFrame) -> DataFrame:
    """ok, skipped and chunks of rows (status, chunks)."""
    return results.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def duplicate_groups(items: DataFrame, key_expr) -> DataFrame:
    """group_key, keys (sorted), size: rows with the same filled key, two or more.

    key_expr gives the matching key. What comes from one key is transitive as it is; see duplicate_sets for several keys.
    """
    own = items.select(F.col("key"), key_expr.alias("group_key")).where(F.coalesce(F.col("group_key").cast("string"), F.lit("")) != "")
    return own.groupBy("group_key").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.count("*").alias("size")).where("size > 1")


def duplicate_members(items: DataFrame, key_expr) -> DataFrame:
    """group_key, key, head (the smallest key of the group), size: a row for each member of a group of two or more, of any size."""
    own = items.select(F.col("key"), key_expr.alias("group_key")).where(F.coalesce(F.col("group_key").cast("string"), F.lit("")) != "")
    groups = own.groupBy("group_key").agg(F.min("key").alias("head"), F.count("*").alias("size")).where("size > 1")
    return own.join(groups, "group_key").select("group_key", "key", "head", "size")


def duplicate_sets(items: DataFrame, key_exprs: list, put, most_rounds: int = 60) -> DataFrame:
    """key, head: transitive sets over several matching keys; head is the set's smallest key. Only sets of two or more.

    Items and key values form a graph; the smallest key spreads over it, and heads are shortened by following them. put(df, name)
    writes a frame and reads it back, which cuts lineage.
    """
    pairs = [items.select("key", F.concat(F.lit(f"{k}:"), e.cast("string")).alias("value")).where(e.isNotNull() & (e.cast("string") != "")) for k, e in enumerate(key_exprs)]
    edges = pairs[0]
    for p in pairs[1:]:
        edges = edges.unionByName(p)
    edges = put(edges.distinct(), "edges")
    heads = put(items.select("key", F.col("key").alias("head")), "heads_0")
    for k in range(1, most_rounds):
        of_value = edges.join(heads, "key").groupBy("value").agg(F.min("head").alias("h"))
        least = edges.join(of_value, "value").groupBy("key").agg(F.min("h").alias("h"))
        spread = put(heads.join(least, "key", "left").select("key", F.least("head", F.coalesce("h", "head")).alias("head")), f"spread_{k}")
        jump = spread.select(F.col("key").alias("head"), F.col("head").alias("h2"))
        after = put(spread.join(jump, "head").select("key", F.least("head", "h2").alias("head")), f"heads_{k}")
        if after.join(heads, ["key", "head"], "left_anti").isEmpty():
            sizes = after.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
            return after.join(sizes, "head", "left_semi").select("key", "head")
        heads = after
    raise RuntimeError("duplicate sets didn't settle")


def merge_duplicates(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Items with each set folded into its head: the head's fields win, missing ones are filled in key order; tags and collections are united.

    Each field, tag and collection of a set is folded by itself with partial sums, so a set may have any number of members.
    """
    filled = lambda fields: F.map_filter(fields, lambda k, v: v != "")
    names = lambda tags: F.transform(tags, lambda t: t["tag"])
    alone = items.join(sets.select("key"), "key", "left_anti").select(
        "key", "title", F.array_sort(F.array_distinct(names("tags"))).alias("tags"), F.array_sort(F.array_distinct("collections")).alias("collections"), filled("fields").alias("fields"), F.lit(1).cast("long").alias("merged")
    )
    own = items.join(sets.select("key", "head"), "key").withColumn("rank", F.struct(F.col("key") != F.col("head"), F.col("key")))
    heads = own.groupBy("head").agg(F.min_by("title", "rank").alias("title"), F.count("*").alias("merged"))
    values = own.select("head", "rank", F.explode(filled("fields")).alias("name", "value")).groupBy("head", "name").agg(F.min_by("value", "rank").alias("value"))
    fields = values.groupBy("head").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("fields"))
    united = lambda of, name: own.select("head", F.explode(of).alias("x")).groupBy("head").agg(F.array_sort(F.collect_set("x")).alias(name))
    joined = heads.join(united(names("tags"), "tags"), "head", "left").join(united(F.col("collections"), "collections"), "head", "left").join(fields, "head", "left")
    none = F.array().cast("array<string>")
    merged = joined.select(
        F.col("head").alias("key"), "title", F.coalesce("tags", none).alias("tags"), F.coalesce("collections", none).alias("collections"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), "merged"
    )
    return alone.unionByName(merged)


def batch_tag_totals(operations: DataFrame) -> DataFrame:
    """added and removed as operations, not effects. operations: add, remove (arrays)."""
    return operations.agg(F.coalesce(F.sum(F.size("add")), F.lit(0)).alias("added"), F.coalesce(F.sum(F.size("remove")), F.lit(0)).alias("removed"))


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    """embedding_artifacts and whether there is one. artifacts: title."""
    n = F.count_if(F.endswith("title", F.lit(".embeddings.npz")))
    return artifacts.agg(n.alias("embedding_artifacts"), (n > 0).alias("available"))
