"""Set maintenance on tags, memberships, relations and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams


def one_per_key(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row of each key: the last in the order, by default of the rows as JSON, so that repeats are settled alike in each run."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.to_json(whole) if order is None else order).alias("__row"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`") for c in rows.columns])


def upsert(store: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """New rows replace stored ones with the same keys (of several new ones the last in the order); running it again changes nothing."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one_per_key(new, keys, order))


def clear_items(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("item_key").distinct(), "item_key", "left_anti")


def union_stores(stores: list[DataFrame]) -> DataFrame:
    """One store of several; different embedding models don't mix."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    models = [r["model"] for r in out.select("model").where("model IS NOT NULL").distinct().limit(2).collect()]
    if len(models) > 1:
        raise InvalidParams(f"stores of different models: {', '.join(sorted(models))}")
    return out


def add_tags(tags: Column, new: Column) -> Column:
    """tags with the names in new; a name that is there keeps its type, new ones have type 0."""
    names = F.transform(tags, lambda t: t["tag"])
    fresh = F.array_except(F.array_distinct(new), names)
    return F.concat(tags, F.transform(fresh, lambda n: F.struct(n.alias("tag"), F.lit(0).alias("type"))))


def remove_tags(tags: Column, old: Column) -> Column:
    return F.filter(tags, lambda t: ~F.array_contains(old, t["tag"]))


def _names_by_key(operations: DataFrame, column: str) -> DataFrame:
    """key and the different names of all its operations, by their place in the lists, then by name."""
    each = operations.select("key", F.posexplode(column).alias("__at", "__name")).groupBy("key", "__name").agg(F.min("__at").alias("__at"))
    ordered = F.array_sort(F.collect_list(F.struct("__at", "__name")))
    return each.groupBy("key").agg(F.transform(ordered, lambda x: x["__name"]).alias(column))


def batch_tags(items: DataFrame, operations: DataFrame) -> DataFrame:
    """items after operations (key, add, remove): removals, then additions; empty lists change nothing. Operations on one key count together."""
    joined = items.join(_names_by_key(operations, "add"), "key", "left").join(_names_by_key(operations, "remove"), "key", "left")
    none = F.array().cast("array<string>")
    tags = add_tags(remove_tags(F.col("tags"), F.coalesce("remove", none)), F.coalesce("add", none))
    return joined.withColumn("tags", tags).select(*items.columns)


def rename_tag(items: DataFrame, old: str, new: str) -> DataFrame:
    """Library-wide; where both names stand the first stays. A name that no item has changes nothing."""
    names = F.transform("tags", lambda t: F.when(t["tag"] == old, F.lit(new)).otherwise(t["tag"]))
    kinds = F.transform("tags", lambda t: t["type"])
    pairs = F.zip_with(names, kinds, lambda n, k: F.struct(n.alias("tag"), k.alias("type")))
    first = F.filter(pairs, lambda t, i: F.array_position(F.transform(pairs, lambda p: p["tag"]), t["tag"]) == i + 1)
    return items.withColumn("tags", F.when(F.exists("tags", lambda t: t["tag"] == old), first).otherwise(F.col("tags")))


def delete_tag(items: DataFrame, tag: str) -> DataFrame:
    if items.where(F.exists("tags", lambda t: t["tag"] == tag)).isEmpty():
        raise InvalidParams(f"no item has the tag {tag}")
    return items.withColumn("tags", F.filter("tags", lambda t: t["tag"] != tag))


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    return members.select("collection_key", "item_key").union(new.select("collection_key", "item_key")).distinct()


def remove_members(members: DataFrame, old: DataFrame) -> DataFrame:
    return members.join(old.select("collection_key", "item_key").distinct(), ["collection_key", "item_key"], "left_anti")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("key_a", "key_b").union(pairs.select("key_b", "key_a"))


def add_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Relations stay symmetric; a key isn't related to itself.

    New pairs lose their repeats before they are turned round, so that a task holds half of them.
    """
    own = relations.select("key_a", "key_b").where("key_a <> key_b").distinct()
    once = new.where("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
    return own.union(both_ways(once).join(own, ["key_a", "key_b"], "left_anti"))


def remove_relations(relations: DataFrame, old: DataFrame) -> DataFrame:
    # an anti join asks for a match only: repeats in old need no task to hold them
    return relations.join(both_ways(old), ["key_a", "key_b"], "left_anti")
