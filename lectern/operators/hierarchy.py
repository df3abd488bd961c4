"""The collection tree by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.stages import Stages


#: Levels between rows whose whole paths are written.
REACH = 128


def _above(rows: DataFrame, *more: str) -> DataFrame:
    """What a row hands on to those that point to it; paths are small as files and large in memory, so it is never broadcast."""
    return rows.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("sort_path").alias("keys"), *more).hint("merge")


def _joined(before: str, after: str) -> Column:
    return F.concat(before, F.lit("/"), after)


def tree(collections: DataFrame, most_deep: int | None = None, reach: int = REACH) -> DataFrame:
    """key, name, parent_key, depth, path (names), sort_path (keys): depth first by sort_path; an orphan is a root.

    Every row points to an ancestor; a round joins it with the row it points to, which doubles the distance, so a tree of depth d takes log2(d)
    rounds whatever its number of rows. Each round is written to the shared folder. The rounds find depths first. All paths together may be
    as long as rows times depth, so they aren't written: rows keep the way from the last row above whose depth is a multiple of reach, only those
    have whole paths, and both are put together as the result is read.
    Collections that are their own ancestors, and what hangs on them, point to no root however far: once a round settles no row they are all that
    is left, and they come out with depth and paths null. A tree deeper than most_deep, if that is given, is an error.
    """
    if reach < 2:
        raise InvalidParams("reach must be at least 2")
    space = Stages(collections.sparkSession, "tree")
    own = collections.select("key", "name", "parent_key")
    known = own.select(F.col("key").alias("up")).distinct().withColumn("known", F.lit(True))
    first = own.withColumn("up", F.col("parent_key")).join(known, "up", "left").withColumn("up", F.when(F.col("known"), F.col("up")))
    now = space.put(first.select("key", "name", "parent_key", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "round_0")
    open_rows, k = now.where("up IS NOT NULL").count(), 0
    while open_rows:
        k += 1
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = now.where("up IS NOT NULL").join(above, "up").select("key", "name", "parent_key", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        now = space.put(now.where("up IS NULL").unionByName(moved), f"round_{k}")
        before, open_rows = open_rows, now.where("up IS NOT NULL").count()
        if open_rows == before:
            break
    settled = now.where("up IS NULL").drop("up")
    deepest = settled.agg(F.max("depth")).first()[0] or 0
    if most_deep is not None and deepest > most_deep:
        raise InvalidParams(f"the tree is deeper than {most_deep}")
    short = settled.where(F.col("depth") % reach != 0).withColumns({"up": F.col("parent_key"), "up_depth": F.col("depth") - 1, "path": F.col("name"), "sort_path": F.col("key")})
    if deepest > 1:
        short = space.put(short, "short_0")
    k = 0
    while 1 << k < min(reach - 1, deepest):
        k += 1
        far = F.col("up_depth") % reach != 0
        moved = short.where(far).drop("up_depth").join(_above(short, "up_depth"), "up").select("key", "name", "parent_key", "depth", F.col("next").alias("up"), "up_depth", _joined("before", "path").alias("path"), _joined("keys", "sort_path").alias("sort_path"))
        short = space.put(short.where(~far).unionByName(moved), f"short_{k}")
    columns = ["key", "name", "parent_key", "depth", "up", "path", "sort_path"]
    roots = settled.where("depth = 0").select("key", "name", "parent_key", "depth", F.lit(None).cast("string").alias("up"), F.col("name").alias("path"), F.col("key").alias("sort_path"))
    parents = short.select(F.col("key").alias("parent_key"), "up", F.col("path").alias("before"), F.col("sort_path").alias("keys"))
    below = settled.where((F.col("depth") > 0) & (F.col("depth") % reach == 0)).join(parents.hint("merge"), "parent_key")
    below = below.select("key", "name", "parent_key", "depth", "up", _joined("before", "name").alias("path"), _joined("keys", "key").alias("sort_path"))
    whole = space.put(roots.unionByName(below), "whole_0") if deepest >= reach else roots
    k = 0
    while 1 << k <= deepest // reach:
        k += 1
        moved = whole.where("up IS NOT NULL").join(_above(whole), "up").select("key", "name", "parent_key", "depth", F.col("next").alias("up"), _joined("before", "path").alias("path"), _joined("keys", "sort_path").alias("sort_path"))
        whole = space.put(whole.where("up IS NULL").unionByName(moved), f"whole_{k}")
    rest = short.select(*columns).join(_above(whole), "up").select("key", "name", "parent_key", "depth", _joined("before", "path").alias("path"), _joined("keys", "sort_path").alias("sort_path"))
    none = F.lit(None).cast("string")
    lost = now.where("up IS NOT NULL").select("key", "name", "parent_key", F.lit(None).cast("int").alias("depth"), none.alias("path"), none.alias("sort_path"))
    return whole.drop("up").unionByName(rest).unionByName(lost)


def find_by_name(collections: DataFrame, name: str) -> DataFrame:
    """The first collection of that name, depth first."""
    return tree(collections).where(F.col("name") == name).orderBy("sort_path").limit(1)


def nested(rows: list, key: str = "key") -> list[dict]:
    """Collected tree rows (ordered by sort_path) as nested dicts with `children`."""
    made: dict = {r[key]: {"key": r[key], "name": r["name"], "children": []} for r in rows}
    roots = []
    for r in rows:
        (made[r["parent_key"]]["children"] if r["depth"] else roots).append(made[r[key]])
    return roots
