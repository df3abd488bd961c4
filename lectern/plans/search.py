"""Searches by an index of character runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import normalized_name
from lectern.operators import aggregates, filters, lookups, scans
from lectern.operators.seekpages import SeekTable
from lectern.operators.textindex import NgramIndex
from lectern.plans.bind import ITEMS, items, table, texts, with_ctes
from lectern.plans.query import registrar

QUERIES, query = registrar()


@query("F3", with_ctes("SELECT key FROM items i WHERE key IN (SELECT parent_key FROM items WHERE item_type = 'attachment' AND doc_id % 20 = 1 AND lower(text) LIKE '%ation%')", ITEMS))
def fulltext_indexed(spark, sf):
    found = texts(spark, sf)
    index = NgramIndex.build(spark, found.select("key", F.lower("content").alias("value")))
    return filters.fulltext_search(items(spark, sf), found, "Ation", index).select("key")


@query("F2 HS1", with_ctes(" UNION ALL ".join(f"SELECT '{q}' AS query, key FROM items WHERE parent_key IS NULL AND (lower(title) LIKE '%{q.lower()}%' OR lower(author) LIKE '%{q.lower()}%' OR CAST(year AS VARCHAR) LIKE '%{q}%')" for q in ("an", "S", "199", "on the")), ITEMS))
def quick_indexed(spark, sf):
    own = items(spark, sf)
    index = NgramIndex.build(spark, filters.quick_values(own))
    found = [filters.quick_search(own, q, index).select(F.lit(q).alias("query"), "key") for q in ("an", "S", "199", "on the")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("F6", with_ctes("SELECT key FROM items WHERE item_type = 'note' AND lower(note) LIKE '%ción%'", ITEMS))
def notes_indexed(spark, sf):
    own = items(spark, sf)
    index = NgramIndex.build(spark, own.where("item_type = 'note'").select("key", F.lower("note").alias("value")))
    return filters.note_search(own, "Ción", index).select("key")


_TIDY = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_RESOLVED = f"""asked AS (SELECT DISTINCT substr(title, 1, 5) AS ref FROM items),
exact AS (SELECT ref, min(key) AS k FROM asked JOIN items ON title = ref GROUP BY ref HAVING count(*) = 1),
fuzzy AS (SELECT ref, count(key) AS n, min(key) AS k FROM asked LEFT JOIN items ON contains({_TIDY.format("title")}, {_TIDY.format("ref")}) WHERE ref NOT IN (SELECT ref FROM exact) GROUP BY ref)"""


@query("J6 F12 X12", with_ctes("SELECT ref, 'hit' AS status, k AS key, 1 AS candidates FROM exact UNION ALL SELECT ref, CASE n WHEN 1 THEN 'hit' WHEN 0 THEN 'missing' ELSE 'ambiguous' END, CASE n WHEN 1 THEN k END, n FROM fuzzy", ITEMS, _RESOLVED))
def resolve_indexed(spark, sf):
    own = items(spark, sf).select("key", F.col("title").alias("name"))
    index = NgramIndex.build(spark, own.select("key", normalized_name(F.col("name")).alias("value")))
    return lookups.resolve_collections(own.select(F.substring("name", 1, 5).alias("ref")), own, index)


@query("F3 X1", "WITH terms AS (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS term FROM documents UNION SELECT DISTINCT lang FROM documents) SELECT term, count(doc_id) AS n, CAST(coalesce(sum(doc_id), 0) AS BIGINT) AS ids FROM terms LEFT JOIN documents ON contains(lower(text), term) GROUP BY term")
def term_matches(spark, sf):
    docs = table(spark, sf, "documents")
    index = NgramIndex.build(spark, docs.select(F.col("doc_id").cast("string").alias("key"), F.lower("text").alias("value")))
    terms = docs.select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("term")).union(docs.select("lang")).distinct()
    found = index.matches(terms).groupBy("term").agg(F.count("key").alias("n"), F.sum(F.col("key").cast("long")).alias("ids"))
    # a null term is found nowhere
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit(0)).alias("ids"))


def _slices(seek, name):
    """The first page, one in the middle and the last one."""
    total = seek.total
    found = [seek.page(20, offset).withColumn(name, F.lit(offset).cast("long")) for offset in (0, total // 2, max(0, total - 7))]
    return found[0].unionByName(found[1]).unionByName(found[2])


_PLACED = "offsets AS (SELECT unnest([0, n // 2, greatest(0, n - 7)]) AS first FROM (SELECT count(*) AS n FROM placed))"


@query("O1 O2 S1 S20", with_ctes("SELECT key, CAST(date_added AS VARCHAR) AS date_added, first FROM placed JOIN offsets ON r >= first AND r < first + 20", ITEMS, "placed AS (SELECT key, date_added, row_number() OVER (ORDER BY date_added DESC, key) - 1 AS r FROM items WHERE item_type NOT IN ('note', 'attachment') AND NOT deleted)", _PLACED))
def deep_pages(spark, sf):
    own = scans.library_items(items(spark, sf)).select("key", "date_added")
    seek = SeekTable(own, [F.desc("date_added"), F.asc("key")])
    return _slices(seek, "first").select("key", F.col("date_added").cast("string").alias("date_added"), "first")


@query("O4 O5 S2", with_ctes("SELECT key, first FROM placed JOIN offsets ON r >= first AND r < first + 20", ITEMS, "placed AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM items WHERE deleted)", _PLACED))
def trash_pages(spark, sf):
    return _slices(SeekTable(scans.trashed(items(spark, sf)).select("key"), [F.asc("key")]), "first")


@query("A8 T12 U8", with_ctes("SELECT doi AS group_key, key, min(key) OVER (PARTITION BY doi) AS head, count(*) OVER (PARTITION BY doi) AS size FROM items WHERE doi <> '' QUALIFY size > 1", ITEMS))
def duplicate_members(spark, sf):
    return aggregates.duplicate_members(items(spark, sf), F.col("fields")["DOI"])
