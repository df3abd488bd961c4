"""The collection tree and duplicate sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import aggregates, hierarchy
from lectern.plans.bind import COLLECTIONS, ITEMS, collections, items, table, with_ctes
from lectern.plans.query import registrar

QUERIES, query = registrar()


@query("T9 S3", with_ctes("SELECT key, 0 AS depth, name AS path FROM collections WHERE parent_key IS NULL UNION ALL SELECT c.key, 1, p.name || '/' || c.name FROM collections c JOIN collections p ON c.parent_key = p.key", COLLECTIONS))
def collection_tree(spark, sf):
    return hierarchy.tree(collections(spark, sf)).select("key", "depth", "path")


_PARENT = "CASE WHEN doc_id % 50 > 0 THEN doc_id - 1 WHEN doc_id > 0 THEN doc_id - 50 END"


@query("T9", f"WITH RECURSIVE own AS (SELECT doc_id, {_PARENT} AS parent, source FROM documents), walk AS (SELECT doc_id, 0 AS depth, source AS path, CAST(doc_id AS VARCHAR) AS keys FROM own WHERE parent IS NULL UNION ALL SELECT o.doc_id, w.depth + 1, w.path || '/' || o.source, w.keys || '/' || CAST(o.doc_id AS VARCHAR) FROM own o JOIN walk w ON o.parent = w.doc_id) SELECT CAST(doc_id AS VARCHAR) AS key, depth, md5(path) AS path, md5(keys) AS keys FROM walk")
def deep_tree(spark, sf):
    own = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("name"), F.expr(_PARENT).cast("string").alias("parent_key"))
    return hierarchy.tree(own).select("key", "depth", F.md5("path").alias("path"), F.md5("sort_path").alias("keys"))


@query("T10 J7", with_ctes("SELECT key, name FROM collections WHERE name = 'NATION_9'", COLLECTIONS))
def tree_find(spark, sf):
    return hierarchy.find_by_name(collections(spark, sf), "NATION_9").select("key", "name")


_SETS = """RECURSIVE own AS (SELECT key, doi, title FROM items WHERE item_type NOT IN ('note', 'attachment')),
edges AS (SELECT a.key AS a, b.key AS b FROM own a JOIN own b ON a.doi = b.doi AND a.doi <> '' UNION SELECT a.key, b.key FROM own a JOIN own b ON a.title = b.title AND a.title <> ''),
reach AS (SELECT key AS a, key AS b FROM own UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
heads AS (SELECT a AS key, min(b) AS head FROM reach GROUP BY a)"""


def _sets(spark, sf):
    from lectern.stages import Stages

    own = items(spark, sf).where(~F.col("item_type").isin("note", "attachment"))
    return own, aggregates.duplicate_sets(own, [F.col("fields")["DOI"], F.col("title")], Stages(spark, "dups").put)


@query("A8 HS6", "WITH " + _SETS.replace("RECURSIVE ", "RECURSIVE " + ITEMS + ", ") + " SELECT key, head FROM heads WHERE head IN (SELECT head FROM heads GROUP BY head HAVING count(*) > 1)")
def duplicate_sets(spark, sf):
    return _sets(spark, sf)[1]


@query("A13 M8 HS7", "WITH " + _SETS.replace("RECURSIVE ", "RECURSIVE " + ITEMS + ", ") + """ SELECT h.head AS key, count(*) AS merged,
  (SELECT title FROM items x WHERE x.key = h.head) AS title, coalesce(min_by(i.doi, i.key) FILTER (WHERE i.doi <> ''), '') AS doi, string_agg(DISTINCT i.lang, ',' ORDER BY i.lang) AS langs
  FROM heads h JOIN items i ON i.key = h.key GROUP BY h.head""")
def merge_duplicates(spark, sf):
    own, sets = _sets(spark, sf)
    merged = aggregates.merge_duplicates(own, sets)
    langs = F.array_join(F.filter("tags", lambda t: ~F.startswith(t, F.lit("src"))), ",")
    return merged.select("key", "merged", "title", F.coalesce(F.col("fields")["DOI"], F.lit("")).alias("doi"), langs.alias("langs"))
