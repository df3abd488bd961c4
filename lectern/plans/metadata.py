"""Scans, predicates, lookups, pages and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import aggregates, filters, lookups, paging, scans
from lectern.operators.ranks import positions
from lectern.plans.bind import COLLECTIONS, ITEMS, MEMBERS, collections, item_key, items, members, table, texts, with_ctes
from lectern.plans.query import registrar
from lectern.stages import Stages

QUERIES, query = registrar()


@query("S1 O1 J14 J15", with_ctes("SELECT key, title, CAST(date_added AS VARCHAR) AS date_added FROM items WHERE item_type NOT IN ('note', 'attachment') AND NOT deleted ORDER BY items.date_added DESC, key LIMIT 50 OFFSET 10", ITEMS))
def items_list_page(spark, sf):
    return paging.list_items(scans.library_items(items(spark, sf)), limit=50, offset=10).df.select("key", "title", F.col("date_added").cast("string").alias("date_added"))


@query("O1", with_ctes("SELECT key, CAST(date_modified AS VARCHAR) AS date_modified FROM items WHERE item_type NOT IN ('note', 'attachment') AND NOT deleted ORDER BY items.date_modified, key LIMIT 40", ITEMS))
def items_list_modified_asc(spark, sf):
    return paging.list_items(scans.library_items(items(spark, sf)), "dateModified", "asc", 40).df.select("key", F.col("date_modified").cast("string").alias("date_modified"))


@query("O2 R4", "SELECT o_orderkey AS key, CAST(o_orderdate AS VARCHAR) AS date_added FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def items_recent(spark, sf):
    recent = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("date_added"))
    return paging.recent_items(recent, limit=20).df.select("key", F.col("date_added").cast("string").alias("date_added"))


@query("S2 O5", with_ctes("SELECT key, item_type FROM items WHERE deleted ORDER BY key LIMIT 30 OFFSET 5", ITEMS))
def trash_page(spark, sf):
    return paging.page(scans.trashed(items(spark, sf)), ["key"], 30, 5).df.select("key", "item_type")


@query("S3", with_ctes("SELECT key, name FROM collections WHERE parent_key IS NULL", COLLECTIONS))
def collections_top(spark, sf):
    return scans.top_level_collections(collections(spark, sf)).select("key", "name")


@query("S5 O5", "SELECT DISTINCT tag, type FROM (SELECT lang AS tag, 0 AS type FROM documents UNION ALL SELECT source, 1 FROM documents) ORDER BY tag, type LIMIT 15 OFFSET 2")
def tags_page(spark, sf):
    return paging.page(scans.tag_list(items(spark, sf)), ["tag", "type"], 15, 2).df


@query("S8", with_ctes("SELECT key, CASE WHEN doc_id % 20 = 1 THEN length(text) ELSE 0 END AS total_chars, length(CASE WHEN doc_id % 20 = 1 THEN text ELSE '' END) AS n FROM items WHERE item_type = 'attachment'", ITEMS))
def attachment_fulltext(spark, sf):
    own = items(spark, sf).where("item_type = 'attachment'")
    return scans.fulltext(own, texts(spark, sf)).select("key", "total_chars", F.length("content").alias("n"))


@query("S18", with_ctes("SELECT p.key, coalesce(min(length(a.text)), -1) AS n FROM items p LEFT JOIN items a ON a.parent_key = p.key AND a.item_type = 'attachment' AND a.doc_id % 20 = 1 WHERE p.item_type NOT IN ('note', 'attachment') GROUP BY p.key", ITEMS))
def item_text_source(spark, sf):
    own = items(spark, sf)
    found = scans.item_texts(own.where(~F.col("item_type").isin("note", "attachment")), own, texts(spark, sf))
    return found.select("key", F.coalesce(F.length("text"), F.lit(-1)).alias("n"))


@query("F1 F7", with_ctes("SELECT key FROM items WHERE parent_key IS NULL AND item_type = 'book' AND lower(title) LIKE '%the%' AND date > '2000'", ITEMS))
def advanced_and(spark, sf):
    wanted = [{"field": "itemType", "op": "is", "value": "book"}, {"field": "title", "op": "contains", "value": "The"}, {"field": "date", "operator": "isAfter", "value": "2000"}]
    return filters.advanced(items(spark, sf), wanted).select("key")


@query("F1", with_ctes("SELECT key FROM items WHERE parent_key IS NULL AND (lang = 'es' OR doi = '10.1000/8' OR NOT (lower(title) LIKE '%e%'))", ITEMS))
def advanced_or(spark, sf):
    wanted = [{"field": "tag", "op": "is", "value": "es"}, {"field": "DOI", "op": "is", "value": "10.1000/8"}, {"field": "title", "op": "doesNotContain", "value": "e"}]
    return filters.advanced(items(spark, sf), wanted, "or").select("key")


@query("F2 HS1 O3", with_ctes("SELECT key FROM items WHERE parent_key IS NULL AND (lower(title) LIKE '%an%' OR lower(author) LIKE '%an%' OR CAST(year AS VARCHAR) LIKE '%an%') ORDER BY key LIMIT 25", ITEMS))
def quick_search(spark, sf):
    return paging.page(filters.quick_search(items(spark, sf), "an"), ["key"], 25).df.select("key")


@query("F3", with_ctes("SELECT key FROM items i WHERE key IN (SELECT parent_key FROM items WHERE item_type = 'attachment' AND doc_id % 20 = 1 AND lower(text) LIKE '%tion%')", ITEMS))
def fulltext_search(spark, sf):
    return filters.fulltext_search(items(spark, sf), texts(spark, sf), "tion").select("key")


@query("F4", with_ctes("SELECT key FROM items WHERE source = 'src3' OR lang = 'src3' ORDER BY key LIMIT 50", ITEMS))
def by_tag(spark, sf):
    return paging.page(filters.by_tag(items(spark, sf), "src3"), ["key"], 50).df.select("key")


@query("F5", with_ctes("SELECT key FROM items WHERE parent_key IS NULL AND doi = '10.1000/12'", ITEMS))
def by_identifier(spark, sf):
    return filters.by_identifier(items(spark, sf), doi="10.1000/12").select("key")


@query("F6", with_ctes("SELECT key FROM items WHERE item_type = 'note' AND lower(note) LIKE '%tion%' ORDER BY key LIMIT 25", ITEMS))
def note_search(spark, sf):
    return paging.page(filters.note_search(items(spark, sf), "tion"), ["key"], 25).df.select("key")


@query("F8", with_ctes("SELECT item_type, count(*) AS n FROM items GROUP BY item_type", ITEMS))
def item_kinds(spark, sf):
    return items(spark, sf).groupBy("item_type").agg(F.count("*").alias("n"))


@query("F10", with_ctes("SELECT p.key, coalesce(bool_or(a.path LIKE '%.pdf' OR a.content_type = 'application/pdf'), false) AS has_pdf FROM items p LEFT JOIN items a ON a.parent_key = p.key AND a.item_type = 'attachment' WHERE p.parent_key IS NULL GROUP BY p.key", ITEMS))
def has_pdf(spark, sf):
    own = items(spark, sf)
    return filters.has_pdf(own.where("parent_key IS NULL"), own.where("item_type = 'attachment'")).select("key", "has_pdf")


@query("F11 A6", with_ctes("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 20 = 3) AS has_ocr, count(*) FILTER (WHERE doc_id % 20 <> 3) AS missing_ocr FROM items WHERE parent_key IS NULL", ITEMS))
def ocr_status(spark, sf):
    own = items(spark, sf)
    done = own.where("doc_id % 20 = 3").select(F.col("key").alias("item_key"))
    return aggregates.ocr_status(filters.with_ocr(own.where("parent_key IS NULL"), own, done))


@query("F14", "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 >= 5 THEN 'unknown annotation type: ' || CASE c_custkey % 7 WHEN 5 THEN 'star' ELSE 'null' END WHEN c_custkey % 2 = 0 AND c_custkey % 7 >= 2 THEN 'no text on annotations of type ' || CASE c_custkey % 7 WHEN 2 THEN 'note' WHEN 3 THEN 'image' ELSE 'ink' END WHEN c_custkey % 3 = 0 THEN 'color isn''t #RRGGBB: red' END AS error FROM customer")
def annotation_errors(spark, sf):
    c = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("highlight", "underline", "note", "image", "ink", "star", None)])
    error = filters.annotation_error(F.get(kinds, (c % 7).cast("int")), F.when(c % 2 == 0, "t").otherwise(""), F.when(c % 3 == 0, "red").otherwise("#A0b1C2"))
    return table(spark, sf, "customer").select(c.alias("k"), error.alias("error"))


@query("J3", "SELECT pos, 'I' || lpad(CAST((pos * 37) % 50 AS VARCHAR), 8, '0') AS key, d.lang FROM range(0, 40) AS r(pos) JOIN documents d ON d.doc_id = (pos * 37) % 50")
def key_lookup_ordered(spark, sf):
    wanted = spark.range(40).select(F.col("id").alias("pos"), item_key((F.col("id") * 37) % 50).alias("key"))
    return lookups.in_order(wanted, items(spark, sf)).select("pos", "key", "lang")


@query("J4 HS3", with_ctes("SELECT c.parent_key, c.key, c.item_type FROM items c JOIN items p ON p.key = c.parent_key WHERE NOT c.deleted AND p.lang = 'fr'", ITEMS))
def item_children(spark, sf):
    own = items(spark, sf)
    return lookups.children(own.where("lang = 'fr'"), own).select("parent_key", "key", "item_type")


@query("J5 O4", with_ctes("SELECT i.key, i.item_type FROM items i JOIN members m ON m.item_key = i.key WHERE m.collection_key = 'N7' AND NOT i.deleted", ITEMS, MEMBERS))
def collection_items(spark, sf):
    return lookups.collection_items(members(spark, sf), items(spark, sf), "N7").select("key", "item_type")


@query("J5", with_ctes("SELECT key, name FROM collections WHERE parent_key = 'R2'", COLLECTIONS))
def subcollections(spark, sf):
    return lookups.subcollections(collections(spark, sf), "R2").select("key", "name")


_WANTED = ["NATION_3", "nation_2", "  ASIA ", "none such", "A", "FRANCE", "ia"]
_EXACT = "(SELECT count(*) FROM collections c WHERE c.name = r.ref)"
_FUZZY = "contains(lower(trim(c.name)), lower(trim(r.ref)))"


@query("J6 F12 X12", with_ctes(
    f"SELECT ref, CASE n WHEN 1 THEN 'hit' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN k END AS key, n AS candidates FROM (SELECT r.ref, count(c.key) AS n, min(c.key) AS k FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in _WANTED)}) r(ref) LEFT JOIN collections c ON CASE WHEN {_EXACT.replace('collections c WHERE c.name', 'collections e WHERE e.name')} = 1 THEN c.name = r.ref ELSE {_FUZZY} END GROUP BY r.ref)",
    COLLECTIONS,
))
def resolve_collection(spark, sf):
    wanted = spark.createDataFrame([(w,) for w in _WANTED], "ref string")
    return lookups.resolve_collections(wanted, collections(spark, sf))


@query("J8", with_ctes("SELECT DISTINCT i.key FROM items i JOIN members m ON m.item_key = i.key JOIN nation n ON m.collection_key = 'N' || CAST(n.n_nationkey AS VARCHAR) WHERE n.n_name = 'NATION_4' AND i.item_type NOT IN ('note', 'attachment') AND NOT i.deleted", ITEMS, MEMBERS))
def search_scope(spark, sf):
    return lookups.scope_items(items(spark, sf), members(spark, sf), collections(spark, sf), collection="NATION_4").select("key")


@query("J9 W7", with_ctes("SELECT p.key, a.key AS attachment_key, coalesce(CASE WHEN a.doc_id % 20 = 1 THEN length(a.text) END, 0) AS total_chars FROM items p LEFT JOIN items a ON a.parent_key = p.key AND a.item_type = 'attachment' AND (a.path LIKE '%.pdf' OR a.content_type = 'application/pdf') WHERE p.parent_key IS NULL", ITEMS))
def first_pdf_text(spark, sf):
    own = items(spark, sf)
    found = lookups.first_pdf_text(own.where("parent_key IS NULL"), own.where("item_type = 'attachment'"), texts(spark, sf).drop("parent_key"))
    return found.select("key", "attachment_key", "total_chars")


@query("J10 M7 HS8", "SELECT DISTINCT p_partkey AS key, p_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey = 0")
def related_items(spark, sf):
    li = table(spark, sf, "lineitem")
    relations = li.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("key_a"), F.col("l_partkey").alias("key_b"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name")
    return lookups.related(parts, relations, "O0")


@query("J11", "SELECT item_key, ordinal, length(t) AS n, vec_id FROM (SELECT source AS item_key, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, text AS t FROM documents) a JOIN (SELECT 'src' || CAST(label AS VARCHAR) AS item_key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal, vec_id FROM embeddings) b USING (item_key, ordinal)")
def positional_zip(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("item_key"), "doc_id", F.length("text").alias("n"))
    vecs = table(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("item_key"), "vec_id")
    docs, vecs = positions(docs, ["item_key"], ["doc_id"], "ordinal").drop("doc_id"), positions(vecs, ["item_key"], ["vec_id"], "ordinal")
    return lookups.zip_chunks(docs, vecs)


@query("J16 F13", with_ctes("SELECT r.doc_id AS ref, coalesce(doi_key, title_key) AS dup_key FROM items r LEFT JOIN by_doi USING (doi) LEFT JOIN by_title USING (title)", ITEMS, "by_doi AS (SELECT doi, min(key) AS doi_key FROM items WHERE doi <> '' GROUP BY doi)", "by_title AS (SELECT title, min(key) AS title_key FROM items WHERE length(title) >= 10 GROUP BY title)"))
def dup_lookup(spark, sf):
    own = items(spark, sf)
    new = own.select(F.col("doc_id").alias("ref"), F.col("fields")["DOI"].alias("doi"), "title")
    return lookups.find_duplicates_of(new, own, put=Stages(spark, "duplicates").put).select("ref", "dup_key")


@query("J18 P14 P1", with_ctes("SELECT i.key, coalesce(string_agg(m.collection_key, ',' ORDER BY m.collection_key), '') AS collection_keys FROM items i LEFT JOIN members m ON m.item_key = i.key GROUP BY i.key", ITEMS, MEMBERS))
def item_collections(spark, sf):
    found = lookups.collection_keys(items(spark, sf), members(spark, sf), collections(spark, sf))
    return found.select("key", F.array_join("collection_keys", ",").alias("collection_keys"))


@query("A1 HS3", with_ctes("SELECT c.key, coalesce(x.items, 0) AS items, coalesce(x.attachments, 0) AS attachments, coalesce(x.notes, 0) AS notes, (SELECT count(*) FROM collections s WHERE s.parent_key = c.key) AS subcollections FROM collections c LEFT JOIN (SELECT collection_key, count(*) FILTER (WHERE item_type NOT IN ('note', 'attachment')) AS items, count(*) FILTER (WHERE item_type = 'attachment') AS attachments, count(*) FILTER (WHERE item_type = 'note') AS notes FROM members m JOIN items i ON i.key = m.item_key WHERE NOT i.deleted GROUP BY 1) x ON x.collection_key = c.key", ITEMS, MEMBERS, COLLECTIONS))
def collection_stats(spark, sf):
    return aggregates.collection_stats(collections(spark, sf), members(spark, sf), items(spark, sf))


@query("A2 S4 HS11", with_ctes("SELECT 1 AS library_id, (SELECT count(*) FROM items WHERE NOT deleted) AS items, (SELECT count(*) FROM collections) AS collections", ITEMS, COLLECTIONS))
def library_stats(spark, sf):
    return aggregates.library_stats(items(spark, sf), collections(spark, sf))


@query("A4 P2", with_ctes("SELECT c.key, c.name, c.parent_key, coalesce((SELECT string_agg(s.key, ',' ORDER BY s.key) FROM collections s WHERE s.parent_key = c.key), '') AS child_keys, (SELECT count(*) FROM members m JOIN items i ON i.key = m.item_key WHERE m.collection_key = c.key AND NOT i.deleted) AS item_count FROM collections c", ITEMS, MEMBERS, COLLECTIONS))
def collection_rows(spark, sf):
    found = aggregates.collection_rows(collections(spark, sf), members(spark, sf), items(spark, sf))
    return found.withColumn("child_keys", F.array_join("child_keys", ","))


@query("A5", "SELECT count(*) AS chunks, count(DISTINCT source) AS items FROM documents")
def index_status(spark, sf):
    return aggregates.index_status(table(spark, sf, "documents").withColumnRenamed("source", "item_key"))


@query("A7", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'O') AS skipped, CAST(sum(o_custkey) AS BIGINT) AS chunks FROM orders")
def job_summary(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skipped").otherwise("error")
    return aggregates.job_summary(table(spark, sf, "orders").select(status.alias("status"), F.col("o_custkey").alias("chunks")))


@query("A8 U8 T12", "SELECT md5(text) AS group_key, string_agg('I' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), ',' ORDER BY doc_id) AS keys, count(*) AS size FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return aggregates.duplicate_groups(items(spark, sf), F.md5("text")).withColumn("keys", F.array_join("keys", ","))


@query("A10", "SELECT CAST(sum(1 + doc_id % 3) AS BIGINT) AS added, CAST(sum(doc_id % 2) AS BIGINT) AS removed FROM documents")
def tag_totals(spark, sf):
    ops = table(spark, sf, "documents").select(F.array_repeat(F.lit("x"), (1 + F.col("doc_id") % 3).cast("int")).alias("add"), F.array_repeat(F.lit("y"), (F.col("doc_id") % 2).cast("int")).alias("remove"))
    return aggregates.batch_tag_totals(ops)
