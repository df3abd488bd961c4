"""Mutations and set maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.embed import with_vectors
from lectern.operators import mutations, setops
from lectern.plans.bind import COLLECTIONS, ITEMS, MEMBERS, collections, items, members, table, with_ctes
from lectern.plans.query import registrar
from lectern.stages import Stages

QUERIES, query = registrar()

_KEY = lambda: F.col("key")


@query("M2 M6", with_ctes("SELECT key, CASE WHEN doc_id % 7 = 0 THEN '10.9/x' ELSE doi END AS doi, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE title END AS title, source AS venue, CASE WHEN doc_id % 14 = 0 THEN 'neu' ELSE lang END AS tag FROM items", ITEMS))
def apply_update(spark, sf):
    own = items(spark, sf)
    tag = F.when(F.col("doc_id") % 14 == 0, F.array(F.struct(F.lit("neu").alias("tag"), F.lit(0).alias("type")))).otherwise(F.array().cast("array<struct<tag:string,type:int>>"))
    changes = own.where("doc_id % 7 = 0").select("key", F.create_map(F.lit("DOI"), F.lit("10.9/x")).alias("fields"), F.lit("new").alias("title"), tag.alias("tags"))
    after = mutations.update_items(own, changes)
    return after.select("key", F.col("fields")["DOI"].alias("doi"), "title", F.col("fields")["publicationTitle"].alias("venue"), F.get("tags", F.lit(0))["tag"].alias("tag"))


@query("M3 U2", with_ctes("SELECT key FROM items WHERE doc_id % 6 <> 1", ITEMS))
def delete_items(spark, sf):
    own = items(spark, sf)
    return mutations.delete_items(own, own.where("doc_id % 6 = 1")).select("key")


@query("M4", with_ctes("SELECT key, CASE WHEN doc_id % 9 = 0 THEN false WHEN doc_id % 9 = 1 THEN true ELSE deleted END AS deleted FROM items", ITEMS))
def trash_restore(spark, sf):
    own = items(spark, sf)
    after = mutations.set_deleted(own, own.where("doc_id % 9 = 1"), True)
    return mutations.set_deleted(after, own.where("doc_id % 9 = 0").select("key"), False).select("key", "deleted")


def _new(spark, sf):
    """Every item but notes and attachments pushed again: with its DOI, its title, or neither."""
    own = items(spark, sf).where("item_type NOT IN ('note', 'attachment')")
    kind = F.col("doc_id") % 3
    return own.select(F.col("doc_id").alias("ref"), F.when(kind == 0, F.col("fields")["DOI"]).otherwise("").alias("doi"), F.when(kind == 2, F.concat(F.lit("brand new "), F.col("doc_id").cast("string"))).otherwise(F.col("title")).alias("title"), F.create_map(F.lit("DOI"), F.lit(""), F.lit("abstractNote"), F.lit("pushed")).alias("fields"), (F.col("doc_id") % 2 == 0).alias("has_file"))


_PLAN = """new AS (SELECT doc_id AS ref, CASE WHEN doc_id % 3 = 0 THEN doi ELSE '' END AS doi, CASE WHEN doc_id % 3 = 2 THEN 'brand new ' || CAST(doc_id AS VARCHAR) ELSE title END AS title FROM items WHERE item_type NOT IN ('note', 'attachment')),
by_doi AS (SELECT doi, min(key) AS doi_key FROM items WHERE doi <> '' GROUP BY doi), by_title AS (SELECT title, min(key) AS title_key FROM items WHERE length(title) >= 10 GROUP BY title),
found AS (SELECT n.ref, coalesce(doi_key, title_key) AS dup_key FROM new n LEFT JOIN by_doi USING (doi) LEFT JOIN by_title USING (title))"""


@query("M5 J16", with_ctes("SELECT ref, CASE WHEN dup_key IS NULL THEN 'created' ELSE 'skipped_duplicate' END AS status, coalesce(dup_key, 'new-' || CAST(ref AS VARCHAR)) AS key, ref % 2 = 0 AND NOT EXISTS (SELECT 1 FROM items a WHERE a.parent_key = coalesce(dup_key, 'none') AND (a.path LIKE '%.pdf' OR a.content_type = 'application/pdf')) AS attach_pdf FROM found", ITEMS, _PLAN))
def upsert_skip(spark, sf):
    own = items(spark, sf)
    return mutations.plan_push(_new(spark, sf), own, "skip", own.where("item_type = 'attachment'"), Stages(spark, "push").put).select("ref", "status", "key", "attach_pdf")


@query("M5", with_ctes("SELECT i.key, i.doi, EXISTS (SELECT 1 FROM found f WHERE f.dup_key = i.key) AS touched FROM items i UNION ALL SELECT 'new-' || CAST(ref AS VARCHAR), '', true FROM found WHERE dup_key IS NULL", ITEMS, _PLAN))
def upsert_update(spark, sf):
    after, _, _ = mutations.push_items(items(spark, sf), members(spark, sf), _new(spark, sf), "update", put=Stages(spark, "push").put)
    return after.select("key", F.coalesce(F.col("fields")["DOI"], F.lit("")).alias("doi"), F.coalesce(F.col("fields")["abstractNote"] == "pushed", F.lit(False)).alias("touched"))


@query("M5", with_ctes("SELECT ref, 'created' AS status, 'new-' || CAST(ref AS VARCHAR) AS key FROM found", ITEMS, _PLAN))
def upsert_create(spark, sf):
    return mutations.push_items(items(spark, sf), members(spark, sf), _new(spark, sf), "create", put=Stages(spark, "push").put)[2]


@query("U4 M11", with_ctes("SELECT key, CASE WHEN doc_id % 4 = 0 THEN source || ',hot' WHEN doc_id % 4 = 1 THEN lang || ',' || source ELSE lang || ',' || source END AS tags FROM items", ITEMS))
def tags_batch(spark, sf):
    own = items(spark, sf)
    d = F.col("doc_id")
    ops = own.where("doc_id % 4 < 2").select("key", F.when(d % 4 == 0, F.array(F.lit("hot"), F.lit("hot"))).otherwise(F.array("lang")).alias("add"), F.when(d % 4 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("remove"))
    return setops.batch_tags(own, ops).select("key", F.array_join(F.transform("tags", lambda t: t["tag"]), ",").alias("tags"))


@query("M11 HS9", with_ctes("SELECT key, CASE WHEN source = 'src1' THEN lang || ',' || 'en' WHEN true THEN lang || ',' || source END AS tags FROM items WHERE NOT (source = 'src1' AND lang = 'en') UNION ALL SELECT key, 'en' FROM items WHERE source = 'src1' AND lang = 'en'", ITEMS))
def rename_tag(spark, sf):
    after = setops.rename_tag(items(spark, sf), "src1", "en")
    return after.select("key", F.array_join(F.transform("tags", lambda t: t["tag"]), ",").alias("tags"))


@query("M11", with_ctes("SELECT key, CASE WHEN lang = 'de' THEN 1 ELSE 2 END AS n FROM items", ITEMS))
def delete_tag(spark, sf):
    return setops.delete_tag(items(spark, sf), "de").select("key", F.size("tags").alias("n"))


@query("M9", with_ctes("SELECT key, CASE key WHEN 'N3' THEN 'R0' WHEN 'N4' THEN NULL ELSE parent_key END AS parent_key, CASE key WHEN 'N5' THEN 'renamed' ELSE name END AS name FROM collections WHERE key <> 'N6' UNION ALL SELECT 'N99', 'R1', 'fresh'", COLLECTIONS))
def move_collection(spark, sf):
    own = mutations.move_collection(mutations.move_collection(collections(spark, sf), "N3", "R0"), "N4", None)
    own = mutations.create_collection(mutations.rename_collection(own, "N5", "renamed"), "N99", "fresh", "R1")
    return mutations.delete_collection(own, members(spark, sf), "N6")[0].select("key", "parent_key", "name")


@query("U5 M10", with_ctes("SELECT collection_key, item_key FROM members WHERE collection_key NOT IN ('N2') UNION SELECT 'N1', item_key FROM members WHERE collection_key = 'N0'", MEMBERS))
def member_changes(spark, sf):
    own = members(spark, sf)
    more = setops.add_members(own, own.where("collection_key = 'N0'").select(F.lit("N1").alias("collection_key"), "item_key"))
    return setops.remove_members(more, own.where("collection_key = 'N2'"))


@query("M7", "WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem) SELECT DISTINCT a AS key_a, b AS key_b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b AND a % 5 <> b % 5")
def relation_changes(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key_a"), F.col("l_partkey").alias("key_b"))
    none = pairs.limit(0)
    return setops.remove_relations(setops.add_relations(none, pairs), pairs.where("key_a % 5 = key_b % 5"))


@query("U1 R1 D8", "SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE lang END AS v FROM documents")
def reindex_upsert(spark, sf):
    store = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    new = store.where("k % 3 = 0").withColumn("v", F.lit("again"))
    return setops.upsert(setops.upsert(store, new, ["k"]), new, ["k"])


@query("M1 X9", with_ctes("SELECT key, author AS name FROM items UNION ALL SELECT 'X1', '李明'", ITEMS))
def create_items(spark, sf):
    from lectern.functions.names import creator_name
    from lectern.schemas import CREATOR

    new = spark.createDataFrame([("X1", [("", "李明", None, None)])], f"key string, creators array<{CREATOR}>")
    return mutations.create_items(items(spark, sf), new).select("key", creator_name(F.get("creators", F.lit(0))).alias("name"))


@query("K12 R2", "SELECT c_custkey AS key, 'K' || CAST(c_nationkey AS VARCHAR) AS parent_key, c_mktsegment AS title FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'K' || CAST(c_nationkey AS VARCHAR), c_mktsegment FROM customer c WHERE c_custkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM customer n WHERE n.c_custkey % 10 = 0 AND n.c_nationkey = c.c_nationkey AND n.c_mktsegment = c.c_mktsegment)")
def replace_artifacts(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("K"), F.col("c_nationkey").cast("string")).alias("parent_key"), F.col("c_mktsegment").alias("title"))
    return mutations.replace_artifacts(rows.where("key % 10 <> 0"), rows.where("key % 10 = 0")).select("key", "parent_key", "title")


@query("M16 M17", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_items(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("key"))
    return mutations.pending(own, table(spark, sf, "labels").select(F.col("doc_id").alias("key"))).select("doc_id")


@query("V5", """WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
cells AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 48 AS cell, sum(CASE WHEN CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) >= 2147483648 THEN 1 ELSE -1 END * (1 + ln(n))) AS x FROM c GROUP BY ALL)
SELECT d.doc_id, 'hashing-48' AS model, CAST(48 AS INTEGER) AS dim, CAST(round(100 * coalesce(sum(abs(x)) / sqrt(nullif(sum(x * x), 0)), 0)) AS BIGINT) AS spread FROM documents d LEFT JOIN cells c ON c.doc_id = d.doc_id GROUP BY d.doc_id""")
def embed_chunks(spark, sf):
    """Model, dimension and the sum of the weights' sizes."""
    own = with_vectors(table(spark, sf, "documents").select("doc_id", "text"), dim=48, dtype="float64")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    return own.select("doc_id", "model", F.size("vector").alias("dim"), F.round(100 * total).cast("long").alias("spread"))
