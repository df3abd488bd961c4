"""References, guards, settings of many owners, stores and pages put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, InvalidRequest, MethodNotFound
from lectern.operators import exports, lookups, setops
from lectern.operators.seekpages import SeekTable
from lectern.plans.bind import COLLECTIONS, ITEMS, collections, items, table, with_ctes
from lectern.plans.query import registrar
from lectern.sources import config

QUERIES, query = registrar()


@query("J2", with_ctes("SELECT pos, ref, key, name FROM (VALUES (0, 'N7'), (1, '3'), (2, 'R1'), (3, '3'), (4, '24')) t(pos, ref) JOIN (SELECT *, CASE WHEN key LIKE 'N%' THEN substr(key, 2) END AS id FROM collections) c ON c.key = ref OR c.id = ref", COLLECTIONS))
def collection_refs(spark, sf):
    """Collections by key or by number, in the order asked for."""
    own = collections(spark, sf).select("key", "name", F.when(F.startswith("key", F.lit("N")), F.substring("key", 2, 9).cast("long")).alias("id"))
    return lookups.require_id(spark, own, ["N7", "3", "R1", "3", "24"], "collection").select("pos", "ref", "key", "name")


@query("F18", with_ctes("SELECT key, key || ' isn''t of type note' AS error FROM items WHERE item_type <> 'note'", ITEMS))
def kind_guard(spark, sf):
    return lookups.kind_errors(items(spark, sf), "note")


@query("U3", "SELECT 'L' || CAST(label AS VARCHAR) AS item_key, CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 3 = 1 THEN 'doi' || CAST(vec_id AS VARCHAR) END AS doi, CASE WHEN vec_id % 3 = 2 THEN 2000 + vec_id % 20 END AS year FROM embeddings")
def united_stores(spark, sf):
    """Three stores of one model, two with a column that the others lack."""
    own = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), "label").alias("item_key"), F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", F.when(F.col("vec_id") % 6 != 0, "m").alias("model"))
    part = lambda k: own.where(F.col("vec_id") % 3 == k)
    found = setops.union_stores([part(0), part(1).withColumn("doi", F.concat(F.lit("doi"), "vec_id")), part(2).withColumn("year", 2000 + F.col("vec_id") % 20)])
    return found.select("item_key", "chunk_id", "doi", "year")


@query("U6 S20", "SELECT doc_id, (row_number() OVER (ORDER BY md5(text), doc_id) - 1) // greatest(1, (SELECT count(*) // 3 FROM documents)) AS page FROM documents")
def concatenated_pages(spark, sf):
    """Pages of a third of the documents each, put together again."""
    seek = SeekTable(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest")), [F.col("digest"), F.col("doc_id")])
    pages = [page.select("doc_id", F.lit(k).cast("long").alias("page")) for k, page in enumerate(seek.pages(max(1, seek.total // 3)))]
    return reduce(DataFrame.unionByName, pages)


@query("M14 F15", """WITH updates AS (SELECT c_nationkey AS owner, c_custkey AS pos, 's' || CAST(c_custkey % 40 AS VARCHAR) AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer),
errors AS (SELECT owner, arg_min(key, pos) AS key FROM updates WHERE CAST(substr(key, 2) AS INTEGER) >= 39 GROUP BY owner),
good AS (SELECT owner, key, arg_max(value, pos) AS value FROM updates WHERE owner NOT IN (SELECT owner FROM errors) GROUP BY owner, key),
stored AS (SELECT n_nationkey AS owner, 's' || CAST(k AS VARCHAR) AS key, 'old' AS value FROM nation, range(0, 5) AS r(k))
SELECT owner, key, value, CAST(NULL AS VARCHAR) AS error FROM good UNION ALL SELECT owner, key, value, NULL FROM stored s WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.owner = s.owner AND g.key = s.key)
UNION ALL SELECT owner, key, NULL, 'unknown setting' FROM errors""")
def settings_applied(spark, sf):
    """Each nation as an owner of settings, its customers as updates: all of an owner's, or none if one is unknown."""
    updates = table(spark, sf, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("pos"), F.concat(F.lit("s"), F.col("c_custkey") % 40).alias("key"), F.col("c_custkey").cast("string").alias("value"))
    known = updates.where("pos % 40 < 39").select("key").distinct()
    stored = table(spark, sf, "nation").select(F.col("n_nationkey").alias("owner"), F.explode(F.array(*[F.lit(f"s{k}") for k in range(5)])).alias("key"), F.lit("old").alias("value"))
    after, errors = config.applied(stored, updates, known)
    return after.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select("owner", "key", F.lit(None).cast("string").alias("value"), F.lit("unknown setting").alias("error")))


@query("K13", """SELECT doc_id AS id, '{"jsonrpc":"2.0","id":' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 5 = 1 THEN ',"error":{"code":-32602,"message":"no ' || lang || '"}}' WHEN doc_id % 5 = 2 THEN ',"error":{"code":-32603,"message":""}}'
  WHEN doc_id % 5 = 3 THEN ',"result":null}' ELSE ',"result":{"source":"' || source || '","n":' || CAST(n_chars AS VARCHAR) || '}}' END AS envelope FROM documents""")
def rpc_envelopes(spark, sf):
    """Answers to a request for each document: results, nulls and errors of two kinds."""
    n = F.col("doc_id") % 5
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(~n.isin(1, 2, 3), F.to_json(F.struct("source", F.col("n_chars").alias("n")))).alias("result"),
        F.when(n == 1, "InvalidParams").when(n == 2, "Broken").alias("error"), F.when(n == 1, F.concat(F.lit("no "), "lang")).alias("message"),
    )
    return exports.envelopes(rows, {e.__name__: e.code for e in (InvalidParams, MethodNotFound, InvalidRequest)})


@query("A12", "WITH k AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['id', lang] ELSE ['id', 'more', source] END) AS key, unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS spot FROM documents) SELECT key, min(doc_id) AS place, arg_min(spot, doc_id) AS spot, count(*) AS n FROM k GROUP BY key")
def key_unions(spark, sf):
    """The columns that a table of all documents' objects would have, in order."""
    quoted = lambda c: F.concat(F.lit(',"'), c, F.lit('":1'))
    body = F.when(F.col("doc_id") % 3 == 0, quoted(F.col("lang"))).otherwise(F.concat(F.lit(',"more":{"x":2}'), quoted(F.col("source"))))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("place"), F.concat(F.lit('{"id":0'), body, F.lit("}")).alias("value"))
    return exports.key_union(rows).select("key", "first.place", F.col("first.at").alias("spot"), "n")
