"""Lexical and vector retrieval, hits, citations, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import query_terms
from lectern.operators import retrieval, vectorsearch
from lectern.operators.ranks import positions
from lectern.plans.bind import ITEMS, chunks, item_key, items, table, vectors, with_ctes
from lectern.plans.query import registrar

QUERIES, query = registrar()

QUERY = "the tion and, ered"
_TERMS = ("the", "tion", "and", "ered")
_SCORE = "(CASE WHEN contains(lower(text), 'the tion and, ered') THEN 1 ELSE 0 END" + "".join(f" + CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in _TERMS) + ")"
_SCORED = f"scored AS (SELECT source AS item_key, 'I' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS chunk_id, {_SCORE} AS score FROM documents), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, chunk_id) AS r FROM scored WHERE score > 0)"


@query("X1 X2 F9 W1 O7 Q14 Q17", f"WITH {_SCORED} SELECT item_key, chunk_id, score FROM ranked WHERE r <= 3 ORDER BY score DESC, chunk_id LIMIT 50")
def lexical_hits(spark, sf):
    return retrieval.lexical_hits(chunks(spark, sf), QUERY).select("item_key", "chunk_id", "score")


@query("W1 A3", f"WITH {_SCORED} SELECT count(*) AS hits, count(DISTINCT item_key) AS items, max(score) AS best FROM (SELECT * FROM ranked WHERE r <= 1 ORDER BY score DESC, chunk_id LIMIT 50)")
def lexical_hits_meta(spark, sf):
    found = retrieval.lexical_hits(chunks(spark, sf), QUERY, per_item=1)
    return found.agg(F.count("*").alias("hits"), F.count_distinct("item_key").alias("items"), F.max("score").alias("best"))


@query("P5 X3 X4 X6 X21", with_ctes(f"SELECT i.key AS item_key, i.key AS chunk_id, {_SCORE} AS score, i.title, i.author AS authors, i.year, i.source AS venue, nullif(i.doi, '') AS doi, 'library://items/' || i.key AS uri FROM items i WHERE {_SCORE} > 0 ORDER BY score DESC, i.key LIMIT 20", ITEMS))
def hit_rows(spark, sf):
    own = items(spark, sf)
    found = retrieval.lexical_hits(own.select(F.col("key").alias("item_key"), F.col("key").alias("chunk_id"), "text"), QUERY, limit=20)
    return retrieval.hits(found, own, QUERY).select("item_key", "chunk_id", "score", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "doi", "uri")


_Q = [((k * 7919) % 17 - 8) / 8 for k in range(64)]
_QSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"
_VECS = f"vecs AS (SELECT 'L' || CAST(label AS VARCHAR) AS item_key, 'V' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QSQL}) AS s FROM embeddings)"


@query("X22 O6 J13 Q10", f"WITH {_VECS} SELECT item_key, chunk_id, round(s, 5) AS score FROM vecs ORDER BY s DESC, chunk_id LIMIT 10")
def vector_topk(spark, sf):
    return retrieval.vector_hits(vectors(spark, sf), _Q, 10).select("item_key", "chunk_id", F.round("score", 5).alias("score"))


@query("W1 O6", f"WITH {_VECS} SELECT item_key, chunk_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY s DESC, chunk_id) AS r FROM vecs) WHERE r <= 2 ORDER BY s DESC, chunk_id LIMIT 12")
def vector_topk_capped(spark, sf):
    return retrieval.vector_hits(vectors(spark, sf), _Q, 12, per_item=2).select("item_key", "chunk_id", F.round("score", 5).alias("score"))


@query("J13 O6", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS vid, list_cosine_similarity(v.e, q.e) AS s FROM v, v q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vid) AS r FROM s) SELECT query_id, 'V' || lpad(CAST(vid AS VARCHAR), 8, '0') AS chunk_id, round(s, 5) AS score FROM r WHERE r <= 3")
def vector_topk_many(spark, sf):
    own = vectors(spark, sf)
    wanted = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return vectorsearch.vector_hits_of(own, wanted, 3).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query("P6", "SELECT 'I' || CAST(doc_id AS VARCHAR) AS item_key, 'Ana ' || lang || '|Bo' AS authors, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS venue, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS section_heading, 'I' || CAST(doc_id AS VARCHAR) || ':c' || CAST(doc_id % 9 AS VARCHAR) AS chunk_id FROM documents")
def store_hits(spark, sf):
    d = F.col("doc_id").cast("string")
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("I"), d).alias("item_key"), F.lit("t").alias("title"), "text", F.concat(F.lit(" Ana "), F.col("lang"), F.lit(";; Bo ;")).alias("authors"), F.lit(2000).alias("year"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("venue"), F.lit("").alias("doi"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("section"),
        F.lit("").alias("chunk_id"), (F.col("doc_id") % 9).alias("chunk_index"), F.lit(1.0).alias("score"),
    )
    return retrieval.rows_to_hits(rows, "q").select("item_key", F.array_join("authors", "|").alias("authors"), "venue", "section_heading", "chunk_id")


@query("P7 K7 E22", "SELECT doc_id AS chunk_index, '**' || text || '** — ' || lang || ' [item:I' || CAST(doc_id AS VARCHAR) || '] (section: ' || source || ', score: ' || CAST(doc_id % 90 AS VARCHAR) || '.50)' || chr(10) || chr(10) || '> ' || text || chr(10) AS markdown FROM documents")
def citations(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.concat(F.lit("I"), F.col("doc_id").cast("string")).alias("item_key"), F.lit("a").alias("attachment_id"), F.col("text").alias("title"), F.col("lang").alias("authors"), F.col("source").alias("section"), F.col("doc_id").alias("chunk_index"), "text", (F.col("doc_id") % 90 + 0.5).alias("score"))
    return retrieval.citation_markdown(retrieval.citations(rows)).select("chunk_index", "markdown")


@query("P8 X15", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def chunk_digests(spark, sf):
    return retrieval.chunk_metadata(table(spark, sf, "documents").select("doc_id", "text"))


def _ordinal(df):
    return positions(df, ["item_key"], ["doc_id"], "ordinal")


@query("J17 Q16 R3", "SELECT source AS item_key, bool_or(doc_id % 101 = 7) AS stale FROM documents GROUP BY source")
def stale_items(spark, sf):
    now = _ordinal(table(spark, sf, "documents").select(F.col("source").alias("item_key"), "doc_id", "text", item_key(F.col("doc_id")).alias("chunk_id")))
    stored = retrieval.chunk_metadata(now.withColumn("text", F.when(F.col("doc_id") % 101 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return retrieval.stale_items(stored, now)


@query("P11 J11", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'own' END, 'meta') AS title, source || ':c' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS VARCHAR) AS chunk_id FROM documents")
def artifact_rows(spark, sf):
    base = _ordinal(table(spark, sf, "documents").select(F.col("source").alias("item_key"), "doc_id"))
    own = base.select("item_key", "ordinal", "doc_id", F.when(F.col("doc_id") % 2 == 0, "own").alias("title"), F.lit(None).cast("string").alias("chunk_id"))
    meta = base.select("item_key", "ordinal", F.lit("meta").alias("title"))
    return retrieval.merge_artifact_rows(meta, own).select("doc_id", "title", "chunk_id")


@query("X1 U7", """WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[\\s,;，；、]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT doc_id, t, min(i) AS i FROM t WHERE t <> '' GROUP BY doc_id, t)
SELECT doc_id, coalesce(n, 1) AS n, md5(coalesce(terms, lower(text))) AS terms FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(t, '|' ORDER BY i) AS terms FROM f GROUP BY doc_id) USING (doc_id)""")
def query_term_lists(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", query_terms(F.col("text")).alias("terms"))
    return rows.select("doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", "|")).alias("terms"))
