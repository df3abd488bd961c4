"""Item files, and jobs over whole texts with rebuilds, emptied texts and unreadable responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import jobs
from lectern.plans.bind import markdown_docs, table
from lectern.plans.files import _responses
from lectern.plans.query import registrar
from lectern.plans.texts import _BODIES, _split_sql
from lectern.sources import itemfiles, providers
from lectern.stages import Stages

QUERIES, query = registrar()


@query("K1 K2 S10 S14", """SELECT source AS item_key, sha256(string_agg('{"digest":"' || md5(text) || '","doc_id":' || CAST(doc_id AS VARCHAR) || ',"item_key":"' || source || '","lang":"' || lang || '","ordinal":' || CAST(doc_id AS VARCHAR) || '}' || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY source""")
def item_digests(spark, sf):
    """The writer's digests of a file of JSON lines for each source."""
    rows = table(spark, sf, "documents").select(F.col("source").alias("item_key"), F.col("doc_id").alias("ordinal"), "doc_id", "lang", F.md5("text").alias("digest"))
    return itemfiles.write_items(rows, f"{Stages(spark, 'items').path}/chunks", "chunks").select("item_key", "sha256")


@query("S11 S10 S16", "SELECT source AS item_key, doc_id, md5(text) AS digest FROM documents WHERE source IN ('src1', 'src7')")
def item_lines(spark, sf):
    """Rows of two items' files: the others are never opened."""
    path = f"{Stages(spark, 'items').path}/blocks"
    itemfiles.write_items(table(spark, sf, "documents").select(F.col("source").alias("item_key"), F.col("doc_id").alias("ordinal"), "doc_id", "text"), path, "blocks")
    own = itemfiles.read_item_rows(spark, path, "blocks", "doc_id long, text string").where(F.col("item_key").isin("src1", "src7"))
    return own.select("item_key", "doc_id", F.md5("text").alias("digest"))


@query("K3 S12 K4 S13", "SELECT 'L' || CAST(label AS VARCHAR) AS item_key, 'c' || CAST(vec_id AS VARCHAR) AS chunk_id, CAST(round(CAST(embedding[3] AS DOUBLE) * 1000) AS BIGINT) AS third, '{\"id\":' || CAST(vec_id AS VARCHAR) || '}' AS payload FROM embeddings")
def item_vectors(spark, sf):
    """Vectors through NPZ files of their labels, and a raw zip for each vector, joined again."""
    top = Stages(spark, "items").path
    own = table(spark, sf, "embeddings").select(F.concat(F.lit("L"), "label").alias("item_key"), "vec_id", F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    itemfiles.write_items(own.select("item_key", F.col("vec_id").alias("ordinal"), "chunk_id", F.sha2("chunk_id", 256).alias("text_sha256"), "vector", F.lit("m").alias("model")), f"{top}/npz", "npz")
    itemfiles.write_items(own.select(F.col("chunk_id").alias("item_key"), F.lit("glm").alias("provider"), F.to_json(F.struct(F.col("vec_id").alias("id"))).alias("payload")), f"{top}/zip", "zip")
    raw = itemfiles.read_items(spark, f"{top}/zip", "zip").where("member = 'provider_raw.json'").select(F.col("item_key").alias("chunk_id"), F.regexp_replace("text", " ", "").alias("payload"))
    vectors = itemfiles.read_items(spark, f"{top}/npz", "npz")
    third = F.round(F.get("vector", F.lit(2)).cast("double") * 1000).cast("long")
    return vectors.join(raw, "chunk_id").select("item_key", "chunk_id", third.alias("third"), "payload")


_NOTE = "'added to ' || CAST(conv_id AS VARCHAR) || '.'"


@query("M17 R1 T4 X13", _split_sql(_BODIES, "conv_id, k, role") + f""", kept AS (SELECT conv_id, role AS section, md5(chunk) AS digest FROM chunks WHERE regexp_matches(chunk, '[^\\s]') AND conv_id % 10 <> 0)
SELECT CAST(conv_id AS VARCHAR) AS item_key, section, digest FROM kept UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'more', md5({_NOTE}) FROM conversations WHERE conv_id % 2 = 0 AND conv_id % 10 <> 0""")
def index_rebuilt(spark, sf):
    """The store after every second conversation is indexed again: some got another section, some have no text any more."""
    docs = markdown_docs(spark, sf)
    key = F.col("conv_id").cast("string").alias("key")
    none = F.array().cast("array<struct<first_name: string, last_name: string, name: string>>")
    own = docs.select(key, F.lit("t").alias("title"), none.alias("creators"))
    stage = Stages(spark, "rebuilt")
    store = jobs.index_job(own, docs.select(key, "text"), put=stage.put, dim=8, overlap=64)[0]
    more = F.concat("text", F.lit("\n\n# more\n\nadded to "), F.col("conv_id").cast("string"), F.lit("."))
    later = docs.where("conv_id % 2 = 0").select(key, F.when(F.col("conv_id") % 10 != 0, more).otherwise(" ").alias("text"))
    again = Stages(spark, "rebuilt")
    after = jobs.index_job(own.where("CAST(key AS BIGINT) % 2 = 0"), later, store, rebuild=True, put=again.put, dim=8, overlap=64)[0]
    return after.select("item_key", "section", F.md5("text").alias("digest"))


def _recognised(spark, sf):
    """Every document as an item with a PDF, done for every eleventh; its text comes back in the envelope of one of eight providers, or broken."""
    docs = table(spark, sf, "documents")
    key, n = F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.col("doc_id") % 8
    items = docs.select(key.alias("key"))
    attachments = docs.where("doc_id % 13 <> 4").select(F.concat(F.lit("A"), key).alias("key"), key.alias("parent_key"), F.lit("application/pdf").alias("content_type"), F.lit("x").alias("path"))
    provider, payload = _responses(F.col("text"), n)
    broken = F.col("doc_id") % 9 == 2
    payloads = docs.select(F.concat(F.lit("A"), key).alias("attachment_key"), provider.alias("provider"), F.when(~broken, payload).alias("payload"), F.when(broken, "timed out").alias("error"))
    return jobs.ocr_job(items, attachments, payloads, docs.where("doc_id % 11 = 0").select(key.alias("key")), max_chars=200)


_PARTS = """parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(CASE WHEN doc_id % 8 = 3 THEN 'p1' || chr(10) || chr(10) || text ELSE text END, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM documents),
folded AS (SELECT doc_id, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'now': '', 'n': 0}, list_transform(p, lambda t: {'done': CAST([] AS VARCHAR[]), 'now': t, 'n': length(t)})),
  lambda a, x: CASE WHEN a.now = '' THEN {'done': a.done, 'now': x.now, 'n': x.n} WHEN a.n + x.n > 200 THEN {'done': list_append(a.done, a.now), 'now': x.now, 'n': x.n} ELSE {'done': a.done, 'now': a.now || chr(10) || chr(10) || x.now, 'n': a.n + x.n} END) AS f FROM parts),
state AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'skipped' WHEN doc_id % 13 = 4 THEN 'error: no PDF attachment found' WHEN doc_id % 9 = 2 THEN 'error: timed out' WHEN doc_id % 8 = 7 THEN 'error: unreadable response of unheard' ELSE 'ok' END AS status FROM documents),
cut AS (SELECT doc_id, CASE WHEN f.now = '' THEN f.done ELSE list_append(f.done, f.now) END AS c FROM folded JOIN state USING (doc_id) WHERE status = 'ok')"""


@query("M16 T6 T8 V6 V7", f"WITH {_PARTS}, each AS (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) - 1 AS k FROM cut) SELECT 'AD' || CAST(doc_id AS VARCHAR) || ':c' || CAST(k AS VARCHAR) AS chunk_id, 'D' || CAST(doc_id AS VARCHAR) AS item_key, md5(t) AS digest FROM each")
def ocr_chunks(spark, sf):
    return _recognised(spark, sf)[1].select("chunk_id", "item_key", F.md5("text").alias("digest"))


@query("M16 A6", f"WITH {_PARTS} SELECT 'D' || CAST(doc_id AS VARCHAR) AS item_key, status, coalesce(len(c), 0) AS chunks FROM state LEFT JOIN cut USING (doc_id)")
def ocr_report(spark, sf):
    return _recognised(spark, sf)[2]


_ENGINE = """state AS (SELECT doc_id, text, doc_id % 9 = 4 AS broken FROM documents),
e AS (SELECT doc_id, broken, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM state)"""


@query("V6 M16 S24", f"WITH {_ENGINE} SELECT 'E' || CAST(doc_id AS VARCHAR) AS item_key, CASE WHEN broken THEN 'error: the file isn''t UTF-8 text' ELSE 'ok' END AS status, CASE WHEN broken THEN 0 ELSE len(p) END AS blocks FROM e")
def ocr_engine(spark, sf):
    """Every document as a file of bytes that an engine reads, some of them broken; the job's report with the number of blocks."""
    docs = table(spark, sf, "documents")
    key = F.concat(F.lit("E"), F.col("doc_id").cast("string"))
    files = docs.select(F.concat(F.lit("A"), key).alias("attachment_key"), key.alias("item_key"), F.concat(F.when(F.col("doc_id") % 9 == 4, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "utf-8")).alias("content"))
    payloads = providers.payloads(files, providers.TextEngine)
    items = docs.select(key.alias("key"))
    attachments = files.select(F.col("attachment_key").alias("key"), F.col("item_key").alias("parent_key"), F.lit("application/pdf").alias("content_type"), F.lit("f").alias("path"))
    blocks, _, report = jobs.ocr_job(items, attachments, payloads, items.limit(0))
    counts = blocks.groupBy("item_key").agg(F.count("*").alias("blocks"))
    return report.join(counts, "item_key", "left").select("item_key", "status", F.coalesce("blocks", F.lit(0)).alias("blocks"))
