"""Chunkers and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import blocks, chunks
from lectern.plans.bind import markdown_docs, table
from lectern.plans.query import registrar

QUERIES, query = registrar()



def _split_sql(rows: str, keys: str, size: int = 512, overlap: int = 64) -> str:
    """CTEs up to chunks (keys, i, chunk): the rows (keys, text) split as a body is: whole, or by paragraphs, sentences or strides."""
    return f"""WITH parts AS (SELECT {keys}, text, length(text) AS n, string_split_regex(text, '\\n\\n+') AS paragraphs,
  list_filter(string_split_regex(regexp_replace(text, '([。！？.!?\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sentences FROM ({rows}) WHERE coalesce(text, '') <> ''),
pieces AS (SELECT *, CASE WHEN n > {size} AND len(paragraphs) > 1 THEN paragraphs WHEN n > {size} AND len(sentences) > 1 THEN sentences END AS p FROM parts),
folded AS (SELECT *, list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'now': '', 'n': 0, 'more': false}}, list_transform(p, lambda x: {{'done': CAST([] AS VARCHAR[]), 'now': x, 'n': length(x), 'more': true}})),
  lambda s, x: CASE WHEN s.more AND s.n + x.n > {size}
    THEN {{'done': list_append(s.done, s.now), 'now': CASE WHEN s.now = '' THEN x.now ELSE right(s.now, {overlap}) || chr(10) || chr(10) || x.now END, 'n': length(right(s.now, {overlap})) + x.n, 'more': true}}
    ELSE {{'done': s.done, 'now': CASE WHEN s.more THEN s.now || chr(10) || chr(10) || x.now ELSE x.now END, 'n': s.n + x.n, 'more': true}} END) AS f FROM pieces),
listed AS (SELECT {keys}, CASE WHEN n <= {size} THEN [text] WHEN p IS NOT NULL THEN list_append(f.done, f.now)
  ELSE list_transform(range(0, n, {size - overlap}), lambda k: substr(text, CAST(k + 1 AS BIGINT), {size})) END AS c FROM folded),
chunks AS (SELECT {keys}, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS i FROM listed)"""


@query("T2 W4", _split_sql("SELECT doc_id, text FROM documents", "doc_id") + " SELECT doc_id, i, md5(chunk) AS digest, length(chunk) AS n FROM chunks")
def chunk_sentences(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks.split_text(F.col("text"), 512, 64)).alias("i", "chunk"))
    return own.select("doc_id", "i", F.md5("chunk").alias("digest"), F.length("chunk").alias("n"))


@query("T3", "SELECT page_id, CAST(i AS INTEGER) AS i, md5(substr(html, CAST(i * 448 + 1 AS BIGINT), 512)) AS digest FROM pages, range(0, 100000) AS r(i) WHERE i * 448 < length(html)")
def chunk_hard(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(chunks.hard_stride(F.col("html"), 512, 64)).alias("i", "c"))
    return rows.select("page_id", "i", F.md5("c").alias("digest"))


_TURNS = "turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k, role, text FROM conversations)"


@query("T1 W6", f"WITH {_TURNS} SELECT conv_id, CAST(k AS INTEGER) AS k, role AS title, md5(trim(text)) AS body FROM turns")
def sections(spark, sf):
    rows = chunks.with_sections(markdown_docs(spark, sf)).select("conv_id", F.posexplode("sections").alias("k", "s"))
    return rows.select("conv_id", "k", F.col("s.title").alias("title"), F.md5("s.body").alias("body"))


_BODIES = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations"


@query("T4 W5 F16", _split_sql(_BODIES, "conv_id, k, role") + " SELECT conv_id, role AS section, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, i) - 1 AS INTEGER) AS chunk_index, md5(chunk) AS digest FROM chunks WHERE regexp_matches(chunk, '[^\\s]')")
def chunk_text(spark, sf):
    rows = chunks.chunk_documents(markdown_docs(spark, sf), 512, 64)
    return rows.select("conv_id", "section", "chunk_index", F.md5("text").alias("digest"))


_BLOCKS = f"""WITH {_TURNS}, b AS (
  SELECT conv_id, 2 * k AS o, 'heading' AS type, role AS text, '' AS own, role AS carried FROM turns
  UNION ALL SELECT conv_id, 2 * k + 1, 'paragraph', text, role, role FROM turns)"""


@query("T6 W3", _BLOCKS + " SELECT 'A' || CAST(conv_id AS VARCHAR) || ':p0:b' || CAST(o AS VARCHAR) AS block_id, type, own AS section_heading, md5(text) AS digest FROM b")
def md_blocks(spark, sf):
    docs = markdown_docs(spark, sf).select(F.concat(F.lit("A"), F.col("conv_id").cast("string")).alias("attachment_key"), F.lit("I").alias("item_key"), F.lit("p").alias("provider"), F.col("text").alias("markdown"))
    return blocks.markdown_blocks(docs).select("block_id", "type", "section_heading", F.md5("text").alias("digest"))


def _payloads(spark, sf):
    """Each conversation as a structured payload: a page a turn with a title and a text block, and an empty one in between."""
    c = table(spark, sf, "conversations")
    block = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))
    page = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t, i: F.struct(i.alias("page"), F.array(block(F.lit("Title"), t["role"]), block(F.lit("text"), F.lit(" ")), block(F.lit(None).cast("string"), t["text"])).alias("blocks")))
    payload = F.to_json(F.struct(page.alias("pages")))
    return c.groupBy("conv_id").agg(payload.alias("payload")).select(F.concat(F.lit("A"), F.col("conv_id").cast("string")).alias("attachment_key"), F.lit("I").alias("item_key"), F.lit("p").alias("provider"), "payload")


_STRUCTURED = f"""WITH {_TURNS}, b AS (
  SELECT conv_id, k, 0 AS j, 'heading' AS type, role AS text, role AS section FROM turns
  UNION ALL SELECT conv_id, k, 2, 'paragraph', trim(text), role FROM turns)"""


@query("T5 T7 F17 X16 X17 X19", _STRUCTURED + " SELECT 'A' || CAST(conv_id AS VARCHAR) || ':p' || CAST(CASE WHEN k = 0 THEN 1 ELSE k END AS VARCHAR) || ':b' || CAST(j AS VARCHAR) AS block_id, type, CAST(CASE WHEN k = 0 THEN 1 ELSE k END AS INTEGER) AS page, section AS section_heading, md5(text) AS digest, 'weak' AS provenance_strength FROM b")
def provider_blocks(spark, sf):
    return blocks.provider_blocks(_payloads(spark, sf)).select("block_id", "type", "page", "section_heading", F.md5("text").alias("digest"), "provenance_strength")


@query("T8", f"""WITH {_TURNS}, f AS (SELECT conv_id, list(struct_pack(role := role, text := trim(text)) ORDER BY k) AS t FROM turns GROUP BY conv_id), c AS (SELECT conv_id, unnest(t) AS x, generate_subscripts(t, 1) - 1 AS k FROM f)
SELECT 'A' || CAST(conv_id AS VARCHAR) || ':c' || CAST(k AS VARCHAR) AS chunk_id, x.role AS section_heading, md5(x.text) AS digest, CAST(1 AS INTEGER) AS n_blocks, length(x.text) AS char_end FROM c""")
def block_chunks(spark, sf):
    rows = blocks.chunk_blocks(blocks.provider_blocks(_payloads(spark, sf)), 1000)
    return rows.select("chunk_id", "section_heading", F.md5("text").alias("digest"), F.size("block_ids").alias("n_blocks"), "char_end")


_LINES = """b AS (SELECT source, doc_id, CASE WHEN doc_id % 17 = 0 THEN 'heading' ELSE 'paragraph' END AS type, lang, substr('b' || md5(text), 1, CAST(1 + doc_id % 13 AS BIGINT)) AS t FROM documents),
marked AS (SELECT *, type = 'heading' OR coalesce(lag(type) OVER w = 'heading' OR lag(lang) OVER w <> lang, true) AS fresh FROM b WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
segments AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM marked),
listed AS (SELECT source, s, lang, list(t ORDER BY doc_id) AS ts FROM segments WHERE type <> 'heading' GROUP BY source, s, lang),
folded AS (SELECT source, s, lang, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'now': '', 'n': 0}, list_transform(ts, lambda t: {'done': CAST([] AS VARCHAR[]), 'now': t, 'n': length(t)})),
  lambda a, x: CASE WHEN a.now = '' THEN {'done': a.done, 'now': x.now, 'n': x.n} WHEN a.n + x.n > 20 THEN {'done': list_append(a.done, a.now), 'now': x.now, 'n': x.n} ELSE {'done': a.done, 'now': a.now || chr(10) || chr(10) || x.now, 'n': a.n + x.n} END) AS f FROM listed),
chunks AS (SELECT source, s, lang, unnest(list_append(f.done, f.now)) AS text, generate_subscripts(list_append(f.done, f.now), 1) AS k FROM folded)"""


@query("T8 A9 W2", f"WITH {_LINES} SELECT source || ':c' || CAST(row_number() OVER (PARTITION BY source ORDER BY s, k) - 1 AS VARCHAR) AS chunk_id, lang AS section_heading, text FROM chunks")
def cut_chunks(spark, sf):
    """Every document as a short block of its source, cut at 20 characters: attachments as large as the sources."""
    d = F.col("doc_id")
    none = lambda kind: F.lit(None).cast(kind)
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("attachment_key"), d.alias("reading_order"), d.cast("string").alias("block_id"), F.lit("I").alias("item_key"), F.when(d % 17 == 0, "heading").otherwise("paragraph").alias("type"), F.lit(1).alias("page"), none("array<double>").alias("bbox"),
        F.col("lang").alias("section_heading"), F.substring(F.concat(F.lit("b"), F.md5("text")), F.lit(1), (1 + d % 13).cast("int")).alias("text"), none("string").alias("caption"), none("string").alias("image_ref"), F.lit("weak").alias("provenance_strength"),
    )
    return blocks.chunk_blocks(rows, 20).select("chunk_id", "section_heading", "text")
