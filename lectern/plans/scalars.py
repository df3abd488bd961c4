"""Scalar functions over literal rows and table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import hashes, names, text
from lectern.operators import exports
from lectern.plans.bind import ITEMS, items, table, with_ctes
from lectern.plans.query import registrar

QUERIES, query = registrar()


def _list(values) -> str:
    """A list of texts in SQL."""
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at):
    """The value at a place of a list of texts."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


_FIRST, _LAST = ("Ada", "明", "", None, "Jo", "Ann"), ("Byron", "李", "Plato", "", None, "王", "Ô'Neil")
_NAMED = f"SELECT c_custkey AS k, {_list(_FIRST)}[1 + c_custkey % 6] AS f, {_list(_LAST)}[1 + c_custkey % 7] AS l, CASE WHEN c_custkey % 11 = 0 THEN c_name WHEN c_custkey % 11 = 1 THEN '' END AS n FROM customer"


@query("X3", f"SELECT k, CASE WHEN n <> '' THEN n WHEN f <> '' AND l <> '' AND regexp_matches(f || l, '[\u3400-\u9fff]') THEN l || f ELSE trim(coalesce(f, '') || ' ' || coalesce(l, '')) END AS name FROM ({_NAMED})")
def creator_names(spark, sf):
    c = F.col("c_custkey")
    name = F.when(c % 11 == 0, F.col("c_name")).when(c % 11 == 1, "")
    creator = F.struct(_pick(_FIRST, c % 6).alias("first_name"), _pick(_LAST, c % 7).alias("last_name"), name.alias("name"), F.lit("author").alias("creator_type"))
    return table(spark, sf, "customer").select(c.alias("k"), names.creator_name(creator).alias("name"))


_HEADS, _TAILS = ("欧阳", "李", "诸葛", "王", "卡尔·", "阿•贝•", "Smith ", "司马", ""), ("", "明", "孔明", " 修", "a", "马克思")
_WHOLE = f"SELECT c_custkey AS k, trim(' ' || {_list(_HEADS)}[1 + c_custkey % 9] || {_list(_TAILS)}[1 + c_custkey // 9 % 6] || ' ') AS x FROM customer"
_CUT = f"""CASE WHEN NOT regexp_matches(x, '[\u4e00-\u9fff]') THEN length(x) WHEN contains(x, '·') THEN instr(x, '·') - 1 WHEN contains(x, '•') THEN instr(x, '•') - 1
  WHEN list_contains({_list(names.COMPOUND_SURNAMES)}, left(x, 2)) THEN 2 ELSE 1 END"""


@query("X8 X9", f"SELECT k, substr(x, 1, n) AS last_name, substr(x, CASE WHEN regexp_matches(x, '[\u4e00-\u9fff]') AND (contains(x, '·') OR contains(x, '•')) THEN n + 2 ELSE n + 1 END) AS first_name FROM (SELECT k, x, {_CUT} AS n FROM ({_WHOLE}))")
def split_names(spark, sf):
    c = F.col("c_custkey")
    name = F.concat(F.lit(" "), _pick(_HEADS, c % 9), _pick(_TAILS, F.floor(c / 9) % 6), F.lit(" "))
    return table(spark, sf, "customer").select(c.alias("k"), names.split_chinese_name(name).alias("s")).select("k", "s.last_name", "s.first_name")


_DATES = ("%Y-05-01", "May %Y", "1%Y", "c. 2200", "", None, "%Y/2000", "before %Y.")


@query("X4 X5", f"SELECT o_orderkey AS k, TRY_CAST(regexp_extract(replace({_list(_DATES)}[1 + o_orderkey % 8], '%Y', CAST(year(o_orderdate) AS VARCHAR)), '\\b(?:18|19|20|21)[0-9][0-9]\\b') AS INTEGER) AS year FROM orders")
def item_years(spark, sf):
    date = F.replace(_pick(_DATES, F.col("o_orderkey") % 8), F.lit("%Y"), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.year_of(date).alias("year"))


@query("X6", with_ctes("SELECT key, source AS venue FROM items", ITEMS))
def venues(spark, sf):
    return items(spark, sf).select("key", text.venue_of(F.col("fields")).alias("venue"))


@query("X7", with_ctes("SELECT key, citation_key FROM items", ITEMS))
def citation_keys(spark, sf):
    return items(spark, sf).select("key", text.citation_key(F.col("fields"), F.col("creators")).alias("citation_key"))


@query("X10 X11 X12 X29", "SELECT c_custkey AS k, 'a_b_' || CAST(c_custkey AS VARCHAR) AS safe, 'path ' || c_mktsegment AS clean, lower(c_mktsegment) || ' x' AS norm, CAST(c_custkey * 100 // 1024 AS BIGINT) AS kb FROM customer")
def small_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("k"), text.safe_key(F.concat(F.lit("a/b\\"), F.col("c_custkey").cast("string"))).alias("safe"), text.clean_path(F.concat(F.lit("“path «"), F.col("c_mktsegment"), F.lit("”"))).alias("clean"),
        text.normalized_name(F.concat(F.lit("　 "), F.col("c_mktsegment"), F.lit(" \t\n X "))).alias("norm"), text.floor_kb(F.col("c_custkey") * 100).alias("kb"),
    )


@query("X13", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


_METHODS = ["items.get", "items.list", "collections.tree", "tags.add", "search.quick", "system.ping"]
#: A method with a letter missing, in capitals, or followed by a word of the table.
_ASKED = f"SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN substr(m, 1, cut) || substr(m, cut + 2) WHEN 1 THEN upper(m) ELSE m || p_brand END AS asked FROM (SELECT *, {_list(_METHODS)}[1 + p_partkey % 6] AS m, p_partkey // 6 % 9 AS cut FROM part)"
_NEAR = " UNION ALL ".join(f"SELECT k, '{m}' AS method, {i} AS i, levenshtein(lower(asked), '{m}') AS d FROM asked" for i, m in enumerate(_METHODS))


@query("X14 V1", f"WITH asked AS ({_ASKED}), near AS ({_NEAR}), best AS (SELECT k, arg_min(method, d * 100 + i) AS method FROM near WHERE d <= 5 GROUP BY k) SELECT k, method FROM asked LEFT JOIN best USING (k)")
def closest_method(spark, sf):
    p = F.col("p_partkey")
    m, at = _pick(_METHODS, p % 6), (F.floor(p / 6) % 9).cast("int")
    asked = F.when(p % 3 == 0, F.concat(F.substring(m, 1, at), F.substring(m, at + 2, F.length(m)))).when(p % 3 == 1, F.upper(m)).otherwise(F.concat(m, F.col("p_brand")))
    return table(spark, sf, "part").select(p.alias("k"), text.closest(asked, _METHODS).alias("method"))


_KINDS = ("Title", "TEXT", None, "image", "Table", "", "footnote", "Reference")


@query("X16", f"WITH t AS (SELECT p_partkey AS k, lower(CASE WHEN p_partkey % 9 = 8 THEN p_brand ELSE {_list(_KINDS)}[1 + p_partkey % 9] END) AS x FROM part) SELECT k, CASE WHEN coalesce(x, '') = '' OR x = 'text' THEN 'paragraph' WHEN x = 'title' THEN 'heading' WHEN x = 'image' THEN 'figure' WHEN list_contains({_list(text.BLOCK_TYPES)}, x) THEN x ELSE 'unknown' END AS kind FROM t")
def block_types(spark, sf):
    p = F.col("p_partkey")
    kind = F.when(p % 9 == 8, F.col("p_brand")).otherwise(_pick(_KINDS, p % 9))
    return table(spark, sf, "part").select(p.alias("k"), text.block_type(kind).alias("kind"))


@query("X20 P13", with_ctes("SELECT key, author AS authors, CAST(2 AS INTEGER) AS n, upper(lang) || CAST(doc_id % 50 AS VARCHAR) AS line FROM items", ITEMS))
def author_lists(spark, sf):
    own = items(spark, sf)
    listed = text.authors_list(F.concat(F.lit(" ; "), names.creator_name(F.get("creators", F.lit(0))), F.lit(";Bo; ")))
    return own.select("key", F.get(listed, F.lit(0)).alias("authors"), F.size(listed).alias("n"), text.author_line(F.col("creators")).alias("line"))


@query("X15", "SELECT page_id, sha256(url) AS digest FROM pages")
def text_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashes.text_sha256(F.col("url")).alias("digest"))


@query("X23 E19", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'pdf_sha256' END, CASE WHEN doc_id % 2 = 0 THEN 'model' END, CASE WHEN doc_id % 3 = 0 THEN 'dim' END) AS reasons FROM documents")
def stale_reasons(spark, sf):
    d = F.col("doc_id")
    now = F.create_map(F.lit("dim"), F.lit("8"), F.lit("model"), F.lit("m"), F.lit("pdf_sha256"), F.when(d % 5 == 0, "x"))
    old = F.create_map(F.lit("model"), F.when(d % 2 == 0, "o").otherwise("m"), F.lit("dim"), F.when(d % 3 == 0, "4").otherwise("8"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(hashes.stale_reasons(now, old), ",").alias("reasons"))


@query("X25", "SELECT c_custkey AS k, 'title' AS field, 'contains' AS op, c_mktsegment || ' a b' AS value FROM customer")
def conditions(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", text.condition_of(F.concat(F.lit(" title contains  "), F.col("c_mktsegment"), F.lit(" a b"))).alias("x"))
    return c.select(F.col("c_custkey").alias("k"), "x.field", "x.op", "x.value")


@query("X26 S9", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("K9", with_ctes("SELECT key, '@' || CASE item_type WHEN 'journalArticle' THEN 'article' ELSE 'book' END || '{' || citation_key || ',' || chr(10) || '  title = {' || title || '},' || chr(10) || '  author = {' || author || '},' || chr(10) || '  journal = {' || source || '},' || chr(10) || '  year = {' || CAST(year AS VARCHAR) || '}' || CASE WHEN doi <> '' THEN ',' || chr(10) || '  doi = {' || doi || '}' ELSE '' END || chr(10) || '}' AS entry FROM items WHERE parent_key IS NULL", ITEMS))
def export_bibtex(spark, sf):
    return exports.bibtex(items(spark, sf).where("parent_key IS NULL"))


@query("K9", with_ctes("SELECT key, 'TY  - ' || CASE item_type WHEN 'journalArticle' THEN 'JOUR' ELSE 'BOOK' END || chr(10) || 'TI  - ' || title || chr(10) || 'AU  - ' || author || chr(10) || 'PY  - ' || CAST(year AS VARCHAR) || chr(10) || 'JO  - ' || source || CASE WHEN doi <> '' THEN chr(10) || 'DO  - ' || doi ELSE '' END || chr(10) || 'ER  - ' AS entry FROM items WHERE parent_key IS NULL", ITEMS))
def export_ris(spark, sf):
    return exports.ris(items(spark, sf).where("parent_key IS NULL"))


@query("K9", with_ctes("""SELECT key, '"' || key || '","' || item_type || '","' || replace(title, '"', '""') || '","' || author || '","' || CAST(year AS VARCHAR) || '","' || doi || '"' AS entry FROM items WHERE parent_key IS NULL""", ITEMS))
def export_csv(spark, sf):
    return exports.csv_rows(items(spark, sf).where("parent_key IS NULL"))


@query("K9", with_ctes("SELECT key, CASE item_type WHEN 'journalArticle' THEN 'article-journal' ELSE 'document' END AS kind, year, title FROM items WHERE parent_key IS NULL", ITEMS))
def export_csl(spark, sf):
    e = exports.csl_json(items(spark, sf).where("parent_key IS NULL"))
    read = F.from_json("entry", "type string, title string, year int")
    return e.select("key", read["type"].alias("kind"), read["year"].alias("year"), read["title"].alias("title"))


@query("K10", with_ctes("SELECT n, key, '[' || CAST(n AS VARCHAR) || '] ' || author || '. ' || title || CASE item_type WHEN 'journalArticle' THEN '[J]. ' ELSE '[Z]. ' END || source || ', ' || CAST(year AS VARCHAR) || '.' AS entry FROM (SELECT row_number() OVER (ORDER BY key) AS n, * FROM items)", ITEMS))
def bibliography(spark, sf):
    return exports.bibliography(items(spark, sf))


@query("P10 S21", with_ctes("SELECT doc_id AS ref, 'journalArticle' AS item_type, md5(title) AS title, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_fields, lang AS family FROM items", ITEMS))
def push_payloads(spark, sf):
    own = items(spark, sf)
    flat = own.select(F.col("doc_id").alias("ref"), F.lit(None).cast("string").alias("item_type"), "title", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("").alias("DOI"), F.array(F.struct(F.lit(None).cast("string").alias("first_name"), F.col("lang").alias("last_name"), F.lit(None).cast("string").alias("creator_type"))).alias("creators"))
    p = exports.push_payload(flat)
    return p.select("ref", "item_type", F.md5(F.col("fields")["title"]).alias("title"), F.size("fields").alias("n_fields"), F.get("creators", F.lit(0))["last_name"].alias("family"))
