"""Artifacts, stores, jobs, providers and settings: what is written is read back from the shared folder."""

from __future__ import annotations


from pyspark.sql import functions as F

from lectern.functions import files
from lectern.functions.embed import with_vectors
from lectern.functions.vectors import cosine, norm
from lectern.operators import aggregates, blocks, exports, filters, jobs, lookups, mutations, programs, retrieval, scans, setops
from lectern.operators.ranks import numbered, positions
from lectern.plans.bind import ITEMS, chunks, items, table, vectors, with_ctes
from lectern.plans.query import registrar
from lectern.stages import Stages
from lectern.sources import artifacts, config, providers, stores

QUERIES, query = registrar()

_NAMED = "'V' || lpad(CAST(vec_id AS VARCHAR), 8, '0')"


def _store(spark, sf):
    own = vectors(spark, sf)
    return own.select(
        F.concat(F.lit("C"), (F.col("label") % 4).cast("string")).alias("collection"), F.lit("7").alias("collection_id"), F.lit("m").alias("model"), "item_key", F.lit("t").alias("title"), F.lit("a").alias("authors"), F.lit("s").alias("section"),
        F.col("vec_id").cast("int").alias("chunk_index"), F.col("chunk_id").alias("text"), "vector",
    )


_SUM = "CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 1000) AS BIGINT)"


def _total():
    return F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) * 1000).cast("long")


@query("K5 S17", f"SELECT 'L' || CAST(label AS VARCHAR) AS item_key, CAST(vec_id AS INTEGER) AS chunk_index, {_SUM} AS total FROM embeddings WHERE label % 4 = 1")
def store_saved(spark, sf):
    path = f"{Stages(spark, 'store').path}/store"
    stores.save_store(_store(spark, sf), path)
    return stores.load_store(spark, path, "C1").select("item_key", "chunk_index", _total().alias("total"))


@query("K5 S17", f"SELECT 'C' || CAST(label % 4 AS VARCHAR) AS collection, 'm' AS model, {_NAMED} AS text, {_SUM} AS total FROM embeddings")
def store_documents(spark, sf):
    path = f"{Stages(spark, 'store').path}/documents"
    stores.export_store(_store(spark, sf), path)
    return stores.import_store(spark, path).select("collection", "model", "text", _total().alias("total"))


def _artifact_chunks(spark, sf):
    """documents as chunks of their source, in order, every seventh without a title of its own; and their vectors. Places are found among ids, without the texts."""
    d, docs = F.col("doc_id"), table(spark, sf, "documents")
    places = positions(docs.select("source", "doc_id"), ["source"], ["doc_id"], "ordinal").select("doc_id", F.col("ordinal").cast("int"))
    key = [F.col("source").alias("item_key"), "ordinal", d.cast("string").alias("chunk_id")]
    own = docs.join(places, "doc_id").select(*key, "text", F.when(d % 7 != 0, F.col("lang")).alias("title"), F.when(d % 5 == 0, "own").alias("venue"), F.lit("h").alias("section_heading"))
    n = (F.col("n_chars") % 89).cast("float")
    # digests are made before the join, so that it moves no texts
    marks = docs.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), F.array((d % 97).cast("float"), n, n).alias("vector"))
    return own, marks.join(places, "doc_id").select(*key, "text_sha256", "vector", F.lit("m").alias("model"))


@query("S10 S11 S12 S14 S15 S16 K2 K3 U3 J11 J12 P12", "SELECT source AS item_key, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index, CASE WHEN doc_id % 7 <> 0 THEN lang ELSE 'of ' || source END AS title, CASE WHEN doc_id % 5 = 0 THEN 'own' ELSE 'venue' END AS venue, sha256(text) AS text_sha256, CAST(doc_id % 97 + 2 * (n_chars % 89) AS BIGINT) AS total FROM documents")
def artifact_store(spark, sf):
    """Chunks as JSON lines and embeddings as NPZ files by item, found by suffix, read, checked and joined into one store."""
    top = Stages(spark, "artifacts").path
    own, vecs = _artifact_chunks(spark, sf)
    artifacts.write_jsonl(own, f"{top}/chunks", by_item=True)
    artifacts.write_npz(vecs, f"{top}/npz").write.mode("overwrite").parquet(f"{top}/written")
    read = spark.read.option("recursiveFileLookup", "true").schema("item_key string, ordinal int, chunk_id string, text string, title string, venue string, section_heading string").json(f"{top}/chunks")
    suffix = artifacts.EMBEDDINGS
    leaf = files.leaf_of(F.col("path"))
    found = artifacts.read_npz(spark, f"{top}/npz").withColumn("item_key", F.substring(leaf, 1, F.length(leaf) - len(suffix)))
    keys = artifacts.item_keys(spark, f"{top}/npz", suffix)
    meta = keys.select("item_key", F.concat(F.lit("of "), "item_key").alias("title"), F.lit("venue").alias("venue"))
    store = stores.united([stores.artifact_store(read, found, meta)])
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).cast("long")
    return store.select("item_key", "chunk_id", "chunk_index", "title", "venue", F.sha2("text", 256).alias("text_sha256"), total.alias("total"))


@query("S13 K4", "SELECT 'Z' || CAST(conv_id AS VARCHAR) AS item_key, 'files/note.txt' AS member, 'text' AS kind, md5(string_agg(text, '|' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id UNION ALL SELECT DISTINCT 'Z' || CAST(conv_id AS VARCHAR), m, 'json', '' FROM conversations, (VALUES ('manifest.json'), ('provider.json'), ('provider_raw.json')) t(m)")
def raw_zips(spark, sf):
    """Provider payloads with a file each, written as zip files by the tasks and read back member by member."""
    path = f"{Stages(spark, 'zips').path}/zips"
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda t: t["text"]), "|")
    rows = c.select(F.concat(F.lit("Z"), F.col("conv_id").cast("string")).alias("item_key"), F.lit("p").alias("provider"), F.to_json(F.struct(body.alias("markdown"))).alias("payload"), F.create_map(F.lit("note.txt"), F.encode(body, "utf-8")).alias("files"))
    artifacts.write_raw_zips(rows, path).write.mode("overwrite").parquet(f"{path}_written")
    read = artifacts.read_raw_zips(spark, path)
    leaf = files.leaf_of(F.col("path"))
    return read.select(F.substring(leaf, 1, F.length(leaf) - len(artifacts.RAW)).alias("item_key"), "member", "kind", F.when(F.col("kind") == "json", "").otherwise(F.md5("text")).alias("digest"))


@query("S9 S10 K1 X26", "SELECT event_id % 50 AS part, CAST(row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) AS INTEGER) AS line, CASE WHEN event_id % 9 <> 0 THEN event_id END AS id, CASE WHEN event_id % 9 = 0 THEN '{broken ' || CAST(event_id AS VARCHAR) END AS error FROM events")
def located_lines(spark, sf):
    """JSON lines with blank and broken ones among them, fifty files: each line with its number, a broken one with its text."""
    path = f"{Stages(spark, 'lines').path}/lines"
    e = F.col("event_id")
    line = F.when(e % 9 == 0, F.concat(F.lit("{broken "), e.cast("string"))).otherwise(F.to_json(F.struct(e.alias("id"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(e, line.alias("line")))), lambda x: x["line"]), "\r\n  \n")
    text = table(spark, sf, "events").groupBy((e % 50).alias("part")).agg(joined.alias("value"))
    text.repartition(8, "part").write.partitionBy("part").mode("overwrite").text(path)
    found = artifacts.read_jsonl_located(spark, f"{path}/part=*", "id long")
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "line", F.col("row.id").alias("id"), "error")


@query("K1", "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang")
def jsonl_digests(spark, sf):
    """The lines of the files whose digest is the one that the writer returned."""
    path = f"{Stages(spark, 'jsonl').path}/jsonl"
    digests = artifacts.write_jsonl(table(spark, sf, "documents").select("doc_id", "lang"), path).where(F.col("path").contains("part-"))
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("sha256"), "value")
    name = lambda: files.leaf_of(F.col("path")).alias("name")
    whole = read.select(name(), "sha256", "value").join(digests.select(name(), "sha256"), ["name", "sha256"])
    rows = whole.select(F.explode(F.split(F.rtrim("value"), "\n")).alias("line")).where("line <> ''").select(F.from_json("line", "doc_id long, lang string").alias("r"))
    return rows.groupBy("r.lang").agg(F.count("*").alias("n"), F.sum("r.doc_id").alias("ids"))


@query("K6 Q14", "SELECT '{\"chunk_id\":\"I' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '\",\"item_key\":\"' || source || '\",\"score\":' || CAST(s AS VARCHAR) || '}' AS line FROM (SELECT doc_id, source, 2 * CAST(contains(lower(text), 'que') AS INTEGER) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE contains(lower(text), 'que')) WHERE r <= 2 ORDER BY s DESC, doc_id LIMIT 30")
def hit_lines(spark, sf):
    found = retrieval.lexical_hits(chunks(spark, sf), "que", per_item=2, limit=30).select("item_key", "chunk_id", "score")
    return exports.hit_lines(found)


@query("K8 T11 V9", "SELECT doc_id AS id, source AS src FROM documents WHERE (lang = 'en' AND n_chars >= 100 OR doc_id = 7) AND contains(text, 'the')")
def row_program(spark, sf):
    return programs.run_program(table(spark, sf, "documents"), '.[] | select((.lang == "en" and .n_chars >= 100 or .doc_id == 7) and (.text | contains("the"))) | {id: .doc_id, src: .source}')


@query("K8 T11 V9", "SELECT lang AS value FROM documents WHERE source <> 'src1' UNION ALL SELECT source FROM documents WHERE source <> 'src1'")
def row_program_tags(spark, sf):
    return programs.run_program(items(spark, sf), 'select(.source != "src1") | .tags[] | .tag')


@query("K8 T11 V9", """SELECT doc_id AS id, CASE WHEN n_chars > 1000 THEN 'long' WHEN n_chars > 100 THEN 'middle' ELSE 'short' END AS size, translate(split_part(text, ' ', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS first,
  NOT regexp_matches(text, '[0-9]{3}') AS plain, (coalesce(n_chars, 0) * 2 + 1) % 7 AS k, len(string_split(text, ' ')) AS words, CAST(substr(source, 4) AS DOUBLE) AS n, 'src-' || substr(source, 4) || '/' || lang AS place FROM documents""")
def row_program_values(spark, sf):
    return programs.run_program(table(spark, sf, "documents"), """.[] | {id: .doc_id,
      size: (if .n_chars > 1000 then "long" elif .n_chars > 100 then "middle" else "short" end), first: (.text | split(" ") | first | ascii_downcase),
      plain: (.text | test("[0-9]{3}") | not), k: ((.n_chars // 0) * 2 + 1) % 7, words: (.text | split(" ") | length),
      n: (.source | ltrimstr("src") | tonumber), place: (.source | gsub("src"; "src-")) + "/" + .lang}""")


@query("K8 T11 V9", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS last, count(DISTINCT source) AS sources FROM documents WHERE n_chars > 50 GROUP BY lang")
def row_program_groups(spark, sf):
    return programs.run_program(table(spark, sf, "documents"), "map(select(.n_chars > 50)) | group_by(.lang) | map({lang: .[0].lang, n: length, chars: (map(.n_chars) | add), last: (map(.doc_id) | max), sources: (map(.source) | unique | length)})")


@query("X28", "SELECT page_id, regexp_extract(url, '[^/]*$') AS leaf, CASE WHEN page_id % 3 = 0 THEN 'base' ELSE 'base.PDF' END AS renamed FROM pages")
def file_names(spark, sf):
    leaf = files.leaf_of(F.col("url"))
    name = F.when(F.col("page_id") % 3 == 0, F.lit(".noext")).otherwise(F.concat(F.lit("a.b."), F.col("page_id").cast("string"), F.lit(".PDF")))
    return table(spark, sf, "pages").select("page_id", leaf.alias("leaf"), files.renamed(name, F.lit("base")).alias("renamed"))


@query("X27", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'C:\\docs\\' || c_name WHEN c_custkey % 3 = 1 THEN '\\\\wsl.localhost\\Linux\\home\\' || c_name ELSE c_name END AS windows, CASE WHEN c_custkey % 3 = 0 THEN '/mnt/c/docs/' || c_name WHEN c_custkey % 3 = 1 THEN '\\\\wsl.localhost\\Linux\\home\\' || c_name ELSE c_name END AS posix FROM customer")
def host_paths(spark, sf):
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    path = F.when(k == 0, F.concat(F.lit("/mnt/c/docs/"), name)).when(k == 1, F.concat(F.lit("/home/"), name)).otherwise(name)
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), files.to_windows(path).alias("windows"))
    return own.withColumn("posix", files.to_posix(F.col("windows")))


@query("P3", with_ctes("SELECT key, parent_key, title, content_type, CAST(doc_id % 4 AS INTEGER) AS link_mode, CASE WHEN doc_id % 20 = 11 THEN NULL ELSE path END AS path FROM items WHERE item_type = 'attachment'", ITEMS))
def attachment_rows(spark, sf):
    own = items(spark, sf).where("item_type = 'attachment'")
    own = own.withColumns({"link_mode": (F.col("doc_id") % 4).cast("int"), "path": F.when(F.col("doc_id") % 20 == 11, "").otherwise(F.col("path"))})
    return scans.attachment_rows(own)


def _annotations(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("A"), c.cast("string")).alias("key"), F.concat(F.lit("I"), (c % 9).cast("string")).alias("parent_key"), F.lit("highlight").alias("annotation_type"), F.when(c % 2 == 0, F.col("c_name")).alias("annotation_text"),
        F.lit(None).cast("string").alias("annotation_comment"), F.lit("#00ff00").alias("annotation_color"), F.when(c % 5 != 0, F.to_json(F.struct(c.alias("pageIndex")))).otherwise("").alias("annotation_position"),
    )


@query("P4", "SELECT 'A' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS annotation_text, '' AS annotation_comment, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS page FROM customer")
def annotation_rows(spark, sf):
    own = scans.annotation_rows(_annotations(spark, sf))
    return own.select("key", "annotation_text", "annotation_comment", F.variant_get("annotation_position", "$.pageIndex", "long").alias("page"))


@query("M12", "SELECT 'A' || CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 'B' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 3")
def annotation_changes(spark, sf):
    own = _annotations(spark, sf)
    marked = F.substring("key", 2, 20).cast("long") % 10 == 3
    new = own.where(marked).withColumn("key", F.concat(F.lit("B"), F.substring("key", 2, 20)))
    return mutations.create_annotations(setops.clear_items(own.withColumnRenamed("key", "item_key"), own.where(marked).select(F.col("key").alias("item_key"))).withColumnRenamed("item_key", "key"), new).select("key")


@query("M12", with_ctes("SELECT key, md5(CASE WHEN doc_id = 10 THEN '<p>new</p>' ELSE note END) AS note FROM items WHERE item_type = 'note' AND doc_id <> 20 UNION ALL SELECT 'NEW', md5('<p>x</p>')", ITEMS))
def note_changes(spark, sf):
    own = items(spark, sf)
    own = mutations.update_note(own, "I00000010", "<p>new</p>")
    own = mutations.delete_items(own, own.where("key = 'I00000020'"))
    fresh = spark.createDataFrame([("NEW", "note", "<p>x</p>", False)], "key string, item_type string, note string, deleted boolean")
    return mutations.create_items(own, fresh).where("item_type = 'note'").select("key", F.md5("note").alias("note"))


@query("S6 M13", "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'again' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'b' ELSE 'a' END AS value FROM supplier WHERE s_suppkey % 5 <> 0")
def saved_searches(spark, sf):
    s = F.col("s_suppkey")
    condition = lambda v: F.array(F.struct(F.lit("title").alias("field"), F.lit("is").alias("op"), F.lit(v).alias("value")))
    own = table(spark, sf, "supplier").select(F.concat(F.lit("S"), s.cast("string")).alias("key"), F.col("s_name").alias("name"), condition("a").alias("conditions"), s.alias("n"))
    new = own.where("n % 4 = 0").withColumns({"name": F.lit("again"), "conditions": condition("b")})
    after = setops.upsert(own, new, ["key"])
    return after.where("n % 5 <> 0").select("key", "name", F.get("conditions", F.lit(0))["value"].alias("value"))


@query("S7", with_ctes("SELECT k AS field, count(*) AS n, count(*) FILTER (WHERE v <> '') AS filled FROM (SELECT unnest(['DOI', 'date', 'publicationTitle', 'extra']) AS k, unnest([doi, date, source, CASE WHEN doc_id % 50 = 3 THEN 'x' ELSE '' END]) AS v FROM items WHERE item_type = 'book') GROUP BY k", ITEMS))
def item_fields(spark, sf):
    """The fields of books, and how many have them filled."""
    own = scans.dictionary(items(spark, sf).select("item_type", "fields"), "item_type", "book")
    each = own.select(F.explode("fields").alias("field", "value"))
    return each.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("value") != "").alias("filled"))


@query("S7", with_ctes("SELECT item_type, 'author' AS creator_type, count(*) AS n, count(DISTINCT upper(lang) || CAST(doc_id % 50 AS VARCHAR)) AS last_names FROM items GROUP BY item_type", ITEMS))
def creator_types(spark, sf):
    """The kinds of creators of each item type."""
    own = scans.dictionary(items(spark, sf).select("item_type", "creators"), "item_type").select("item_type", F.explode("creators").alias("c"))
    return own.groupBy("item_type", F.col("c.creator_type").alias("creator_type")).agg(F.count("*").alias("n"), F.count_distinct("c.last_name").alias("last_names"))


@query("J1 J2 F18", with_ctes("SELECT pos, ref, i.key FROM (VALUES (0, '3'), (1, 'I00000007'), (2, '3'), (3, '12')) t(pos, ref) JOIN items i ON i.key = ref OR CAST(i.doc_id AS VARCHAR) = ref", ITEMS))
def require_refs(spark, sf):
    return lookups.require_id(spark, items(spark, sf).select("key", "doc_id"), ["3", "I00000007", "3", "12"], id_col="doc_id").select("pos", "ref", "key")


@query("F18", with_ctes("SELECT key, item_type FROM items WHERE item_type = 'note'", ITEMS))
def notes_only(spark, sf):
    return lookups.require_kind(items(spark, sf).where("key LIKE '%0'").select("key", "item_type"), "note")


@query("A11", "SELECT count(*) FILTER (WHERE doc_id % 6 = 0) AS embedding_artifacts, count(*) FILTER (WHERE doc_id % 6 = 0) > 0 AS available FROM documents")
def artifact_counts(spark, sf):
    title = F.concat(F.col("lang"), F.when(F.col("doc_id") % 6 == 0, ".embeddings.npz").otherwise(".chunks.jsonl"))
    return aggregates.artifact_summary(table(spark, sf, "documents").select(title.alias("title")))


@query("S15", "SELECT source AS parent_key, min(CASE WHEN doc_id % 6 = 0 THEN CAST(1000000 + doc_id AS VARCHAR) END) AS key FROM documents WHERE doc_id % 6 = 0 GROUP BY source")
def artifact_discovery(spark, sf):
    d = F.col("doc_id")
    own = table(spark, sf, "documents").select(F.col("source").alias("parent_key"), (1_000_000 + d).cast("string").alias("key"), F.concat(F.col("lang"), F.when(d % 6 == 0, ".embeddings.npz").otherwise(".chunks.jsonl")).alias("title"))
    return artifacts.discover(own, artifacts.EMBEDDINGS)


@query("O9", with_ctes("SELECT p.key FROM items p LEFT JOIN items a ON a.parent_key = p.key AND a.item_type = 'attachment' AND (a.path LIKE '%.pdf' OR a.content_type = 'application/pdf') WHERE p.parent_key IS NULL AND a.key IS NULL ORDER BY p.key LIMIT 15", ITEMS))
def missing_pdfs(spark, sf):
    own = items(spark, sf)
    return filters.missing_pdfs(own.where("parent_key IS NULL"), own.where("item_type = 'attachment'"), 15).select("key")


@query("S24", "SELECT page_id, page_id % 3 = 0 AS is_pdf FROM pages")
def pdf_bytes(spark, sf):
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.encode(F.lit("%PDF-1.7 "), "utf-8"), F.encode("html", "utf-8"))).when(F.col("page_id") % 3 == 1, F.encode("html", "utf-8"))
    return table(spark, sf, "pages").select("page_id", filters.pdf_magic(content).alias("is_pdf"))


@query("S22 X24 M14", "SELECT 'my_key_' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 6 = 0 THEN 3 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS value FROM customer")
def settings_layers(spark, sf):
    c = F.col("c_custkey")
    own = table(spark, sf, "customer").select(c, F.concat(F.lit("myKey_"), c.cast("string")).alias("key"))
    layer = lambda n, keep, v: own.where(f"c_custkey % {n} = 0").select("key", F.when(c % keep == 0, v).alias("value"))
    found = config.layered([layer(1, 1, "1"), layer(3, 3, " 2 "), layer(2, 6, "3")])
    return found.select(config.snake_column(F.col("key")).alias("key"), config.coerced(F.col("value"), "int").alias("value"))


@query("M15", "SELECT 'k' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 2 THEN 'old1' WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'default' ELSE 'mine' END AS value FROM customer")
def settings_migrated(spark, sf):
    c = F.col("c_custkey")
    own = table(spark, sf, "customer").select(c, F.concat(F.lit("k"), c.cast("string")).alias("key"))
    stored = own.where("c_custkey % 3 <> 0").select("key", F.when(c % 3 == 1, "default").otherwise("mine").alias("value"))
    legacy = own.where("c_custkey % 4 = 0").select("key", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("value")), F.struct(F.lit(1).alias("rank"), F.lit("old1").alias("value")), F.struct(F.lit(2).alias("rank"), F.lit("old2").alias("value")))).alias("x")).select("key", "x.*")
    return config.migrated(stored, legacy, own.select("key", F.lit("default").alias("value")))


@query("F15", "SELECT c_custkey AS pos, 'k' || CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 8 = 5 ORDER BY pos LIMIT 1")
def first_unknown_setting(spark, sf):
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"))
    return config.unknown_settings(own, own.where("pos % 8 <> 5")).limit(1)


_ROLES = "('openai', 'plain', NULL, NULL), ('zhipu', 'plain', NULL, NULL), ('dashscope', 'plain', NULL, NULL), ('siliconflow', 'plain', NULL, NULL), ('voyage', 'voyage', 'query', 'document'), ('jina', 'jina', 'retrieval.query', 'retrieval.passage'), ('cohere', 'cohere', 'search_query', 'search_document'), ('doubao', 'plain', NULL, NULL), ('gemini', 'gemini', 'RETRIEVAL_QUERY', 'RETRIEVAL_DOCUMENT')"


@query("V3 V8", f"WITH p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM (VALUES {_ROLES}) t(id, style, query_task, document_task)) SELECT id, style, query_task, document_task, count(*) AS vectors FROM embeddings JOIN p ON n = vec_id % 9 GROUP BY ALL")
def embedding_providers(spark, sf):
    """The providers, in the order of the listing, that stored vectors are dealt to."""
    own = providers.embedding_providers(spark).select("id", "style", "query_task", "document_task")
    own = numbered(own, ["id"], "n")
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 9).alias("n")).join(own, "n").groupBy("id", "style", "query_task", "document_task").agg(F.count("*").alias("vectors"))


@query("V4 V3", "SELECT vec_id, '{\"model\":\"m\",\"input\":[\"v' || CAST(vec_id AS VARCHAR) || '\"],\"task\":\"retrieval.query\"}' AS jina, '{\"model\":\"m\",\"texts\":[\"v' || CAST(vec_id AS VARCHAR) || '\"],\"input_type\":\"search_document\",\"embedding_types\":[\"float\"]}' AS cohere, '{\"model\":\"m\",\"input\":[\"v' || CAST(vec_id AS VARCHAR) || '\"]}' AS plain FROM embeddings")
def embedding_requests(spark, sf):
    texts_of = F.array(F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    make = lambda p, role: providers.embedding_request(p, "m", texts_of, role).alias(p if p != "openai" else "plain")
    return table(spark, sf, "embeddings").select("vec_id", make("jina", "query"), make("cohere", "document"), make("openai", "document"))


@query("V3", "SELECT vec_id, CAST(round(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS first FROM embeddings")
def embedding_responses(spark, sf):
    v, n = F.col("embedding"), F.col("vec_id") % 4
    response = (
        F.when(n == 0, F.to_json(F.struct(F.array(F.struct(v.alias("embedding"))).alias("data"))))
        .when(n == 1, F.to_json(F.struct(F.struct(F.array(v).alias("float")).alias("embeddings"))))
        .when(n == 2, F.to_json(F.struct(F.struct(v.alias("values")).alias("embedding"))))
        .otherwise(F.to_json(F.struct(v.alias("embedding"))))
    )
    first = F.get(F.get(providers.embedding_vectors(response), F.lit(0)), F.lit(0))
    return table(spark, sf, "embeddings").select("vec_id", F.round(first.cast("double") * 1000).cast("long").alias("first"))


_WORD_WEIGHT = "CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END * (1 + ln(n))"


@query("V2 V3 V5 M17", f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
h AS (SELECT doc_id, n, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM c), cells AS (SELECT doc_id, h % 32 AS cell, sum({_WORD_WEIGHT}) AS x FROM h GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM cells GROUP BY doc_id)
SELECT d.doc_id, CAST(cell AS INTEGER) AS cell, CAST(round(1000 * x / size) AS BIGINT) AS value FROM documents d JOIN cells USING (doc_id) JOIN norms USING (doc_id) WHERE abs(round(1000 * x / size)) > 100""")
def embedding_values(spark, sf):
    own = with_vectors(table(spark, sf, "documents").select("doc_id", "text"), dim=32, dtype="float64")
    each = own.select("doc_id", F.posexplode("vector").alias("cell", "x"))
    return each.select("doc_id", "cell", F.round(1000 * F.col("x")).cast("long").alias("value")).where(F.abs("value") > 100)


_SIGNED = "CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END"


def _cells(*sums: str) -> str:
    """CTEs up to cells (doc_id, cell, sums): documents' hashed words in 32 cells."""
    return f"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
h AS (SELECT doc_id, n, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM c), cells AS (SELECT doc_id, h % 32 AS cell, {', '.join(sums)} FROM h GROUP BY ALL)"""


@query("V4", f"WITH {_cells(f'sum({_SIGNED} * (1 + ln(n))) AS d', f'sum({_SIGNED}) AS q')} SELECT doc_id, CAST(round(1000 * sum(d * q) / sqrt(sum(d * d) * sum(q * q))) AS BIGINT) AS likeness FROM cells GROUP BY doc_id HAVING sum(d * d) > 0 AND sum(q * q) > 0")
def embedding_roles(spark, sf):
    """How like each other a document's vectors in both roles are; without a direction there is none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = with_vectors(docs, dim=32, dtype="float64").select("doc_id", "text", "vector")
    both = with_vectors(both, out_col="q", dim=32, dtype="float64", role="query").where((norm(F.col("vector")) > 0) & (norm(F.col("q")) > 0))
    return both.select("doc_id", F.round(1000 * cosine(F.col("vector"), F.col("q"))).cast("long").alias("likeness"))


_ENGINES = "('glm', 'glm-layout-parsing', 'bearer', true), ('qwen', 'dashscope-multimodal', 'bearer', true), ('custom', 'openai-vision', 'bearer', true), ('openai-vision-compat', 'openai-vision', 'bearer', false), ('olmocr', 'olmocr-vllm', 'bearer', false), ('mistral-ocr', 'mistral-ocr', 'bearer', true), ('mineru', 'mineru-cli', 'none', true), ('paddleocr-vl', 'openai-vision', 'bearer', true), ('mathpix', 'mathpix', 'header-key', false), ('doubao-ocr', 'openai-vision', 'bearer', false)"


@query("V8 V6", f"WITH p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM (VALUES {_ENGINES}) t(id, style, auth, readable)) SELECT id, style, auth, readable, count(*) AS pages FROM pages JOIN p ON n = page_id % 10 GROUP BY ALL")
def ocr_providers(spark, sf):
    """The providers, in the order of the listing, that pages are dealt to."""
    own = numbered(providers.ocr_providers(spark).select("id", "style", "auth", "readable"), ["id"], "n")
    return table(spark, sf, "pages").select((F.col("page_id") % 10).alias("n")).join(own, "n").groupBy("id", "style", "auth", "readable").agg(F.count("*").alias("pages"))


_SPOKEN = ("glm", "qwen", "custom", "mistral-ocr", "mineru", "paddleocr-vl", "glm", "unheard")


def _responses(text, n):
    """A provider and its response that holds the text, in the provider's own envelope."""
    said = lambda *wrap: F.to_json(wrap[0])
    message = F.array(F.struct(F.struct(text.alias("content")).alias("message")))
    bodies = (
        said(F.struct(text.alias("md_results"))), said(F.struct(F.struct(message.alias("choices")).alias("output"))), said(F.struct(message.alias("choices"))),
        said(F.struct(F.array(F.struct(F.lit("p1").alias("markdown")), F.struct(F.lit("").alias("markdown")), F.struct(text.alias("markdown"))).alias("pages"))), said(F.struct(F.lit("").alias("markdown"), text.alias("md"))),
        said(F.struct(text.alias("text"))), said(F.struct(message.alias("choices"))), said(F.struct(text.alias("text"))),
    )
    provider = F.get(F.array(*[F.lit(p) for p in _SPOKEN]), n.cast("int"))
    return provider, F.get(F.array(*bodies), n.cast("int"))


@query("V7", "SELECT doc_id, md5(CASE WHEN doc_id % 8 = 3 THEN 'p1' || chr(10) || chr(10) || text WHEN doc_id % 8 < 7 THEN text END) AS content, CASE WHEN doc_id % 8 = 7 THEN NULL WHEN doc_id % 8 = 0 THEN 'raw' ELSE 'parsed' END AS strength, doc_id % 8 IN (0, 2, 3, 4) AS is_markdown FROM documents")
def ocr_responses(spark, sf):
    provider, payload = _responses(F.col("text"), F.col("doc_id") % 8)
    found = table(spark, sf, "documents").select("doc_id", providers.recognised(provider, payload).alias("r"))
    return found.select("doc_id", F.md5("r.content").alias("content"), "r.strength", F.col("r.markdown").isNotNull().alias("is_markdown"))


@query("M16 A6 T7 T8 V6", with_ctes("""SELECT p.key AS item_key, CASE WHEN p.doc_id % 7 = 0 THEN 'skipped' WHEN a.key IS NULL THEN 'error: no PDF attachment found' WHEN a.doc_id % 3 = 0 THEN 'error: broken' ELSE 'ok' END AS status,
  CASE WHEN p.doc_id % 7 <> 0 AND a.doc_id % 3 <> 0 THEN 1 ELSE 0 END AS chunks FROM items p LEFT JOIN items a ON a.parent_key = p.key AND a.item_type = 'attachment' AND (a.path LIKE '%.pdf' OR a.content_type = 'application/pdf') WHERE p.parent_key IS NULL""", ITEMS))
def ocr_job(spark, sf):
    own = items(spark, sf)
    top = own.where("parent_key IS NULL")
    attachments = own.where("item_type = 'attachment'")
    line = F.regexp_replace(F.concat(F.lit("page "), F.col("doc_id").cast("string")), "#", "")
    response = F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct(line.alias("md_results"))))
    payloads = attachments.select(F.col("key").alias("attachment_key"), F.lit("glm").alias("provider"), response.alias("payload"), F.when(F.col("doc_id") % 3 == 0, "broken").alias("error"))
    return jobs.ocr_job(top, attachments, payloads, top.where("doc_id % 7 = 0").select("key"))[2]


@query("M17 R1 A7 X13", with_ctes("SELECT key AS item_key, CASE WHEN doc_id % 6 = 0 OR doc_id % 4 = 1 THEN 'skipped' ELSE 'ok' END AS status FROM items WHERE parent_key IS NULL", ITEMS))
def index_job(spark, sf):
    """An index over a store that already has every sixth item; every fourth item has no text."""
    own = items(spark, sf).where("parent_key IS NULL")
    stage = Stages(spark, "index")
    text = own.select("key", F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit("# A\n\n"), "title")).alias("text"))
    old, first = jobs.index_job(own.where("doc_id % 6 = 0"), text, put=stage.put, dim=16, rebuild=True)
    old, read = stage.put(old, "old"), stage.put(first.where("status = 'ok'").select(F.col("item_key").alias("key")), "read")
    old = old.unionByName(own.where("doc_id % 6 = 0 AND doc_id % 4 = 1").select(F.col("key").alias("item_key"), F.lit("m").alias("model")), allowMissingColumns=True)
    report = jobs.index_job(own, text, old, put=stage.put, done=read, dim=16)[1]
    done = old.select("item_key").distinct().withColumn("done", F.lit(True))
    return report.join(done, "item_key", "left").select("item_key", F.when(F.col("done"), "skipped").otherwise(F.col("status")).alias("status"))


def _rich(spark, sf):
    """Each conversation as one page: a title, short texts of its turns, a table and a figure."""
    c = table(spark, sf, "conversations")
    block = lambda kind, text, caption: F.struct(F.lit(kind).alias("type"), text.alias("text"), caption.alias("caption"))
    none, conv = F.lit(None).cast("string"), F.col("conv_id").cast("string")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(F.lit("text").alias("type"), F.concat(t["role"], F.lit(" "), t["turn"].cast("string")).alias("text"), none.alias("caption")))
    own = c.groupBy("conv_id").agg(turns.alias("turns"))
    page = F.concat(F.array(block("title", F.concat(F.lit("T"), conv), none)), F.col("turns"), F.array(block("table", F.lit("a|b"), F.lit("cap")), block("image", F.lit("seen"), none), block("heading", F.lit("End"), none), block("text", F.lit("last"), none)))
    return own.select(F.concat(F.lit("A"), conv).alias("attachment_key"), F.lit("I").alias("item_key"), F.lit("p").alias("provider"), F.to_json(F.struct(page.alias("blocks"))).alias("payload"))


_TURNS = "t AS (SELECT conv_id, count(*) AS n, string_agg(role || ' ' || CAST(turn AS VARCHAR), chr(10) || chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id)"


@query("T8 A9 W2 P9", f"WITH {_TURNS} SELECT 'A' || CAST(conv_id AS VARCHAR) || ':c0' AS chunk_id, 'T' || CAST(conv_id AS VARCHAR) AS section_heading, md5(said || chr(10) || chr(10) || 'a|b' || chr(10) || chr(10) || 'seen') AS digest, CAST(n + 2 AS INTEGER) AS n_blocks, 'paragraph,table,figure' AS types, 'A' || CAST(conv_id AS VARCHAR) || ':p1:b' || CAST(n + 1 AS VARCHAR) || '=table/cap;A' || CAST(conv_id AS VARCHAR) || ':p1:b' || CAST(n + 2 AS VARCHAR) || '=figure/seen' AS evidence FROM t UNION ALL SELECT 'A' || CAST(conv_id AS VARCHAR) || ':c1', 'End', md5('last'), 1, 'paragraph', '' FROM t")
def merged_chunks(spark, sf):
    rows = blocks.chunk_blocks(blocks.provider_blocks(_rich(spark, sf)), 100_000)
    refs = F.array_join(F.transform("evidence_refs", lambda e: F.concat(e["block_id"], F.lit("="), e["type"], F.lit("/"), F.coalesce(e["caption"], F.lit("")))), ";")
    return rows.select("chunk_id", "section_heading", F.md5("text").alias("digest"), F.size("block_ids").alias("n_blocks"), F.array_join("block_types", ",").alias("types"), refs.alias("evidence"))


@query("X18 T5", f"WITH {_TURNS} SELECT 'A' || CAST(conv_id AS VARCHAR) || ':p1:b' || CAST(n + 1 AS VARCHAR) AS block_id, 'cap' AS caption FROM t UNION ALL SELECT 'A' || CAST(conv_id AS VARCHAR) || ':p1:b' || CAST(n + 2 AS VARCHAR), 'seen' FROM t")
def block_captions(spark, sf):
    return blocks.provider_blocks(_rich(spark, sf)).where("caption IS NOT NULL").select("block_id", "caption")


@query("K11", "SELECT doc_id, md5('<h1>OCR: ' || lang || '</h1>' || chr(10) || '<p>glm</p>' || chr(10) || '<hr/>' || chr(10) || text) AS note FROM documents")
def ocr_notes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(exports.ocr_note(F.col("lang"), F.lit("glm"), F.col("text"))).alias("note"))


@query("W8 U6 S20", "SELECT 'src' || CAST(label AS VARCHAR) AS source, vec_id, coalesce(lag(vec_id // 3) OVER (PARTITION BY label ORDER BY vec_id) = vec_id // 3, false) AS stuck FROM embeddings")
def page_progress(spark, sf):
    own = table(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"), "vec_id", F.floor(F.col("vec_id") / 3).alias("digest"))
    found = lookups.changed_between(own, "source", ["vec_id"])
    return found.select("source", "vec_id", F.coalesce(F.col("before") == F.col("digest"), F.lit(False)).alias("stuck"))


_ASKED = "the nation and the union"


@query("O10 O6 V2", f"""WITH {_cells(f'sum({_SIGNED} * (1 + ln(n))) AS x')},
asked AS (SELECT h % 32 AS cell, sum({_SIGNED}) AS y FROM (SELECT CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT unnest(string_split('{_ASKED}', ' ')) AS t)) GROUP BY ALL),
scored AS (SELECT doc_id, sum(x * coalesce(y, 0)) / sqrt(nullif(sum(x * x), 0)) / (SELECT sqrt(sum(y * y)) FROM asked) AS s FROM cells LEFT JOIN asked USING (cell) GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS chunk_id, round(coalesce(s, 0), 4) AS score FROM documents d LEFT JOIN scored USING (doc_id) ORDER BY round(coalesce(s, 0), 6) DESC, chunk_id LIMIT 10""")
def text_search(spark, sf):
    """A text query embedded in its role against embedded documents: the ten best."""
    from lectern.functions.embed import create_embedder

    own = with_vectors(table(spark, sf, "documents").select(F.col("source").alias("item_key"), F.col("doc_id").cast("string").alias("chunk_id"), "text"), dim=32)
    wanted = create_embedder("hashing", dim=32).embed_query(_ASKED).tolist()
    return retrieval.vector_hits(own, wanted, 10).select("chunk_id", F.round("score", 4).alias("score"))
