"""The driver's tables seen as a library, in Spark and as SQL common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def item_key(doc_id: Column) -> Column:
    return F.concat(F.lit("I"), F.lpad(doc_id.cast("string"), 8, "0"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """documents as items, titled by the first line of their text; labels with toxic = 1 as the trash."""
    docs = table(spark, sf, "documents")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("deleted", F.lit(True))
    d = F.col("doc_id")
    kind = F.when(d % 10 == 0, "note").when(d % 10 == 1, "attachment").when(d % 10 == 2, "book").otherwise("journalArticle")
    fields = F.create_map(
        F.lit("DOI"), F.when(d % 4 == 0, F.concat(F.lit("10.1000/"), (d % 300).cast("string"))).otherwise(""),
        F.lit("date"), F.concat((1980 + d % 45).cast("string"), F.lit("-0"), (1 + d % 9).cast("string"), F.lit("-01")),
        F.lit("publicationTitle"), F.col("source"),
        F.lit("extra"), F.when(d % 50 == 3, F.concat(F.lit("Citation Key: ck"), d.cast("string"))).otherwise(""),
    )
    creator = F.struct(F.concat(F.lit("Ana"), (d % 7).cast("string")).alias("first_name"), F.concat(F.upper("lang"), (d % 50).cast("string")).alias("last_name"), F.lit(None).cast("string").alias("name"), F.lit("author").alias("creator_type"))
    tags = F.array(F.struct(F.col("lang").alias("tag"), F.lit(0).alias("type")), F.struct(F.col("source").alias("tag"), F.lit(1).alias("type")))
    pdf = d % 20 == 1
    return docs.join(toxic, "doc_id", "left").select(
        item_key(d).alias("key"), kind.alias("item_type"), F.substring_index("text", "\n", 1).alias("title"),
        (F.lit("2020-01-01").cast("date") + ((d * 7919) % 1000).cast("int")).alias("date_added"),
        (F.lit("2021-01-01").cast("date") + ((d * 104729) % 1000).cast("int")).alias("date_modified"),
        fields.alias("fields"), F.when(kind == "note", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))).alias("note"),
        F.array(creator).alias("creators"), tags.alias("tags"), F.array(F.concat(F.lit("N"), (d % 25).cast("string"))).alias("collections"),
        F.when(kind.isin("note", "attachment"), item_key(d - d % 10 + 3)).alias("parent_key"), F.lit(1).alias("library_id"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"), F.when(kind == "attachment", F.when(pdf, "application/pdf").otherwise("text/html")).alias("content_type"),
        F.when(kind == "attachment", F.concat(F.lit("f"), d.cast("string"), F.when(pdf | (d % 40 == 11), ".pdf").otherwise(".html"))).alias("path"),
        "doc_id", "text", "lang", "source",
    )


ITEMS = """items AS (
  SELECT 'I' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS key, d.doc_id, d.text, d.lang, d.source,
    CASE d.doc_id % 10 WHEN 0 THEN 'note' WHEN 1 THEN 'attachment' WHEN 2 THEN 'book' ELSE 'journalArticle' END AS item_type,
    split_part(d.text, chr(10), 1) AS title,
    CAST(DATE '2020-01-01' + CAST((d.doc_id * 7919) % 1000 AS INTEGER) AS DATE) AS date_added,
    CAST(DATE '2021-01-01' + CAST((d.doc_id * 104729) % 1000 AS INTEGER) AS DATE) AS date_modified,
    CASE WHEN d.doc_id % 4 = 0 THEN '10.1000/' || CAST(d.doc_id % 300 AS VARCHAR) ELSE '' END AS doi,
    CAST(1980 + d.doc_id % 45 AS VARCHAR) || '-0' || CAST(1 + d.doc_id % 9 AS VARCHAR) || '-01' AS date,
    1980 + d.doc_id % 45 AS year,
    CASE WHEN d.doc_id % 50 = 3 THEN 'ck' || CAST(d.doc_id AS VARCHAR) ELSE upper(d.lang) || CAST(d.doc_id % 50 AS VARCHAR) || CAST(1980 + d.doc_id % 45 AS VARCHAR) END AS citation_key,
    CASE WHEN d.doc_id % 10 = 0 THEN '<p>' || d.text || '</p>' END AS note,
    'Ana' || CAST(d.doc_id % 7 AS VARCHAR) || ' ' || upper(d.lang) || CAST(d.doc_id % 50 AS VARCHAR) AS author,
    CASE WHEN d.doc_id % 10 < 2 THEN 'I' || lpad(CAST(d.doc_id - d.doc_id % 10 + 3 AS VARCHAR), 8, '0') END AS parent_key,
    coalesce(t.doc_id IS NOT NULL, false) AS deleted,
    CASE WHEN d.doc_id % 10 = 1 THEN CASE WHEN d.doc_id % 20 = 1 THEN 'application/pdf' ELSE 'text/html' END END AS content_type,
    CASE WHEN d.doc_id % 10 = 1 THEN 'f' || CAST(d.doc_id AS VARCHAR) || CASE WHEN d.doc_id % 20 = 1 OR d.doc_id % 40 = 11 THEN '.pdf' ELSE '.html' END END AS path
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id
)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id")
    a = docs.select(F.concat(F.lit("N"), (d % 25).cast("string")).alias("collection_key"), item_key(d).alias("item_key"))
    b = docs.where(d % 3 == 0).select(F.concat(F.lit("N"), ((d * 7) % 25).cast("string")).alias("collection_key"), item_key(d).alias("item_key"))
    return a.union(b).distinct()


MEMBERS = """members AS (
  SELECT 'N' || CAST(doc_id % 25 AS VARCHAR) AS collection_key, 'I' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS item_key FROM documents
  UNION SELECT 'N' || CAST((doc_id * 7) % 25 AS VARCHAR), 'I' || lpad(CAST(doc_id AS VARCHAR), 8, '0') FROM documents WHERE doc_id % 3 = 0
)"""


def collections(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as top collections, nations as theirs."""
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_key"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_key"))
    return r.union(n).withColumns({"library_id": F.lit(1), "version": F.lit(1)})


COLLECTIONS = """collections AS (
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, CAST(NULL AS VARCHAR) AS parent_key FROM region
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), n_name, 'R' || CAST(n_regionkey AS VARCHAR) FROM nation
)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks of their source."""
    return table(spark, sf, "documents").select(F.col("source").alias("item_key"), item_key(F.col("doc_id")).alias("chunk_id"), "text", "doc_id")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Full texts of every second attachment."""
    own = items(spark, sf).where((F.col("item_type") == "attachment") & (F.col("doc_id") % 20 == 1))
    return own.select("key", "parent_key", F.col("text").alias("content"), F.length("text").alias("indexed_chars"), F.length("text").alias("total_chars"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("item_key"), F.concat(F.lit("V"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("chunk_id"), F.col("embedding").alias("vector"), "vec_id", "label")


def markdown_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a markdown document: a heading with the role and the text of each turn."""
    c = table(spark, sf, "conversations")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("# "), t["role"], F.lit("\n\n"), t["text"]))
    return c.groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("text"))


def with_ctes(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
