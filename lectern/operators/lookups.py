"""Joins by key, with the checks that lookups need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, NotFound
from lectern.functions.text import normalized_name
from lectern.operators.filters import is_pdf
from lectern.operators.ranks import with_previous
from lectern.operators.scans import CHILD_TYPES, first_per_group, live
from lectern.operators.textindex import NgramIndex


def looks_like_id(text: str) -> bool:
    """A numeric string is an id only if it is written as numbers are."""
    return text.isascii() and text.isdigit() and str(int(text)) == text


def require(spark: SparkSession, table: DataFrame, keys: list[str], what: str = "item") -> DataFrame:
    """Rows of the keys in the order given, repeats kept; the first key without a row is an error."""
    wanted = spark.createDataFrame(list(enumerate(keys)), "pos int, key string")
    missing = wanted.join(table.select("key"), "key", "left_anti").orderBy("pos").first()
    if missing:
        raise NotFound(f"{what} not found: {missing['key']}")
    return in_order(wanted, table)


def in_order(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """wanted: pos, key. Rows of table by pos; keys without a row are left out."""
    return wanted.join(table, "key").orderBy("pos")


def children(parents: DataFrame, items: DataFrame, item_type: str | None = None) -> DataFrame:
    """Live child rows of the parents' keys."""
    own = items if item_type is None else items.where(F.col("item_type") == item_type)
    return live(own).join(parents.select(F.col("key").alias("parent_key")).distinct(), "parent_key", "left_semi")


def collection_items(members: DataFrame, items: DataFrame, collection_key: str, trash: DataFrame | None = None) -> DataFrame:
    own = members.where(F.col("collection_key") == collection_key).select(F.col("item_key").alias("key")).distinct()
    return live(items, trash).join(own, "key", "left_semi")


def subcollections(collections: DataFrame, key: str) -> DataFrame:
    return collections.where(F.col("parent_key") == key)


#: Pairs of a reference and a name that are compared without an index.
PAIRS = 1_000_000


def resolve_collections(wanted: DataFrame, collections: DataFrame, index: NgramIndex | None = None, pairs: int = PAIRS) -> DataFrame:
    """For each reference in wanted (ref): ref, status (hit, ambiguous, missing), key of a hit, n candidates.

    Exact name first, if exactly one has it; else all whose normalised name contains the normalised reference. References
    are joined to names by equality first. Those left over are looked up in an index of keys and normalised names, which is
    built here unless one is given or references times names are few.
    """
    names = collections.select("key", "name")
    wanted = wanted.distinct()
    exact = wanted.join(names, wanted.ref == names.name).groupBy("ref").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    rest = wanted.join(exact, "ref", "left_anti")
    if index is None and wanted.count() * names.count() > pairs:
        index = NgramIndex.build(wanted.sparkSession, names.select("key", normalized_name(F.col("name")).alias("value")))
    if index is None:
        fuzzy = rest.join(names, F.contains(normalized_name(F.col("name")), normalized_name(F.col("ref"))), "left").groupBy("ref").agg(F.count("key").alias("n"), F.min("key").alias("key"))
    else:
        rest = rest.withColumn("term", normalized_name(F.col("ref")))
        found = index.counts(rest.select("term"))
        fuzzy = rest.join(found, "term", "left").select("ref", F.coalesce("n", F.lit(0)).alias("n"), "key")
    status = F.when(F.col("n") == 1, "hit").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return exact.unionByName(fuzzy).select("ref", status.alias("status"), F.when(F.col("n") == 1, F.col("key")).alias("key"), F.col("n").alias("candidates"))


def scope_items(items: DataFrame, members: DataFrame, collections: DataFrame, keys: list[str] | None = None, collection: str | None = None) -> DataFrame:
    """Items to search: keys win over a collection name; notes and attachments are left out; unknown keys are skipped."""
    own = live(items.where(~F.col("item_type").isin(*CHILD_TYPES)))
    if keys:
        return own.where(F.col("key").isin(*keys))
    if collection is None:
        return own
    inside = members.join(collections.where(F.col("name") == collection).select(F.col("key").alias("collection_key")), "collection_key", "left_semi")
    return own.join(inside.select(F.col("item_key").alias("key")), "key", "left_semi")


def first_pdf(attachments: DataFrame) -> DataFrame:
    """The first PDF of each parent, by key."""
    return first_per_group(attachments.where(is_pdf(F.col("content_type"), F.col("path"))), "parent_key", ["key"])


def first_pdf_text(items: DataFrame, attachments: DataFrame, texts: DataFrame) -> DataFrame:
    """key, attachment_key, content, indexed_chars, total_chars: of the first PDF; defaults without one."""
    pdfs = first_pdf(attachments).select(F.col("parent_key").alias("key"), F.col("key").alias("attachment_key"))
    joined = items.select("key").join(pdfs, "key", "left").join(texts.withColumnRenamed("key", "attachment_key"), "attachment_key", "left")
    return joined.select("key", "attachment_key", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("indexed_chars", F.lit(0)).alias("indexed_chars"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"))


def related(items: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    own = relations.where(F.col("key_a") == key).select(F.col("key_b").alias("key")).distinct()
    return items.join(own, "key", "left_semi")


def find_duplicates_of(new: DataFrame, items: DataFrame, least_title: int = 10, put=lambda df, name: df) -> DataFrame:
    """new (with ref, doi, title) with dup_key: by DOI, else by exact title of at least least_title characters.

    put(df, name) writes a frame and reads it back. With it the joins have a shuffle of their own on both sides, which adaptive
    execution splits where one DOI or title holds many of the new rows.
    """
    by_doi = put(items.where(F.col("fields")["DOI"] != "").groupBy(F.col("fields")["DOI"].alias("doi")).agg(F.min("key").alias("doi_key")), "by_doi")
    by_title = put(items.where(F.length("title") >= least_title).groupBy("title").agg(F.min("key").alias("title_key")), "by_title")
    return new.join(by_doi, "doi", "left").join(by_title, "title", "left").select(*new.columns, F.coalesce("doi_key", "title_key").alias("dup_key"))


def zip_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks joined with vectors by (item_key, ordinal)."""
    return chunks.join(vectors, ["item_key", "ordinal"])


def check_zip(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """item_key, n_chunks, n_vectors of items whose counts differ."""
    a = chunks.groupBy("item_key").agg(F.count("*").alias("n_chunks"))
    b = vectors.groupBy("item_key").agg(F.count("*").alias("n_vectors"))
    both = a.join(b, "item_key", "full_outer").select("item_key", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))
    return both.where("n_chunks <> n_vectors")


def require_zip(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    bad = check_zip(chunks, vectors).first()
    if bad:
        raise InvalidParams(f"{bad['item_key']}: {bad['n_chunks']} chunks, {bad['n_vectors']} vectors")
    return zip_chunks(chunks, vectors)


def collection_keys(items: DataFrame, members: DataFrame, collections: DataFrame) -> DataFrame:
    """items with collection_keys, sorted; memberships of unknown collections are dropped."""
    own = members.join(collections.select(F.col("key").alias("collection_key")), "collection_key", "left_semi")
    own = own.groupBy(F.col("item_key").alias("key")).agg(F.sort_array(F.collect_set("collection_key")).alias("collection_keys"))
    return items.join(own, "key", "left").withColumn("collection_keys", F.coalesce("collection_keys", F.array().cast("array<string>")))


def changed_between(pages: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Rows (source, digest) with the digest of the source's page before; for checks that pages move on."""
    return with_previous(pages, [source], order, {"before": "digest"})


def require_id(spark: SparkSession, table: DataFrame, refs: list[str], what: str = "item", id_col: str = "id") -> DataFrame:
    """Rows of references in the order given: a number written as numbers are is an id, anything else a key. The first without a row is an error."""
    wanted = spark.createDataFrame([(k, int(r) if looks_like_id(r) else None, r) for k, r in enumerate(refs)], "pos int, ref_id long, ref string")
    found = wanted.where("ref_id IS NOT NULL").join(table, F.col("ref_id") == F.col(id_col)).select("pos", "ref", *table.columns)
    found = found.unionByName(wanted.where("ref_id IS NULL").join(table, F.col("ref") == F.col("key")).select("pos", "ref", *table.columns))
    missing = wanted.join(found.select("pos").distinct(), "pos", "left_anti").orderBy("pos").first()
    if missing:
        raise NotFound(f"{what} not found: {missing['ref']}")
    return found.orderBy("pos")


def kind_errors(rows: DataFrame, kind: str) -> DataFrame:
    """key, error: of the rows that aren't of that item type."""
    return rows.where(F.coalesce(F.col("item_type") != kind, F.lit(True))).select("key", F.concat(F.col("key"), F.lit(f" isn't of type {kind}")).alias("error"))


def require_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of that item type; a row of another one fails the query that reads it."""
    wrong = F.concat(F.col("key"), F.lit(f" isn't of type {kind}"))
    return rows.withColumn("item_type", F.when(F.col("item_type") == kind, F.col("item_type")).otherwise(F.raise_error(wrong).cast("string")))
