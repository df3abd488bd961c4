"""Predicates: condition lists, searches, validations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.functions.names import creator_name
from lectern.functions.text import normalized_name, year_of
from lectern.operators.textindex import NgramIndex

CORE = {"title": "title", "itemType": "item_type", "dateAdded": "date_added", "dateModified": "date_modified", "note": "note", "key": "key"}
#: Operators of a condition.
OPERATORS = ("is", "isNot", "contains", "doesNotContain", "isAfter", "isBefore", "beginsWith")


def field(name: str) -> Column:
    """A condition's field: a core column, tags, creators or an entry of the field map."""
    if name == "tag":
        return F.transform("tags", lambda t: t["tag"])
    if name in ("creator", "author"):
        return F.transform("creators", creator_name)
    if name == "year":
        return year_of(F.col("fields")["date"]).cast("string")
    return F.col(CORE[name]) if name in CORE else F.col("fields")[name]


def condition(name: str, op: str, value: str) -> Column:
    """One predicate; contains ignores case; on tags and creators any element may fit (isNot: none does)."""
    if op not in OPERATORS:
        raise InvalidParams(f"unknown operator: {op}")
    if op in ("isNot", "doesNotContain"):
        return ~F.coalesce(condition(name, "is" if op == "isNot" else "contains", value), F.lit(False))

    def fits(x: Column) -> Column:
        if op == "is":
            return x.cast("string") == value
        if op == "contains":
            return F.contains(F.lower(x.cast("string")), F.lit(value.lower()))
        if op == "beginsWith":
            return F.startswith(F.lower(x.cast("string")), F.lit(value.lower()))
        return x.cast("string") > value if op == "isAfter" else x.cast("string") < value

    found = field(name)
    many = name in ("tag", "creator", "author")
    return F.exists(found, fits) if many else fits(found)


def advanced(items: DataFrame, conditions: Iterable[Mapping[str, str]], join: str = "and", no_children: bool = True) -> DataFrame:
    """Items that meet all (or any) conditions; a condition's operator may be named op or operator."""
    parts = [F.coalesce(condition(c["field"], c.get("op") or c["operator"], c["value"]), F.lit(False)) for c in conditions]
    if join not in ("and", "or"):
        raise InvalidParams(f"unknown join: {join}")
    own = items.where(F.col("parent_key").isNull()) if no_children else items
    return own.where(reduce((lambda a, b: a & b) if join == "and" else (lambda a, b: a | b), parts)) if parts else own


def quick_search(items: DataFrame, query: str, index: NgramIndex | None = None) -> DataFrame:
    """Title, a creator or the year contains the query; with an index of quick_values by looking it up."""
    if index is not None:
        return items.where(F.col("parent_key").isNull()).join(index.keys(query.lower()), "key", "left_semi")
    return advanced(items, [{"field": f, "op": "contains", "value": query} for f in ("title", "creator", "year")], "or")


def quick_values(items: DataFrame) -> DataFrame:
    """key, value: what quick_search looks in, in lower case, for an index."""
    values = F.concat(F.array(field("title"), field("year")), field("creator"))
    return items.select("key", F.explode(values).alias("value")).select("key", F.lower("value").alias("value"))


def fulltext_search(items: DataFrame, texts: DataFrame, query: str, index: NgramIndex | None = None) -> DataFrame:
    """Items with a text, of their own or of a child, that contains the query. texts: key, content, and parent_key where a child's.

    index, if given, is one of the texts' keys and lower-case contents.
    """
    hits = texts.where(F.contains(F.lower("content"), F.lit(query.lower()))) if index is None else texts.join(index.keys(query.lower()), "key", "left_semi")
    return items.join(hits.select(F.coalesce("parent_key", "key").alias("key")), "key", "left_semi")


def by_tag(items: DataFrame, tag: str) -> DataFrame:
    return items.where(F.exists("tags", lambda t: t["tag"] == tag))


def by_identifier(items: DataFrame, doi: str | None = None, isbn: str | None = None, issn: str | None = None) -> DataFrame:
    """Top-level items with all identifiers given; all top-level items if none is."""
    wanted = {"DOI": doi, "ISBN": isbn, "ISSN": issn}
    return advanced(items, [{"field": k, "op": "is", "value": v} for k, v in wanted.items() if v])


def note_search(items: DataFrame, query: str, index: NgramIndex | None = None) -> DataFrame:
    """Notes that contain the query. index, if given, is one of the notes' keys and lower-case texts."""
    if index is not None:
        return items.where(F.col("item_type") == "note").join(index.keys(query.lower()), "key", "left_semi")
    return items.where((F.col("item_type") == "note") & F.contains(F.lower("note"), F.lit(query.lower())))


PDF_TYPES = ("application/pdf", "application/x-pdf")


def is_pdf(content_type: Column, path: Column) -> Column:
    return F.coalesce(F.lower(content_type).isin(*PDF_TYPES), F.lit(False)) | F.coalesce(F.endswith(F.lower(path), F.lit(".pdf")), F.lit(False))


def pdf_magic(content: Column) -> Column:
    """Whether bytes begin as a PDF does; null counts as no."""
    return F.coalesce(F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "utf-8"), F.lit(False))


def has_pdf(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """items with has_pdf."""
    own = attachments.where(is_pdf(F.col("content_type"), F.col("path"))).select(F.col("parent_key").alias("key")).distinct().withColumn("has_pdf", F.lit(True))
    return items.join(own, "key", "left").withColumn("has_pdf", F.coalesce("has_pdf", F.lit(False)))


def missing_pdfs(items: DataFrame, attachments: DataFrame, limit: int = 0) -> DataFrame:
    """Items without a PDF in key order; a limit above 0 stops at so many."""
    missing = has_pdf(items, attachments).where(~F.col("has_pdf")).orderBy("key")
    return missing.limit(limit) if limit > 0 else missing


def with_ocr(items: DataFrame, children: DataFrame, artifacts: DataFrame) -> DataFrame:
    """items with has_ocr: a chunk artifact, or a note tagged ocr. artifacts: item_key."""
    notes = children.where((F.col("item_type") == "note") & F.exists("tags", lambda t: t["tag"] == "ocr")).select(F.col("parent_key").alias("key"))
    done = notes.union(artifacts.select(F.col("item_key").alias("key"))).distinct().withColumn("has_ocr", F.lit(True))
    return items.join(done, "key", "left").withColumn("has_ocr", F.coalesce("has_ocr", F.lit(False)))


def name_matches(name: Column, wanted: Column) -> Column:
    """Normalised contains."""
    return F.contains(normalized_name(name), normalized_name(wanted))


#: Fixed values of annotations.
ANNOTATION_TYPES = ("highlight", "underline", "note", "image", "ink")
TEXT_ANNOTATIONS = ("highlight", "underline")


def annotation_error(kind: Column, text: Column, color: Column) -> Column:
    """Message of the first rule that fails, null if none does."""
    return (
        F.when(kind.isNull() | ~kind.isin(*ANNOTATION_TYPES), F.concat(F.lit("unknown annotation type: "), F.coalesce(kind, F.lit("null"))))
        .when((F.coalesce(text, F.lit("")) != "") & ~kind.isin(*TEXT_ANNOTATIONS), F.concat(F.lit("no text on annotations of type "), kind))
        .when(color.isNotNull() & ~color.rlike(r"\A#[0-9a-fA-F]{6}\z"), F.concat(F.lit("color isn't #RRGGBB: "), color))
    )


def first_unknown(keys: Iterable[str], known: Iterable[str]) -> str | None:
    allowed = set(known)
    return next((k for k in keys if k not in allowed), None)
