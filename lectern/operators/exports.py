"""Text exports by row templates: BibTeX, RIS, CSV, CSL-JSON, a numbered bibliography; hit envelopes; tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import EngineError
from lectern.functions.names import creator_name
from lectern.functions.text import citation_key, venue_of, year_of
from lectern.operators.paging import rows_of
from lectern.operators.ranks import numbered


def _names(sep: str) -> Column:
    return F.array_join(F.transform("creators", creator_name), sep)


def _field(name: str, value: Column, template: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.format_string(template, value))


def bibtex(items: DataFrame) -> DataFrame:
    """key, entry."""
    f = F.col("fields")
    lines = F.concat_ws(
        ",\n",
        _field("title", F.col("title"), "  title = {%s}"),
        _field("author", _names(" and "), "  author = {%s}"),
        _field("journal", venue_of(f), "  journal = {%s}"),
        _field("year", year_of(f["date"]).cast("string"), "  year = {%s}"),
        _field("doi", f["DOI"], "  doi = {%s}"),
    )
    kind = F.when(F.col("item_type") == "journalArticle", "article").when(F.col("item_type") == "book", "book").otherwise("misc")
    return items.select("key", F.format_string("@%s{%s,\n%s\n}", kind, citation_key(f, F.col("creators")), lines).alias("entry"))


def ris(items: DataFrame) -> DataFrame:
    f = F.col("fields")
    kind = F.when(F.col("item_type") == "journalArticle", "JOUR").when(F.col("item_type") == "book", "BOOK").otherwise("GEN")
    authors = F.array_join(F.transform("creators", lambda c: F.concat(F.lit("AU  - "), creator_name(c))), "\n")
    lines = F.concat_ws("\n", F.concat(F.lit("TY  - "), kind), _field("TI", F.col("title"), "TI  - %s"), F.when(F.size("creators") > 0, authors), _field("PY", year_of(f["date"]).cast("string"), "PY  - %s"), _field("JO", venue_of(f), "JO  - %s"), _field("DO", f["DOI"], "DO  - %s"), F.lit("ER  - "))
    return items.select("key", lines.alias("entry"))


def csv_rows(items: DataFrame) -> DataFrame:
    f = F.col("fields")
    row = F.struct(F.col("key"), F.col("item_type"), F.col("title"), _names("; ").alias("authors"), year_of(f["date"]).alias("year"), F.coalesce(f["DOI"], F.lit("")).alias("doi"))
    return items.select("key", F.to_csv(row, {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("entry"))


def csl_json(items: DataFrame) -> DataFrame:
    f = F.col("fields")
    people = F.transform("creators", lambda c: F.struct(c["last_name"].alias("family"), c["first_name"].alias("given")))
    row = F.struct(F.col("key").alias("id"), F.when(F.col("item_type") == "journalArticle", "article-journal").otherwise("document").alias("type"), F.col("title"), people.alias("author"), year_of(f["date"]).alias("year"), F.nullif(f["DOI"], F.lit("")).alias("DOI"))
    return items.select("key", F.to_json(row).alias("entry"))


def bibliography(items: DataFrame) -> DataFrame:
    """n, key, entry: a numbered list in key order, in the manner of a numeric standard; of any length."""
    f = F.col("fields")
    kind = F.when(F.col("item_type") == "journalArticle", "[J]").otherwise("[Z]")
    body = F.concat(_names(", "), F.lit(". "), F.col("title"), kind, F.coalesce(F.concat(F.lit(". "), venue_of(f)), F.lit("")), F.coalesce(F.concat(F.lit(", "), year_of(f["date"]).cast("string")), F.lit("")), F.lit("."))
    rows = numbered(items.select("key", body.alias("__b")), ["key"], "__n").withColumn("n", F.col("__n") + 1)
    return rows.select("n", "key", F.format_string("[%d] %s", "n", "__b").alias("entry"))


def export(entries: DataFrame, fmt: str, joiner: str = "\n\n") -> dict:
    """The envelope of an export: format, content in key order, count."""
    rows = rows_of(entries.orderBy("key").select("entry"))
    return {"format": fmt, "content": joiner.join(r["entry"] for r in rows), "count": len(rows)}


def hits_envelope(hits: DataFrame) -> dict:
    rows = [json.loads(r["line"]) for r in rows_of(hits.select(F.to_json(F.struct(*hits.columns)).alias("line")))]
    return {"hits": rows, "total": len(rows)}


def hit_lines(hits: DataFrame) -> DataFrame:
    """line: each hit as compact JSON with its columns by name; nulls are left out."""
    return hits.select(F.to_json(F.struct(*sorted(hits.columns))).alias("line"))


def envelopes(rows: DataFrame, errors: Mapping[str, int]) -> DataFrame:
    """id, envelope: the JSON-RPC answer of each row (id, result as JSON, error as the name of a kind, message). errors: code of each kind."""
    codes = F.create_map(*[F.lit(x) for kv in errors.items() for x in kv])
    code = F.coalesce(F.try_element_at(codes, F.col("error")), F.lit(EngineError.code))
    head = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2))
    failed = F.concat(head, F.lit(',"error":'), F.to_json(F.struct(code.alias("code"), F.coalesce("message", F.lit("")).alias("message"))), F.lit("}"))
    return rows.select("id", F.when(F.col("error").isNotNull(), failed).otherwise(F.concat(head, F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))).alias("envelope"))


def key_union(rows: DataFrame, json_col: str = "value", order: str = "place") -> DataFrame:
    """key, first, n: the keys of all rows (place, value as JSON objects), where each comes first, and how many rows have it."""
    keys = rows.select(order, F.posexplode(F.json_object_keys(json_col)).alias("__at", "key"))
    return keys.groupBy("key").agg(F.min(F.struct(F.col(order).alias("place"), F.col("__at").alias("at"))).alias("first"), F.count("*").alias("n"))


def table(rows: list[dict]) -> str:
    """Rows as a text table with the union of keys in first-seen order; JSON if a value is nested; null is empty."""
    if any(isinstance(v, (dict, list)) for r in rows for v in r.values()):
        return json.dumps(rows, ensure_ascii=False, indent=2)
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [names, *[["" if r.get(k) is None else str(r[k]) for k in names] for r in rows]]
    widths = [max(len(row[k]) for row in cells) for k in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in cells)


def ocr_note(title: Column, meta: Column, body_html: Column) -> Column:
    return F.concat(F.lit("<h1>OCR: "), title, F.lit("</h1>\n<p>"), meta, F.lit("</p>\n<hr/>\n"), body_html)


def push_payload(flat: DataFrame) -> DataFrame:
    """flat (item_type, creators, tags as names, and columns of fields) to item_type, fields, creators, tags: empty fields go."""
    own = {"ref", "item_type", "creators", "tags", "collections", "attachments", "relations", "notes", "id", "key", "version"}
    names = [c for c in flat.columns if c not in own]
    fields = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])), lambda k, v: v.isNotNull() & (v != ""))
    kept = [c for c in ("ref", "tags") if c in flat.columns]
    creators = F.transform("creators", lambda c: F.struct(F.coalesce(c["first_name"], F.lit("")).alias("first_name"), F.coalesce(c["last_name"], F.lit("")).alias("last_name"), F.coalesce(c["creator_type"], F.lit("author")).alias("creator_type")))
    return flat.select(*kept, F.coalesce("item_type", F.lit("journalArticle")).alias("item_type"), fields.alias("fields"), *([creators.alias("creators")] if "creators" in flat.columns else []))
