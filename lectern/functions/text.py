"""Text functions, Column to Column. White space means Unicode white space unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates terms of a query besides white space.
TERM_SEPARATORS = ",;，；、"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[none_if_empty(F.col(x) if isinstance(x, str) else x) for x in xs])


def normalized_name(x: Column) -> Column:
    """Lower case, white space runs collapsed to a space, trimmed."""
    return F.lower(trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms in order; a query of separators only is one term."""
    parts = F.array_distinct(F.filter(F.split(F.lower(query), rf"(?U)[\s{TERM_SEPARATORS}]+"), lambda t: t != ""))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lower(query)))


def lexical_score(text: Column, query: Column) -> Column:
    """1 for the whole trimmed query as a substring and 1 for each term that is one; 0 for an empty text or query."""
    whole = trim(F.lower(F.coalesce(query, F.lit(""))))

    def score(hay: Column) -> Column:
        terms = F.aggregate(query_terms(whole), F.lit(0), lambda n, t: n + F.contains(hay, t).cast("int"))
        return F.when((hay == "") | (whole == ""), F.lit(0)).otherwise(terms + F.contains(hay, whole).cast("int"))

    # an array of one element, so that a text is lower-cased once and not once a term
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), score), 1)


def year_of(date: Column) -> Column:
    """The first standalone year from 1800 to 2199 as an int, else null."""
    return F.regexp_extract(F.coalesce(date, F.lit("")), r"\b(?:18|19|20|21)\d\d\b", 0).try_cast("int")


def venue_of(fields: Column) -> Column:
    """The first filled of the container titles."""
    return first_filled(*[fields[k] for k in ("publicationTitle", "journalAbbreviation", "conferenceName", "publisher")])


def citation_key(fields: Column, creators: Column) -> Column:
    """The key given in `extra`, else last name (or Unknown) and year."""
    given = none_if_empty(F.regexp_extract(F.coalesce(fields["extra"], F.lit("")), r"(?i)Citation Key:\s*(\S+)", 1))
    first = F.get(creators, F.lit(0))
    last = F.coalesce(first_filled(first["last_name"], first["name"]), F.lit("Unknown"))
    return F.coalesce(given, F.concat(last, F.coalesce(year_of(fields["date"]).cast("string"), F.lit(""))))


def clean_path(x: Column) -> Column:
    """Without double quote characters and guillemets."""
    return F.translate(x, '"“”«»', "")


def safe_key(x: Column) -> Column:
    return F.translate(x, "/\\", "__")


def strip_tags(x: Column) -> Column:
    """Without anything from < to the next >; entities stay."""
    return F.regexp_replace(x, "<[^>]+>", "")


def authors_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ";"), trim), lambda a: a != "")


def author_line(creators: Column) -> Column:
    """Last names (or single names) joined by semicolons."""
    return F.array_join(F.filter(F.transform(creators, lambda c: first_filled(c["last_name"], c["name"])), lambda n: n.isNotNull()), "; ")


def item_uri(key: Column) -> Column:
    return F.concat(F.lit("library://items/"), key)


#: Fixed values of the block model.
BLOCK_TYPES = ("heading", "paragraph", "table", "figure", "equation", "caption", "footnote", "header", "footer", "reference", "unknown")
BLOCK_ALIASES = {"text": "paragraph", "title": "heading", "image": "figure"}


def block_type(x: Column) -> Column:
    """Lower case; aliases resolved; null is a paragraph, anything else unlisted is unknown."""
    low = F.lower(x)
    alias = F.when(low == "text", "paragraph").when(low == "title", "heading").when(low == "image", "figure").otherwise(low)
    return F.when(F.coalesce(x, F.lit("")) == "", "paragraph").when(alias.isin(*BLOCK_TYPES), alias).otherwise("unknown")


def closest(name: Column, known: list[str], most: int = 5) -> Column:
    """The known name with the least edit distance (ignoring case), the first of equals; null if none is within `most`."""
    near = F.filter(
        F.array(*[F.struct(F.levenshtein(F.lower(name), F.lit(k.lower()), most).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(known)]),
        lambda x: x["d"] >= 0,
    )
    return F.array_min(near)["name"]


def floor_kb(size: Column) -> Column:
    return F.floor(size / 1024)


def condition_of(text: Column) -> Column:
    """`field op value` as a struct: cut at the first two white-space runs."""
    parts = F.split(trim(text), r"\s+", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("field"), F.get(parts, F.lit(1)).alias("op"), F.get(parts, F.lit(2)).alias("value"))
