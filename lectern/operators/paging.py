"""Sorting, slicing and totals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lectern.errors import InvalidParams

MOST_ROWS = 10_000


def rows_of(df: DataFrame) -> list[dict]:
    """The rows as dicts. More than MOST_ROWS are an error, not a shorter list: ask for a page."""
    rows = [r.asDict(recursive=True) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise InvalidParams(f"more than {MOST_ROWS} rows; ask for a page of them")
    return rows


@dataclass(frozen=True)
class Page:
    """A slice with the number of rows before slicing (counted when asked for)."""

    df: DataFrame
    whole: DataFrame
    limit: int | None
    offset: int

    @property
    def total(self) -> int:
        return self.whole.count()

    def envelope(self, name: str = "items") -> dict:
        return {name: rows_of(self.df), "total": self.total, "limit": self.limit, "offset": self.offset}


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> Page:
    """Rows offset..offset+limit of df in an order that must be total."""
    if offset < 0 or (limit is not None and limit < 0):
        raise InvalidParams("limit and offset can't be negative")
    cut = df.orderBy(*order)
    cut = cut.offset(offset) if offset else cut
    return Page(cut if limit is None else cut.limit(limit), df, limit, offset)


def list_items(items: DataFrame, sort: str = "dateAdded", direction: str = "desc", limit: int = 50, offset: int = 0) -> Page:
    """Sorted by date_modified only if asked for exactly, else date_added; anything but asc is descending; key breaks ties."""
    by = F.col("date_modified" if sort == "dateModified" else "date_added")
    return page(items, [by.asc_nulls_first() if direction == "asc" else by.desc_nulls_last(), F.col("key")], limit, offset)


def recent_items(items: DataFrame, kind: str = "added", limit: int = 20, offset: int = 0) -> Page:
    by = F.col("date_modified" if kind == "modified" else "date_added")
    return page(items, [by.desc_nulls_last(), F.col("key")], limit, offset)


def pages(df: DataFrame, order: list[Column], size: int = 100, most: int | None = None) -> Iterator[list[Row]]:
    """Consecutive pages of `size` rows up to the last one, which is shorter (or empty). More than `most` rows are an error.

    The frame is sorted once; its partitions come one after the other.
    """
    if not 0 < size <= MOST_ROWS:
        raise InvalidParams(f"page size must be 1 to {MOST_ROWS}")
    rows, before, n = df.orderBy(*order).toLocalIterator(prefetchPartitions=True), None, 0
    while True:
        page = list(islice(rows, size))
        n += len(page)
        if most is not None and n > most:
            raise InvalidParams(f"more than {most} rows")
        if page and page == before:
            raise InvalidParams("a page repeats the one before; the order isn't total")
        yield page
        if len(page) < size:
            return
        before = page


def concatenated(pages_of: Iterable[list[dict]], size: int) -> list[dict]:
    """The rows of pages up to the first short one; a page that repeats the one before is an error."""
    out: list[dict] = []
    before = None
    for page in pages_of:
        if page and page == before:
            raise InvalidParams("a page repeats the one before")
        out += page
        if len(page) < size:
            break
        before = page
    return out
