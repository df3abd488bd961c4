"""The library as one object: named methods over its tables, in the manner of a JSON-RPC service.

State is a set of DataFrames. Methods that read return DataFrames or pages; methods that change replace a table by the result of a
mutation. `call` takes a method's name and parameters, `handle` a JSON-RPC request or batch. Methods that need a network or a
desktop host (imports by identifier, PDF search, sync, window control) are listed as such and raise Unsupported.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import __version__
from lectern.errors import EngineError, InvalidParams, InvalidRequest, MethodNotFound, NotFound, envelope
from lectern.operators import aggregates, exports, filters, hierarchy, lookups, mutations, paging, retrieval, scans, setops
from lectern.schemas import ANNOTATION, CHUNK, COLLECTION, FULLTEXT, ITEM, MEMBERSHIP, RELATION, SAVED_SEARCH
from lectern.sources import config


class Unsupported(EngineError):
    """Needs a network or a desktop host."""


TABLES = {
    "items": ITEM,
    "collections": COLLECTION,
    "members": MEMBERSHIP,
    "relations": RELATION,
    "texts": FULLTEXT,
    "annotations": ANNOTATION,
    "searches": SAVED_SEARCH,
    "chunks": CHUNK,
}
OUTSIDE = (
    "items.addByDOI items.addByURL items.addByISBN items.addFromFile attachments.addByURL attachments.findPDF "
    "system.sync system.currentCollection system.switchLibrary system.reload"
).split()


def plain(x):
    """A result as plain values; frames of more rows than the page cap are an error."""
    if isinstance(x, paging.Page):
        return x.envelope()
    if isinstance(x, DataFrame):
        return paging.rows_of(x)
    return x


class Library:
    def __init__(self, spark: SparkSession, **tables: DataFrame):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise InvalidParams(f"unknown tables: {', '.join(sorted(unknown))}")
        self.spark = spark
        self.t: dict[str, DataFrame] = {n: tables.get(n, spark.createDataFrame([], s)) for n, s in TABLES.items()}
        self.settings: dict = dict(config.DEFAULTS)
        self.methods: dict[str, Callable] = {
            f"{space}.{name}": getattr(self, f"_{space}_{name}") for space, name in (n[1:].split("_", 1) for n in dir(type(self)) if n.startswith("_") and not n.startswith("__") and n.count("_") > 1)
        }

    # dispatch

    def call(self, method: str, **params):
        if method in OUTSIDE:
            raise Unsupported(f"{method} needs a network or a desktop host")
        if method not in self.methods:
            near = self._suggest(method)
            raise MethodNotFound(f"unknown method: {method}" + (f"; did you mean {near}?" if near else ""))
        try:
            inspect.signature(self.methods[method]).bind(**params)
        except TypeError as e:
            raise InvalidParams(f"{method}: {e}") from None
        return self.methods[method](**params)

    def handle(self, request):
        """A response to a request, or a list of them to a batch."""
        if isinstance(request, list):
            return [self.handle(r) for r in request]
        number = request.get("id") if isinstance(request, dict) else None
        try:
            if number is None and not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                raise InvalidRequest("not a JSON-RPC 2.0 request")
            return envelope(number, plain(self.call(request["method"], **request.get("params", {}))))
        except Exception as e:
            return envelope(number, error=e)

    def _suggest(self, method: str, most: int = 5) -> str | None:
        def distance(a: str, b: str) -> int:
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                before, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
            return row[-1]

        d, name = min((distance(method.lower(), m.lower()), m) for m in self.methods)
        return name if d <= most else None

    def _keys(self, keys: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in keys], "key string")

    def _one(self, table: str, key: str, **where) -> dict:
        own = self.t[table].where(F.col("key") == key)
        for c, v in where.items():
            own = own.where(F.col(c) == v)
        row = own.first()
        if row is None:
            raise NotFound(f"not found: {key}")
        return row.asDict(recursive=True)

    # items

    def _items_get(self, key: str):
        return self._one("items", key)

    def _items_create(self, rows: list[dict]):
        new = self.spark.createDataFrame(rows, ITEM)
        self.t["items"] = mutations.create_items(self.t["items"], new)
        return [r["key"] for r in rows]

    def _items_update(self, key: str, fields: dict, title: str | None = None, tags: list[str] | None = None):
        self._one("items", key)
        row = {"key": key, "fields": fields, "title": title, "tags": [{"tag": t, "type": 0} for t in tags or []]}
        change = self.spark.createDataFrame([row], "key string, fields map<string, string>, title string, tags array<struct<tag: string, type: int>>")
        self.t["items"] = mutations.update_items(self.t["items"], change)

    def _items_delete(self, keys: list[str]):
        mutations.check_keys(self.t["items"], self._keys(keys))
        self.t["items"] = mutations.delete_items(self.t["items"], self._keys(keys))

    def _items_trash(self, key: str):
        self._items_batchTrash([key])

    def _items_restore(self, key: str):
        self.t["items"] = mutations.set_deleted(self.t["items"], self._keys([key]), False)

    def _items_batchTrash(self, keys: list[str]):
        self.t["items"] = mutations.set_deleted(self.t["items"], self._keys(keys), True)

    def _items_getTrash(self, limit: int = 50, offset: int = 0):
        return paging.page(scans.trashed(self.t["items"]), ["key"], limit, offset)

    def _items_getRecent(self, type: str = "added", limit: int = 20, offset: int = 0):
        return paging.recent_items(scans.library_items(self.t["items"]), type, limit, offset)

    def _items_list(self, sort: str = "dateAdded", direction: str = "desc", limit: int = 50, offset: int = 0):
        return paging.list_items(scans.library_items(self.t["items"]), sort, direction, limit, offset)

    def _items_findDuplicates(self):
        return aggregates.duplicate_groups(scans.library_items(self.t["items"]), F.coalesce(F.nullif(F.col("fields")["DOI"], F.lit("")), F.lower("title")))

    def _items_mergeDuplicates(self, keys: list[str]):
        """Folds the others into the first."""
        own = self.t["items"].where(F.col("key").isin(*keys))
        sets = self.spark.createDataFrame([(k, keys[0]) for k in keys], "key string, head string")
        merged = aggregates.merge_duplicates(own, sets).select("key", F.map_from_entries(F.map_entries("fields")).alias("fields"), F.transform("tags", lambda t: F.struct(t.alias("tag"), F.lit(0).alias("type"))).alias("tags"))
        after = mutations.update_items(self.t["items"], merged)
        self.t["items"] = mutations.delete_items(after, self._keys(keys[1:]))

    def _items_getRelated(self, key: str):
        return lookups.related(self.t["items"], self.t["relations"], key)

    def _items_addRelated(self, key: str, relatedKey: str):
        new = self.spark.createDataFrame([(key, relatedKey)], RELATION)
        self.t["relations"] = setops.add_relations(self.t["relations"], new)

    def _items_removeRelated(self, key: str, relatedKey: str):
        self.t["relations"] = setops.remove_relations(self.t["relations"], self.spark.createDataFrame([(key, relatedKey)], RELATION))

    def _items_getFullText(self, key: str):
        item = self.t["items"].where(F.col("key") == key)
        return lookups.first_pdf_text(item, self.t["items"].where("item_type = 'attachment'"), self.t["texts"])

    def _items_citationKey(self, key: str):
        from lectern.functions.text import citation_key

        row = self.t["items"].where(F.col("key") == key).select(citation_key(F.col("fields"), F.col("creators")).alias("k")).first()
        if row is None:
            raise NotFound(f"not found: {key}")
        return row["k"]

    def _items_push(self, rows: list[dict], onDuplicate: str = "skip", collection: str | None = None):
        """rows: ref, doi, title, fields."""
        new = self.spark.createDataFrame(rows, "ref int, doi string, title string, fields map<string, string>")
        self.t["items"], self.t["members"], results = mutations.push_items(self.t["items"], self.t["members"], new, onDuplicate, collection)
        return results

    # collections

    def _collections_list(self):
        return scans.top_level_collections(self._collection_rows())

    def _collection_rows(self):
        return aggregates.collection_rows(self.t["collections"], self.t["members"], self.t["items"])

    def _collections_get(self, key: str):
        self._one("collections", key)
        return self._collection_rows().where(F.col("key") == key)

    def _collections_getItems(self, key: str, limit: int | None = None, offset: int = 0):
        return paging.page(lookups.collection_items(self.t["members"], self.t["items"], key), ["key"], limit, offset)

    def _collections_getSubcollections(self, key: str):
        return lookups.subcollections(self.t["collections"], key)

    def _collections_tree(self):
        return hierarchy.nested(paging.rows_of(hierarchy.tree(self.t["collections"]).orderBy("sort_path")))

    def _collections_create(self, key: str, name: str, parentKey: str | None = None):
        self.t["collections"] = mutations.create_collection(self.t["collections"], key, name, parentKey)

    def _collections_rename(self, key: str, name: str):
        self.t["collections"] = mutations.rename_collection(self.t["collections"], key, name)

    def _collections_delete(self, key: str):
        self.t["collections"], self.t["members"] = mutations.delete_collection(self.t["collections"], self.t["members"], key)

    def _collections_move(self, key: str, parentKey: str | None = None):
        self.t["collections"] = mutations.move_collection(self.t["collections"], key, parentKey)

    def _collections_addItems(self, key: str, keys: list[str]):
        self.t["members"] = setops.add_members(self.t["members"], self.spark.createDataFrame([(key, k) for k in keys], MEMBERSHIP))

    def _collections_removeItems(self, key: str, keys: list[str]):
        self.t["members"] = setops.remove_members(self.t["members"], self.spark.createDataFrame([(key, k) for k in keys], MEMBERSHIP))

    def _collections_stats(self, key: str):
        return aggregates.collection_stats(self.t["collections"], self.t["members"], self.t["items"]).where(F.col("key") == key)

    def _collections_resolve(self, ref: str):
        return lookups.resolve_collections(self.spark.createDataFrame([(ref,)], "ref string"), self.t["collections"])

    # attachments, notes, annotations

    def _children(self, parentKey: str, kind: str):
        return lookups.children(self._keys([parentKey]), self.t["items"], kind)

    def _attachments_get(self, key: str):
        self._one("items", key, item_type="attachment")
        return scans.attachment_rows(self.t["items"].where(F.col("key") == key))

    def _attachments_list(self, parentKey: str):
        return scans.attachment_rows(self._children(parentKey, "attachment"))

    def _attachments_getFulltext(self, key: str):
        return scans.fulltext(self.t["items"].where((F.col("key") == key) & (F.col("item_type") == "attachment")), self.t["texts"])

    def _attachments_add(self, rows: list[dict]):
        return self._items_create([r | {"item_type": "attachment"} for r in rows])

    def _attachments_getPath(self, key: str):
        return self._one("items", key, item_type="attachment")["path"]

    def _attachments_delete(self, key: str):
        self._one("items", key, item_type="attachment")
        self._items_delete([key])

    def _notes_get(self, key: str):
        return self._one("items", key, item_type="note")

    def _notes_list(self, parentKey: str):
        return self._children(parentKey, "note")

    def _notes_create(self, key: str, note: str, parentKey: str | None = None):
        return self._items_create([{"key": key, "item_type": "note", "note": note, "parent_key": parentKey, "deleted": False}])

    def _notes_update(self, key: str, note: str):
        self._one("items", key, item_type="note")
        self.t["items"] = mutations.update_note(self.t["items"], key, note)

    def _notes_search(self, query: str, limit: int = 25):
        return paging.page(filters.note_search(self.t["items"], query), ["key"], limit)

    def _annotations_list(self, parentKey: str):
        return scans.annotation_rows(self.t["annotations"].where(F.col("parent_key") == parentKey))

    def _annotations_create(self, rows: list[dict]):
        self.t["annotations"] = mutations.create_annotations(self.t["annotations"], self.spark.createDataFrame(rows, ANNOTATION))

    def _annotations_delete(self, key: str):
        self.t["annotations"] = self.t["annotations"].where(F.col("key") != key)

    # search

    def _search_quick(self, query: str, limit: int = 25):
        return paging.page(filters.quick_search(self.t["items"], query), ["key"], limit)

    def _search_advanced(self, conditions: list[dict], operator: str = "and", limit: int | None = None, offset: int = 0):
        return paging.page(filters.advanced(self.t["items"], conditions, operator), ["key"], limit, offset)

    def _search_fulltext(self, query: str, limit: int = 25):
        own = self.t["texts"].join(self.t["items"].select("key", "parent_key"), "key")
        return paging.page(filters.fulltext_search(self.t["items"], own, query), ["key"], limit)

    def _search_byTag(self, tag: str, limit: int = 50):
        return paging.page(filters.by_tag(self.t["items"], tag), ["key"], limit)

    def _search_byIdentifier(self, doi: str | None = None, isbn: str | None = None, issn: str | None = None):
        return paging.page(filters.by_identifier(self.t["items"], doi, isbn, issn), ["key"])

    def _search_savedSearches(self):
        return self.t["searches"]

    def _search_createSavedSearch(self, key: str, name: str, conditions: list[dict]):
        new = self.spark.createDataFrame([{"key": key, "name": name, "conditions": [{"field": c["field"], "op": c.get("op") or c["operator"], "value": c["value"]} for c in conditions]}], SAVED_SEARCH)
        self.t["searches"] = setops.upsert(self.t["searches"], new, ["key"])

    def _search_deleteSavedSearch(self, key: str):
        self._one("searches", key)
        self.t["searches"] = self.t["searches"].where(F.col("key") != key)

    # tags

    def _tags_list(self, limit: int = 200, offset: int = 0):
        return paging.page(scans.tag_list(self.t["items"]), ["tag", "type"], limit or 200, offset)

    def _tags_add(self, key: str, tags: list[str]):
        self._tags_batchUpdate([{"key": key, "add": tags}])

    def _tags_remove(self, key: str, tags: list[str]):
        self._tags_batchUpdate([{"key": key, "remove": tags}])

    def _tags_rename(self, old: str, new: str):
        self.t["items"] = setops.rename_tag(self.t["items"], old, new)

    def _tags_delete(self, tag: str):
        self.t["items"] = setops.delete_tag(self.t["items"], tag)

    def _tags_batchUpdate(self, operations: list[dict]):
        ops = self.spark.createDataFrame([(o["key"], o.get("add") or [], o.get("remove") or []) for o in operations], "key string, add array<string>, remove array<string>")
        mutations.check_keys(self.t["items"], ops)
        self.t["items"] = setops.batch_tags(self.t["items"], ops)
        return aggregates.batch_tag_totals(ops)

    # export, settings, rag, system

    def _export(self, keys: list[str], make, fmt: str, joiner: str = "\n\n"):
        return exports.export(make(lookups.require(self.spark, self.t["items"], keys).dropDuplicates(["key"])), fmt, joiner)

    def _export_bibtex(self, keys: list[str]):
        return self._export(keys, exports.bibtex, "bibtex")

    def _export_ris(self, keys: list[str]):
        return self._export(keys, exports.ris, "ris")

    def _export_csv(self, keys: list[str]):
        return self._export(keys, exports.csv_rows, "csv", "\n")

    def _export_cslJson(self, keys: list[str]):
        out = self._export(keys, exports.csl_json, "csl-json", ",")
        return out | {"content": f"[{out['content']}]"}

    def _export_bibliography(self, keys: list[str]):
        return self._export(keys, exports.bibliography, "bibliography", "\n")

    def _settings_get(self, key: str):
        if key not in config.DEFAULTS:
            raise InvalidParams(f"unknown setting: {key}")
        return self.settings[key]

    def _settings_set(self, key: str, value):
        self.settings = config.set_all(self.settings, {key: value})

    def _settings_getAll(self):
        return dict(self.settings)

    def _settings_setAll(self, values: dict):
        self.settings = config.set_all(self.settings, values)

    def _rag_searchHits(self, query: str, keys: list[str] | None = None, collection: str | None = None, limit: int = 50, topSpansPerItem: int = 3):
        scope = lookups.scope_items(self.t["items"], self.t["members"], self.t["collections"], keys, collection)
        own = self.t["chunks"].join(scope.select(F.col("key").alias("item_key")), "item_key", "left_semi")
        found = retrieval.lexical_hits(own, query, topSpansPerItem, limit)
        rows = plain(retrieval.hits(found, scope, query).orderBy(F.desc("score"), F.collate("chunk_id", "UNICODE"), "chunk_id"))
        return {"hits": [{k: v for k, v in r.items() if v not in (None, "", [])} for r in rows], "total": len(rows)}

    def _system_ping(self):
        return {"status": "ok"}

    def _system_version(self):
        return __version__

    def _system_libraries(self):
        return self.t["collections"].select("library_id").union(self.t["items"].select("library_id")).distinct()

    def _system_libraryStats(self):
        return aggregates.library_stats(self.t["items"], self.t["collections"])

    def _system_itemTypes(self):
        return self.t["items"].select("item_type").distinct()

    def _system_itemFields(self, itemType: str):
        own = scans.dictionary(self.t["items"].select("item_type", "fields"), "item_type", itemType)
        return own.select(F.explode(F.map_keys("fields")).alias("field")).distinct()

    def _system_creatorTypes(self, itemType: str):
        own = scans.dictionary(self.t["items"].select("item_type", "creators"), "item_type", itemType)
        return own.select(F.explode("creators").alias("c")).select(F.coalesce("c.creator_type", F.lit("author")).alias("creator_type")).distinct()

    def _system_listMethods(self):
        return sorted(self.methods)

    def _system_describe(self, method: str):
        if method not in self.methods:
            raise MethodNotFound(f"unknown method: {method}")
        return {"method": method, "params": [str(p) for p in inspect.signature(self.methods[method]).parameters.values()]}
