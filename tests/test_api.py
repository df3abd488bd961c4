"""The library object and its dispatch."""

import pytest

from lectern.api import OUTSIDE, Library, Unsupported
from lectern.errors import InvalidParams, MethodNotFound, NotFound
from lectern.schemas import CHUNK, ITEM


@pytest.fixture
def lib(spark):
    base = {"deleted": False, "library_id": 1, "collections": [], "tags": [{"tag": "x", "type": 0}]}
    rows = [
        {"key": "A", "item_type": "journalArticle", "title": "Deep learning for all", "fields": {"DOI": "10.1/a", "date": "2019"}, "creators": [{"first_name": "Ada", "last_name": "Byron"}]},
        {"key": "B", "item_type": "book", "title": "Another title here", "fields": {"DOI": "10.1/a"}, "creators": []},
        {"key": "N", "item_type": "note", "note": "<p>hello</p>", "parent_key": "A", "fields": {}, "creators": []},
    ]
    chunk = {"chunk_id": "A:c0", "item_key": "A", "text": "deep learning", "section_heading": "S"}
    return Library(spark, items=spark.createDataFrame([base | r for r in rows], ITEM), chunks=spark.createDataFrame([chunk], CHUNK))


def test_methods_and_errors(lib):
    names = lib.call("system.listMethods")
    assert len(names) + len(OUTSIDE) >= 87 and "items.list" in names
    with pytest.raises(MethodNotFound, match="items.list"):
        lib.call("items.lst")
    with pytest.raises(InvalidParams):
        lib.call("items.get", nokey=1)
    with pytest.raises(Unsupported):
        lib.call("items.addByDOI", doi="x")
    with pytest.raises(NotFound):
        lib.call("notes.get", key="A")
    assert lib.handle({"jsonrpc": "2.0", "id": 3, "method": "nope.at.all.here"})["error"]["code"] == -32601
    assert [r.get("error", {}).get("code") for r in lib.handle([{"id": 1}, {"jsonrpc": "2.0", "id": 2, "method": "system.ping"}])] == [-32600, None]


def test_reads(lib):
    assert [r["key"] for r in lib.handle({"jsonrpc": "2.0", "id": 1, "method": "items.list"})["result"]["items"]] == ["A", "B"]
    assert lib.call("search.quick", query="byron").total == 1
    assert lib.call("items.citationKey", key="A") == "Byron2019"
    hits = lib.call("rag.searchHits", query="deep learning")
    assert hits["total"] == 1 and hits["hits"][0]["score"] == 3 and hits["hits"][0]["authors"] == ["Ada Byron"] and "doi" in hits["hits"][0]
    assert lib.call("export.ris", keys=["A"])["count"] == 1
    assert lib.call("items.findDuplicates").count() == 1


def test_changes(lib):
    lib.call("collections.create", key="C", name="Col")
    lib.call("collections.addItems", key="C", keys=["A", "B"])
    lib.call("items.trash", key="B")
    assert [r.key for r in lib.call("collections.getItems", key="C").df.collect()] == ["A"] and lib.call("items.getTrash").total == 1
    lib.call("tags.batchUpdate", operations=[{"key": "A", "add": ["y"], "remove": ["x"]}])
    assert lib.call("search.byTag", tag="y").total == 1
    out = lib.call("items.push", rows=[{"ref": 1, "doi": "10.1/a", "title": "t", "fields": {}}, {"ref": 2, "doi": "", "title": "brand new title", "fields": {"date": "2001"}}], collection="C")
    assert sorted((r.ref, r.status) for r in out.collect()) == [(1, "skipped_duplicate"), (2, "created")]
    lib.call("items.restore", key="B")
    lib.call("items.mergeDuplicates", keys=["A", "B"])
    assert lib.call("items.list").total == 2
    lib.call("settings.set", key="rag.topK", value="9")
    assert lib.call("settings.get", key="rag.topK") == 9


def test_command_line(spark, tmp_path, lib, capsys):
    from lectern.__main__ import main

    lib.t["items"].write.parquet(str(tmp_path / "items"))
    assert main(["--tables", str(tmp_path), "--output", "table", "search.byTag", "tag=x"]) == 0
    assert "[" in capsys.readouterr().out
    assert main(["--tables", str(tmp_path), "--save", str(tmp_path / "new"), "items.trash", "key=B"]) == 0
    assert spark.read.parquet(str(tmp_path / "new/items")).where("deleted").count() == 1
    assert main(["--tables", str(tmp_path), "items.get", "key=none"]) == 1 and "not found" in capsys.readouterr().err


def test_import_files(spark, tmp_path):
    from lectern.sources.artifacts import import_items

    (tmp_path / "a.json").write_text('[{"title": "T", "DOI": "", "date": "2001", "creators": [{"first_name": null, "last_name": "L", "creator_type": null}]}]')
    row = import_items(spark, str(tmp_path / "a.json")).first()
    assert row.item_type == "journalArticle" and row.fields == {"title": "T", "date": "2001"} and row.creators[0].creator_type == "author"
    (tmp_path / "b.csv").write_text("title,year\nA,1\n")
    assert import_items(spark, str(tmp_path / "b.csv")).first().fields == {"title": "A", "year": "1"}
    with pytest.raises(InvalidParams):
        import_items(spark, "x.doc")
