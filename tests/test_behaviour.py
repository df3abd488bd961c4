"""Exact rows for the cases that tables don't hold."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, MethodNotFound, NotFound, StaleArtifact, envelope
from lectern.functions import embed, hashes, names, text, vectors
from lectern.operators import aggregates, blocks, chunks, exports, filters, hierarchy, lookups, mutations, paging, retrieval, setops
from lectern.sources import artifacts, config


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__x"))
    return row.select(column.alias("r")).first()["r"]


def test_lexical_score(spark):
    s = lambda t, q: one(spark, text.lexical_score(F.lit(t), F.lit(q)))
    assert s("Deep Learning works", "deep learning") == 3
    assert s("learning deep", "deep learning") == 2
    assert s("deeply", "deep") == 2
    assert s("", "a") == 0 and s("a", " ") == 0 and s("nothing", "deep") == 0


def test_white_space_is_unicode(spark):
    assert one(spark, text.trim(F.lit("　 a "))) == "a"
    assert one(spark, text.normalized_name(F.lit(" A　 b\tC "))) == "a b c"


@pytest.mark.parametrize("size,overlap", [(20, 0), (50, 10), (64, 63)])
def test_merged_pieces(spark, size, overlap):
    """Behind the end of the chunk before, a chunk holds the next pieces, as many as fit."""
    r = random.Random(size)
    rows = [(k, ["w" * r.randint(0, 40) + str(k) for _ in range(r.randint(0, 12))]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, p array<string>")
    got = {x.k: x.c for x in df.select("k", chunks.merge_pieces(F.col("p"), size, overlap).alias("c")).collect()}
    for k, pieces in rows:
        seen, starts = [], [0, *(max(0, len(c) - overlap) for c in got[k])]
        tails = ["", *(c[at:] for c, at in zip(got[k], starts[1:]))]
        for n, chunk in enumerate(got[k]):
            head = tails[n] + "\n\n" if tails[n] else ""
            assert chunk.startswith(head)
            own = chunk[len(head) :].split("\n\n")
            filled = len(tails[n]) + sum(map(len, own))
            assert filled <= size or len(own) == 1
            seen += own
            if len(seen) < len(pieces):
                assert filled + len(pieces[len(seen)]) > size
        assert seen == pieces


def test_hard_stride_and_sizes(spark):
    got = one(spark, chunks.hard_stride(F.lit("x" * 960), 512, 64))
    assert [len(c) for c in got] == [512, 512, 64]
    with pytest.raises(InvalidParams):
        chunks.check_sizes(10, 10)


def test_sections_cross_lines():
    assert chunks.find_sections("#\n\nBody") == [("Body", "")]
    assert chunks.find_sections("lead\n# One\ntext\n## Two\nmore") == [("", "lead"), ("One", "text"), ("Two", "more")]
    assert chunks.find_sections("一、绪论\n内容\n第二章 方法\n更多") == [("一、绪论", "内容"), ("第二章 方法", "更多")]
    assert chunks.find_sections("3.14 is pi") == [("3.14 is pi", "")] and chunks.find_sections(None) == []


def test_chunks_number_non_blank(spark):
    df = spark.createDataFrame([("a", "# H\n\nbody one. body two."), ("b", "  \n "), ("c", None)], "id string, text string")
    rows = sorted((r.id, r.section, r.chunk_index, r.text) for r in chunks.chunk_documents(df, 512, 50).collect())
    assert rows == [("a", "H", 0, "body one. body two.")]


PAYLOAD = '{"pages":[{"page":0,"blocks":[{"type":"title","text":"Intro"},{"type":"figure","text":null,"caption":"Fig","bbox":[1,2,3,4]},{"type":"table","text":"T","bbox":[1,2,3,4]},{"type":"text","text":" "}]}],"layout":[{"type":"text","text":"after"}]}'


def test_blocks_and_fallback(spark):
    rows = [("A", "I", "p", PAYLOAD), ("B", "I", "p", '{"md_results":"# T\\n\\npara"}'), ("C", "I", "p", "plain words"), ("D", "I", "p", '{"pages":[]}')]
    df = spark.createDataFrame(rows, "attachment_key string, item_key string, provider string, payload string")
    got = [(r.block_id, r.type, r.page, r.section_heading, r.text, r.caption) for r in blocks.provider_blocks(df).orderBy("attachment_key", "reading_order").collect()]
    assert got == [
        ("A:p1:b0", "heading", 1, "Intro", "Intro", None), ("A:p1:b1", "figure", 1, "Intro", "Fig", "Fig"), ("A:p1:b2", "table", 1, "Intro", "T", None), ("A:p1:b0", "paragraph", 1, "Intro", "after", None),
        ("B:p0:b0", "heading", None, "", "T", None), ("B:p0:b1", "paragraph", None, "T", "para", None), ("C:p0:b0", "paragraph", None, "", "plain words", None),
    ]


def test_block_chunks_cut(spark):
    rows = [("A", "I", k, f"A:b{k}", t, p, h, x, s) for k, (t, p, h, x, s) in enumerate([("heading", 1, "S", "S", "weak"), ("paragraph", 1, "S", "x" * 12, "weak"), ("table", 2, "S", "y" * 6, "strong"), ("paragraph", 2, "S", "z" * 30, "weak"), ("paragraph", 3, "T", "t", "weak")])]
    df = spark.createDataFrame(rows, "attachment_key string, item_key string, reading_order int, block_id string, type string, page int, section_heading string, text string, provenance_strength string")
    df = df.withColumns({"bbox": F.lit(None).cast("array<double>"), "caption": F.lit(None).cast("string"), "image_ref": F.lit(None).cast("string")})
    got = [(r.chunk_id, r.block_ids, r.page_start, r.page_end, r.provenance_strength, len(r.evidence_refs)) for r in blocks.chunk_blocks(df, 20).orderBy("chunk_id").collect()]
    assert got == [("A:c0", ["A:b1", "A:b2"], 1, 2, "mixed", 1), ("A:c1", ["A:b3"], 2, 2, "weak", 0), ("A:c2", ["A:b4"], 3, 3, "weak", 0)]


def test_vectors(spark):
    rows = [("i", "c1", [1.0, 0.0]), ("i", "c2", [0.0, 1.0]), ("j", "c3", [-1.0, 0.0]), ("j", "c4", [0.0, 0.0]), ("j", "c0", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "item_key string, chunk_id string, vector array<float>")
    assert [(r.chunk_id, r.score) for r in retrieval.vector_hits(df, [3.0, 0.0], 10).collect()] == [("c0", 1.0), ("c1", 1.0), ("c2", 0.0), ("c4", 0.0), ("c3", -1.0)]
    with pytest.raises(InvalidParams):
        retrieval.vector_hits(df, [0.0, 0.0])
    with pytest.raises(Exception, match="another dimension"):
        retrieval.vector_hits(df, [1.0]).collect()
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_icu_order(spark):
    df = spark.createDataFrame([("i", k, "deep") for k in ("ATT:C2", "att:c1", "ATT:c10", "ATT:c2")], "item_key string, chunk_id string, text string")
    assert [r.chunk_id for r in retrieval.lexical_hits(df, "deep", 10).collect()] == ["att:c1", "ATT:c10", "ATT:c2", "ATT:C2"]
    assert [r.chunk_id for r in retrieval.lexical_hits(df, "deep", 1, 5).collect()] == ["att:c1"]


def test_lookups_and_errors(spark):
    items = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, title string")
    assert [r.key for r in lookups.require(spark, items, ["b", "a", "b"]).collect()] == ["b", "a", "b"]
    with pytest.raises(NotFound, match="zz"):
        lookups.require(spark, items, ["a", "zz"])
    assert lookups.looks_like_id("12") and not lookups.looks_like_id("007") and not lookups.looks_like_id("x")
    assert envelope(1, error=MethodNotFound("m"))["error"]["code"] == -32601 and envelope(2, [1])["result"] == [1]
    assert filters.first_unknown(["a", "q", "z"], {"a"}) == "q"


def test_pages(spark):
    df = spark.range(25).select(F.col("id").alias("key"))
    assert [r.key for p in paging.pages(df, ["key"], 10) for r in p] == list(range(25))
    page = paging.page(df, ["key"], 5, 20)
    assert page.total == 25 and page.envelope()["items"][0]["key"] == 20
    assert paging.page(df, ["key"], 5, 99).df.count() == 0
    with pytest.raises(InvalidParams):
        paging.page(df, ["key"], -1)
    with pytest.raises(InvalidParams):
        filters.advanced(df, [{"field": "title", "op": "like", "value": "x"}])


def test_zip_mismatch_and_staleness(spark):
    c = spark.createDataFrame([("i", 0, "i:c0", "one"), ("i", 1, "i:c1", "two")], "item_key string, ordinal int, chunk_id string, text string")
    v = c.where("ordinal = 0").select("item_key", "ordinal", F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(InvalidParams, match="2 chunks, 1 vectors"):
        lookups.require_zip(c, v)
    meta = retrieval.chunk_metadata(c)
    retrieval.require_fresh(meta, c)
    with pytest.raises(StaleArtifact):
        retrieval.require_fresh(meta, c.withColumn("text", F.concat("text", F.lit("!"))))
    assert hashes.canonical_json_sha256({"b": 1, "a": [2]}) == hashes.canonical_json_sha256({"a": [2], "b": 1})


def test_mixed_models_and_unknown_tag(spark):
    a = spark.createDataFrame([("i", "m1")], "item_key string, model string")
    with pytest.raises(InvalidParams):
        setops.union_stores([a, a.withColumn("model", F.lit("m2"))])
    assert setops.union_stores([a, a]).count() == 2
    items = spark.createDataFrame([("k", [("x", 1)])], "key string, tags array<struct<tag: string, type: int>>")
    with pytest.raises(InvalidParams):
        setops.delete_tag(items, "nope")
    assert setops.rename_tag(items, "nope", "y").first().tags[0].tag == "x"


def test_tree_with_orphan(spark):
    df = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("o", "O", "gone")], "key string, name string, parent_key string")
    rows = hierarchy.tree(df).orderBy("sort_path").collect()
    assert [(r.key, r.depth, r.path) for r in rows] == [("a", 0, "A"), ("b", 1, "A/B"), ("c", 2, "A/B/C"), ("o", 0, "O")]
    assert hierarchy.nested(rows)[0]["children"][0]["children"][0]["key"] == "c"


def test_trash_fails_whole(spark):
    items = spark.createDataFrame([("a", False)], "key string, deleted boolean")
    with pytest.raises(NotFound):
        mutations.set_deleted(items, spark.createDataFrame([("a",), ("q",)], "key string"), True)


def test_duplicate_sets_are_transitive(spark, tmp_path):
    df = spark.createDataFrame([("1", "d", "x"), ("2", "d", "y"), ("3", "", "y"), ("4", "", "z"), ("5", None, None)], "key string, doi string, title string")

    def put(frame, name):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    sets = aggregates.duplicate_sets(df, [F.col("doi"), F.col("title")], put)
    assert sorted((r.key, r.head) for r in sets.collect()) == [("1", "1"), ("2", "1"), ("3", "1")]


def test_annotations(spark):
    new = spark.createDataFrame([("k", "p", "note", "t", None)], "key string, parent_key string, annotation_type string, annotation_text string, annotation_color string")
    with pytest.raises(InvalidParams, match="no text"):
        mutations.create_annotations(new.limit(0), new)


def test_tables():
    assert exports.table([{"a": 1}, {"b": None, "a": 22}]) == "a   b\n1\n22"
    assert exports.table([{"a": [1]}]).startswith("[")


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"rag": {"topK": "7"}}')
    found = config.load({"rag.topK": 6, "rag.chunkSize": "100"}, str(file), {"LECTERN_RAG_CHUNK_OVERLAP": "9"})
    assert (found["rag.topK"], found["rag.chunkSize"], found["rag.chunkOverlap"]) == (7, 100, 9)
    with pytest.raises(InvalidParams, match="x.y"):
        config.set_all({}, {"rag.topK": 1, "x.y": 2})
    assert config.coerce("yes", False) is True and config.coerce("off", True) is False


def test_artifacts_round_trip(spark, tmp_path):
    import numpy as np

    (tmp_path / "k1.embeddings.npz").write_bytes(artifacts.npz_bytes(np.eye(2), [{"chunk_id": "k1:c0", "text_sha256": "x"}, {"chunk_id": "k1:c1"}], model="m"))
    (tmp_path / "k2.embeddings.npz").write_bytes(artifacts.npz_bytes(np.ones((1, 2)), {"model": "n"}, chunk_ids=["k2:c0"]))
    rows = artifacts.read_npz(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.model, r.dim, list(r.vector)) for r in rows] == [("k1:c0", "m", 2, [1, 0]), ("k1:c1", "m", 2, [0, 1]), ("k2:c0", "n", 2, [1, 1])]
    assert [r.item_key for r in artifacts.item_keys(spark, str(tmp_path), ".embeddings.npz").collect()] == ["k1", "k2"]
    (tmp_path / "r.zip").write_bytes(artifacts.raw_zip({"id": "p"}, {"x": "é"}, {"a.txt": b"hi", "b.bin": b"\xff\xfe"}))
    members = {r.member: (r.kind, r.text, r.data) for r in artifacts.read_raw_zips(spark, str(tmp_path)).collect()}
    assert members["files/a.txt"] == ("text", "hi", None) and members["files/b.bin"][0] == "binary" and members["provider_raw.json"][0] == "json"
    with pytest.raises(InvalidParams):
        artifacts.raw_zip({}, {}, {"../x": b""})
    with pytest.raises(InvalidParams):
        artifacts.npz_bytes(np.eye(1))


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"item_key": "k", "text": "a b"}\n\n  \n{"item_key": "k2", "text": "c"}\n')
    assert artifacts.read_jsonl(spark, str(tmp_path / "a.jsonl"), "item_key string, text string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"item_key": "k"}\nnot json\n')
    bad = artifacts.read_jsonl_with_errors(spark, str(tmp_path / "b.jsonl"), "item_key string").where("line IS NOT NULL").collect()
    assert [r.line for r in bad] == ["not json"]
    with pytest.raises(Exception):
        artifacts.read_jsonl(spark, str(tmp_path / "b.jsonl"), "item_key string").collect()
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 ...")
    assert artifacts.pdf_files(spark, str(tmp_path / "x.pdf")).first().is_pdf


def test_provider_markdown(spark):
    f = lambda s: one(spark, artifacts.provider_markdown(F.lit(s)))
    assert f('{"pages":[{"markdown":"a"},{"markdown":"b"}]}') == "a\n\nb"
    assert f('{"markdown":"","md_results":"m"}') == "m" and f("{}") is None


def test_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    rows = embed.with_vectors(df, dim=16).collect()
    assert all(len(r.vector) == 16 for r in rows) and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6
    with pytest.raises(InvalidParams):
        embed.create_embedder("nope")


def test_streaming_upsert(spark, tmp_path):
    from lectern.streaming import ingest

    src, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    src.mkdir()
    schema = "item_key string, chunk_id string, text string"
    for number, line in enumerate(['{"item_key":"i","chunk_id":"i:c0","text":"one"}', '{"item_key":"i","chunk_id":"i:c0","text":"two"}\n{"item_key":"i","chunk_id":"i:c1","text":"three"}']):
        (src / f"{number}.json").write_text(line)
        ingest.upsert_batches(ingest.chunk_stream(spark, str(src), schema), store, check, ["item_key", "chunk_id"]).awaitTermination()
    assert sorted((r.chunk_id, r.text) for r in ingest.latest(spark, store).collect()) == [("i:c0", "two"), ("i:c1", "three")]


def test_chinese_names(spark):
    got = one(spark, names.split_chinese_name(F.lit("  ")))
    assert (got.last_name, got.first_name) == ("", "")


def test_empty_tables(spark):
    items = spark.createDataFrame([], "key string, item_type string, title string, parent_key string, deleted boolean, library_id int, fields map<string, string>")
    assert aggregates.library_stats(items, items.select("library_id")).count() == 0
    assert lookups.find_duplicates_of(spark.createDataFrame([(1, "", "t")], "ref int, doi string, title string"), items).first().dup_key is None
