"""Stores, jobs, programs, sources and settings against brute force, with their errors and borders."""

import http.server
import json
import math
import random
import re
import threading
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.errors import InvalidParams, NotFound, StaleArtifact
from lectern.functions import files
from lectern.functions.embed import HashingEmbedder, with_vectors
from lectern.operators import blocks as block_ops
from lectern.operators import chunks, hierarchy, jobs, lookups, paging, programs, retrieval, setops, vectorsearch
from lectern.sources import artifacts, config, providers, rpc, stores
from lectern.streaming import ingest


def test_sections_settle_overlaps():
    assert chunks.find_sections("") == [] and chunks.find_sections(None) == [] and chunks.find_sections("  lead \n") == [("", "lead")]
    assert chunks.find_sections("lead\n# A\nbody\n## B\n\n1. first\ntext") == [("", "lead"), ("A", "body"), ("B", ""), ("1. first", "text")]
    # "# 1. title" is a heading by two patterns only where both match at a line's start
    assert chunks.find_sections("# 第一章 intro\nx\n第二章 next\ny") == [("第一章 intro", "x"), ("第二章 next", "y")]
    # a heading that begins with a number and runs over a line break holds the one inside it
    assert chunks.find_sections("1\n# A\nx") == [("1\n# A", "x")]
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["# ", "1. ", "一、", "第一章", "x", "word ", "\n", "\n\n", "2\n"]) for _ in range(30))
        found = chunks.find_sections(text)
        assert sum(len(t) + len(b) for t, b in found) <= len(text) and all(t or k == 0 for k, (t, _) in enumerate(found))


def test_paging_names_what_it_cuts(spark, monkeypatch):
    df = spark.range(25).withColumnRenamed("id", "key")
    pages = [[r.key for r in p] for p in paging.pages(df, ["key"], 10)]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert [len(p) for p in paging.pages(df, ["key"], 5)] == [5] * 5 + [0]
    with pytest.raises(InvalidParams, match="more than 20"):
        list(paging.pages(df, ["key"], 10, most=20))
    monkeypatch.setattr(paging, "MOST_ROWS", 24)
    with pytest.raises(InvalidParams, match="more than 24"):
        paging.rows_of(df)
    monkeypatch.setattr(paging, "MOST_ROWS", 25)
    assert len(paging.rows_of(df)) == 25
    assert paging.concatenated([[1, 2], [3]], 2) == [1, 2, 3] and paging.concatenated([[1, 2], []], 2) == [1, 2]
    with pytest.raises(InvalidParams):
        paging.concatenated([[1, 2], [1, 2]], 2)


def test_trees_of_cycles_and_depth(spark):
    rows = [("a", "A", None), ("b", "B", "a"), ("c", "C", "d"), ("d", "D", "c"), ("e", "E", "d"), ("f", "F", "gone")]
    got = {r.key: (r.depth, r.path) for r in hierarchy.tree(spark.createDataFrame(rows, "key string, name string, parent_key string")).collect()}
    assert got == {"a": (0, "A"), "b": (1, "A/B"), "f": (0, "F"), "c": (None, None), "d": (None, None), "e": (None, None)}
    chain = spark.createDataFrame([(str(k), str(k), str(k - 1) if k else None) for k in range(30)], "key string, name string, parent_key string")
    assert hierarchy.tree(chain, most_deep=40).agg(F.max("depth")).first()[0] == 29
    with pytest.raises(InvalidParams, match="deeper than 10"):
        hierarchy.tree(chain, most_deep=10)


def test_trees_of_any_depth_and_size(spark):
    """A chain of 5,000 levels, a cycle of 300, 200,000 children of one node, and no limit of rows."""
    chain = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("name"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_key"))
    cycle = spark.range(300).select(F.concat(F.lit("c"), "id").alias("key"), F.lit("y").alias("name"), F.concat(F.lit("c"), (F.col("id") + 1) % 300).alias("parent_key"))
    wide = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("key"), F.lit("z").alias("name"), F.lit("17").alias("parent_key"))
    found = hierarchy.tree(chain.union(cycle).union(wide))
    rows = {r.kind: (r.n, r.least, r.most, r.size) for r in found.groupBy(F.col("name").alias("kind")).agg(F.count("*").alias("n"), F.min("depth").alias("least"), F.max("depth").alias("most"), F.max(F.length("path")).alias("size")).collect()}
    assert rows == {"x": (5000, 0, 4999, 9999), "y": (300, None, None, None), "z": (200_000, 18, 18, 37)}
    assert found.where("key = '4'").first().sort_path == "0/1/2/3/4"


def test_trees_equal_a_walk(spark):
    r = random.Random(1)
    parents = {f"k{k}": r.choice([None, "gone", *[f"k{j}" for j in range(60)]]) for k in range(60)}

    def way(key):
        out = [key]
        while parents[out[0]] in parents:
            if parents[out[0]] in out:
                return None
            out.insert(0, parents[out[0]])
        return "/".join(out)

    got = {x.key: x.sort_path for x in hierarchy.tree(spark.createDataFrame([(k, k, p) for k, p in parents.items()], "key string, name string, parent_key string")).collect()}
    assert got == {k: way(k) for k in parents}
    assert hierarchy.tree(spark.createDataFrame([], "key string, name string, parent_key string")).count() == 0


def test_repeated_keys_are_settled_alike(spark):
    rows = [(k % 5, k, f"v{k % 3}") for k in range(60)]
    want = {k: max(({"n": n, "v": v} for a, n, v in rows if a == k), key=lambda x: json.dumps(x, separators=(",", ":"))) for k in range(5)}
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "k int, n int, v string").repartition(parts)
        got = {r.k: {"n": r.n, "v": r.v} for r in setops.upsert(df.limit(0), df, ["k"]).collect()}
        assert got == want
        last = {r.k: r.n for r in setops.upsert(df.limit(0), df, ["k"], order=F.col("n")).collect()}
        assert last == {k: 55 + k for k in range(5)}


@pytest.mark.parametrize("block, broadcast_bytes, cell_queries", [(3, 1 << 20, 1000), (1000, 1 << 20, 1000), (3, 0, 1000), (3, 0, 5), (1000, 0, 1)])
def test_many_queries_equal_brute_force(spark, block, broadcast_bytes, cell_queries):
    r = np.random.default_rng(2)
    own = r.integers(-2, 3, (300, 6)).astype(float)
    own[7] = own[9] = 0
    rows = [(f"c{k:03d}", f"i{k % 4}", v.tolist()) for k, v in enumerate(own)]
    vectors = spark.createDataFrame(rows, "chunk_id string, item_key string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(k, own[k].tolist()) for k in range(0, 20)], "query_id int, vector array<double>")
    unit = own / np.where(np.linalg.norm(own, axis=1, keepdims=True) > 0, np.linalg.norm(own, axis=1, keepdims=True), 1)
    want = {}
    for q in range(20):
        scores = [(-round(float(s), 9), c) for s, (c, _, _) in zip(unit @ unit[q], rows)]
        want[q] = sorted(scores)[:4]
    got = {}
    found = vectorsearch.vector_hits_of(vectors, queries, 4, block=block, broadcast_bytes=broadcast_bytes, cell_queries=cell_queries)
    for x in found.collect():
        got.setdefault(x.query_id, []).append((-round(x.score, 9) + 0.0, x.chunk_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: [(s + 0.0, c) for s, c in v] for q, v in want.items()}
    assert ("SortMergeJoin" in found._jdf.queryExecution().toString()) == (not broadcast_bytes)
    assert vectorsearch.vector_hits_of(vectors, queries.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="dimension"):
        vectorsearch.vector_hits_of(vectors, spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>")).collect()


def test_scores_are_held_in_slices(monkeypatch):
    """A block's scores never lie in memory whole, and the best are those of all of them, ties between slices included."""
    r = np.random.default_rng(5)
    units, asked = r.integers(-2, 3, (5000, 8)).astype(float), r.integers(-2, 3, (300, 8)).astype(float)
    chunk, item = np.array([f"c{k:04d}" for k in range(5000)], object), np.array(["i"] * 5000, object)
    monkeypatch.setattr(vectorsearch, "SCORE_BYTES", 1 << 20)
    best = vectorsearch._Best(0, asked, pa.array(range(300)), 3)
    tracemalloc.start()
    best.meet(units[:4000], chunk[:4000], item[:4000])
    best.meet(units[4000:], chunk[4000:], item[4000:])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * 300 * 8 / 2
    got = {}
    for query, score, c in zip(*best.held[:3]):
        got.setdefault(int(query), []).append((-score, c))
    assert got == {q: sorted((-s, c) for s, c in zip(units @ asked[q], chunk))[:3] for q in range(300)}


def test_row_programs(spark):
    df = spark.createDataFrame([(1, "en", ["a", "b"], ("x", 2)), (2, None, [], ("y", 3)), (3, "de", ["c"], ("z", None))], "n int, lang string, tags array<string>, meta struct<s: string, k: int>")
    run = lambda p: [tuple(r) for r in programs.run_program(df, p).collect()]
    assert run(".[] | select(.n >= 2) | .lang") == [(None,), ("de",)]
    assert run('select(.lang == null or .meta.s == "x") | {n, s: .meta.s, one: 1}') == [(1, "x", 1), (2, "y", 1)]
    assert run(".tags[]") == [("a",), ("b",), ("c",)] and run(".tags | length") == [(2,), (0,), (1,)]
    assert run('select((.meta.k > 1) not) | .n') == [(3,)] and run('select(.lang != "en" and .n < 3) | .n') == [(2,)]
    assert run("sort_by(.n) | first(2) | .meta | .s") == [("x",), ("y",)] and run("first(1) | keys") == [(["lang", "meta", "n", "tags"],)]
    assert run('select(.meta.s | startswith("z")) | .') == run("select(.n == 3)")
    for bad in ("select(.n", "nope", ".n |", "{", "select(.n ==)", "%", "{1}"):
        with pytest.raises(InvalidParams):
            programs.run_program(df, bad)


def test_artifact_store_errors(spark, tmp_path):
    chunk = spark.createDataFrame([("i", 0, "c0", "one", None), ("i", 1, "c1", "two", "own"), ("j/k", 0, "c2", "three", None)], "item_key string, ordinal int, chunk_id string, text string, title string")
    vecs = chunk.select("item_key", "ordinal", "chunk_id", F.sha2("text", 256).alias("text_sha256"), F.array(F.col("ordinal").cast("float")).alias("vector"), F.lit("m").alias("model"))
    written = artifacts.write_npz(vecs, str(tmp_path / "npz")).collect()
    assert sorted((r.item_key, r.path.rsplit("/", 1)[1]) for r in written) == [("i", "i.embeddings.npz"), ("j/k", "j_k.embeddings.npz")]
    assert sorted(p.name for p in (tmp_path / "npz").iterdir()) == ["i.embeddings.npz", "j_k.embeddings.npz"]
    items = spark.createDataFrame([("i", "of i", "Ann", 1999)], "item_key string, title string, authors string, year int")
    got = {r.chunk_id: (r.title, r.authors, r.year, r.chunk_index) for r in stores.artifact_store(chunk, vecs, items).collect()}
    assert got == {"c0": ("of i", "Ann", "1999", 0), "c1": ("own", "Ann", "1999", 1), "c2": ("", "", None, 0)}
    with pytest.raises(InvalidParams, match="i: 2 chunks, 1 vectors"):
        stores.artifact_store(chunk, vecs.where("chunk_id <> 'c1'"), items)
    with pytest.raises(StaleArtifact, match="i "):
        stores.artifact_store(chunk.withColumn("text", F.concat("text", F.lit("!"))), vecs, items)
    with pytest.raises(Exception, match="one model"):
        artifacts.write_npz(vecs.withColumn("model", F.when(F.col("ordinal") == 0, "m")), str(tmp_path / "bad")).collect()
    with pytest.raises(InvalidParams, match="line 2"):
        (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n  \n{"id": \n')
        artifacts.require_jsonl(spark, str(tmp_path / "x.jsonl"), "id int")
    (tmp_path / "y.jsonl").write_text('{"id": 1}\r\n\r\n{"id": 2}')
    assert sorted(r.id for r in artifacts.require_jsonl(spark, str(tmp_path / "y.jsonl"), "id int").collect()) == [1, 2]


def test_index_job_runs_again_without_change(spark):
    items = spark.createDataFrame([("a", "A", [("", "Lee", None, None)]), ("b", "B", None), ("c", "C", None)], "key string, title string, creators array<struct<first_name: string, last_name: string, name: string, creator_type: string>>")
    texts = spark.createDataFrame([("a", "# One\n\nfirst text\n\n# Two\n\nsecond"), ("b", "  "), ("d", "nobody's")], "key string, text string")
    store, report = jobs.index_job(items, texts, dim=8)
    assert sorted(map(tuple, report.collect())) == [("a", "ok", 2), ("b", "skipped", 0), ("c", "skipped", 0)]
    assert sorted((r.item_key, r.authors, r.section, r.chunk_index, r.text) for r in store.collect()) == [("a", "Lee", "One", 0, "first text"), ("a", "Lee", "Two", 1, "second")]
    again, report = jobs.index_job(items, texts, store, dim=8)
    assert again.count() == 2 and {r.status for r in report.collect()} == {"skipped"}
    more = texts.withColumn("text", F.when(F.col("key") == "a", "new text").otherwise(F.col("text")))
    rebuilt, report = jobs.index_job(items, more, store, dim=8, rebuild=True)
    assert [(r.item_key, r.text) for r in rebuilt.collect()] == [("a", "new text")]


def test_ocr_job_and_engine(spark):
    class Echo:
        provider, model = "glm", "m"

        def recognise(self, pdf):
            if pdf == b"bad":
                raise ValueError("unreadable")
            return json.dumps({"md_results": "# Head\n\n" + pdf.decode()})

    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    attachments = spark.createDataFrame([("pa", "a", "x.pdf", None), ("pb", "b", "y.pdf", None), ("pd", "d", "z.pdf", None)], "key string, parent_key string, path string, content_type string")
    pdfs = spark.createDataFrame([("pa", "a", b"seen"), ("pb", "b", b"bad")], "attachment_key string, item_key string, content binary")
    found = providers.payloads(pdfs, Echo)
    blocks, chunked, report = jobs.ocr_job(items, attachments, found, items.where("key = 'd'"))
    assert sorted(map(tuple, report.collect())) == [("a", "ok", 1), ("b", "error: unreadable", 0), ("c", "error: no PDF attachment found", 0), ("d", "skipped", 0)]
    assert [(r.section_heading, r.text) for r in chunked.collect()] == [("Head", "seen")] and blocks.count() == 2
    forced = jobs.ocr_job(items, attachments, found, items, force=True)[2]
    assert {r.item_key: r.status for r in forced.collect()}["d"] == "error: no response"


def test_roles_and_requests(spark):
    e = HashingEmbedder(64)
    assert np.allclose(e.embed_query("a b"), e.embed_documents(["a b"])[0]) and not np.allclose(e.embed_query("a a b"), e.embed_documents(["a a b"])[0])
    assert np.allclose(e.embed_query("a a b"), e.embed_query("a b")) and not e.embed_query("").any() and abs(np.linalg.norm(e.embed_query("x y z")) - 1) < 1e-6
    weights = e.embed_documents(["a a a b"])[0]
    assert math.isclose(abs(weights).max() / abs(weights[weights != 0]).min(), 1 + math.log(3), rel_tol=1e-5)
    df = spark.createDataFrame([("a a b",)], "text string")
    with pytest.raises(InvalidParams):
        with_vectors(df, role="other")
    with pytest.raises(InvalidParams):
        providers.embedding_request("nobody", "m", F.array(F.lit("x")), "query")
    gemini = df.select(providers.embedding_request("gemini", "m", F.array("text"), "query").alias("j")).first()["j"]
    assert json.loads(gemini) == {"taskType": "RETRIEVAL_QUERY", "content": {"parts": [{"text": "a a b"}]}}
    voyage = df.select(providers.embedding_request("voyage", "m", F.array("text"), "document").alias("j")).first()["j"]
    assert json.loads(voyage) == {"model": "m", "input": ["a a b"], "input_type": "document"}


def test_paths_and_names(spark):
    rows = [("/mnt/c/a/b.pdf", "C:\\a\\b.pdf"), ("/mnt/d", "D:\\"), ("/mnt/data/x", "\\\\wsl.localhost\\Linux\\mnt\\data\\x"), ("rel/x", "rel/x")]
    df = spark.createDataFrame(rows, "p string, w string").withColumn("got", files.to_windows(F.col("p")))
    assert [r.got for r in df.collect()] == [w for _, w in rows]
    names = {"a.pdf": "new.pdf", "a.tar.gz": "new.gz", ".hidden": "new", "none": "new", "dot.": "new", "": "new"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.x for r in df.select("n", files.renamed(F.col("n"), F.lit("new")).alias("x")).collect()} == names
    assert df.select(files.leaf_of(F.lit("C:\\x\\y.z")).alias("l")).first()["l"] == "y.z"


def test_settings_migrate():
    stored = {"ocr.model": "glm-ocr", "rag.topK": 9, "ui.language": ""}
    legacy = {"old.rag.topK": "7", "old.ocr.model": "other", "older.ui.language": "de", "old.ui.language": "", "old.nothing": "x"}
    got = config.migrate(stored, legacy, ("old.", "older."))
    assert got == {"ocr.model": "other", "rag.topK": 9, "ui.language": "de"} and config.migrate({}, legacy, ("old.",))["rag.topK"] == 7
    assert config.migrate(stored, {}) == stored


def test_lookups_by_id_or_key(spark):
    table = spark.createDataFrame([(1, "K1"), (2, "K2"), (3, "03")], "id long, key string")
    assert [(r.pos, r.key) for r in lookups.require_id(spark, table, ["2", "K1", "03", "2"]).collect()] == [(0, "K2"), (1, "K1"), (2, "03"), (3, "K2")]
    with pytest.raises(NotFound, match="03x"):
        lookups.require_id(spark, table, ["1", "03x"])
    typed = table.withColumn("item_type", F.when(F.col("id") == 2, "note").otherwise("book"))
    assert lookups.require_kind(typed.where("id = 2"), "note").count() == 1
    with pytest.raises(Exception, match="isn't of type note"):
        lookups.require_kind(typed, "note").collect()


class _Service(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        p = ask["params"]
        if ask["method"] == "items.list":
            rows = [{"key": f"k{n}", "n": n} for n in range(23)][p["offset"] : p["offset"] + p["limit"]]
            answer = {"result": {"items": rows, "total": 23}}
        elif ask["method"] == "stuck":
            answer = {"result": [1] * p["limit"]}
        else:
            answer = {"error": {"code": -32601, "message": "unknown"}}
        body = json.dumps(answer | {"jsonrpc": "2.0", "id": ask["id"]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_rpc_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/rpc"
        client = rpc.RpcClient(url)
        assert len(client.rows("items.list", size=10)) == 23 and client.rows("items.list", size=23)[22]["n"] == 22
        with pytest.raises(rpc.RpcError, match="-32601"):
            client.call("nothing")
        with pytest.raises(InvalidParams):
            client.rows("stuck", size=3)
        spark.dataSource.register(rpc.PagedRpc)
        for more in ({}, {"total": "23"}):
            read = spark.read.format("paged_rpc").option("url", url).option("method", "items.list").option("size", "10").options(**more).load()
            assert sorted((r.position, json.loads(r.row)["key"]) for r in read.collect()) == [(n, f"k{n}") for n in range(23)]
    finally:
        server.shutdown()
    with pytest.raises(ConnectionError):
        rpc.RpcClient("http://127.0.0.1:9/rpc").call("x")


def test_stream_rewrites_only_touched_buckets(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    want = {}
    for n in range(4):
        rows = [{"chunk_id": f"c{k}", "text": f"{n}-{k}"} for k in range(n, 40, 10 if n else 1)]
        want |= {r["chunk_id"]: r["text"] for r in rows}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = ingest.chunk_stream(spark, source, "chunk_id string, text string")
        ingest.upsert_batches(stream, store, str(tmp_path / "check"), ["chunk_id"], buckets=8).awaitTermination()
        got = {r.chunk_id: r.text for r in ingest.latest(spark, store).collect()}
        assert got == want
    buckets = [p for v in (tmp_path / "store").glob("v=*") for p in v.glob("bucket=*")]
    kept = {}
    for p in buckets:
        kept.setdefault(p.name, []).append(int(re.search(r"v=(\d+)", str(p))[1]))
    assert len(kept) <= 8 and all(len(v) <= 2 for v in kept.values()) and any(min(v) == 0 for v in kept.values())


def test_folds_over_many_blocks(spark):
    from lectern.functions.folds import collecting_fold

    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.when((s["n"] + x) % 3 == 0, F.concat(s["done"], F.array(s["n"] + x))).otherwise(s["done"]).alias("done"), (s["n"] + x).alias("n"))
    for n in (0, 1, 6, 7, 8, 100):
        got = spark.range(1).select(collecting_fold(F.slice(F.sequence(F.lit(1), F.lit(max(n, 1))), 1, F.lit(n)), start, step, lambda s: F.array(s["n"]), "array<int>", block=7).alias("x")).first().x
        sums = [k * (k + 1) // 2 for k in range(1, n + 1)]
        assert got == [s for s in sums if s % 3 == 0] + [sums[-1] if sums else 0]


def test_headings_alone_are_read_once(spark):
    items = spark.createDataFrame([("a", "A", None), ("b", "B", None)], "key string, title string, creators array<struct<first_name: string, last_name: string, name: string, creator_type: string>>")
    texts = spark.createDataFrame([("a", "# One\n\n4708 only headings"), ("b", "text")], "key string, text string")
    store, report = jobs.index_job(items, texts, dim=8)
    assert sorted(map(tuple, report.collect())) == [("a", "ok", 0), ("b", "ok", 1)]
    again, second = jobs.index_job(items, texts, store, dim=8, done=report.where("status = 'ok'").select(F.col("item_key").alias("key")))
    assert sorted(map(tuple, second.collect())) == [("a", "skipped", 0), ("b", "skipped", 0)] and again.count() == 1


def test_vectors_in_double_precision(spark):
    df = spark.createDataFrame([("a a b c",), ("",)], "text string")
    fine, coarse = with_vectors(df, dim=8, dtype="float64"), with_vectors(df, dim=8)
    assert fine.schema["vector"].dataType.elementType.simpleString() == "double" and coarse.schema["vector"].dataType.elementType.simpleString() == "float"
    own, none = (r.vector for r in fine.collect())
    assert abs(sum(x * x for x in own) - 1) < 1e-15 and not any(none)
    assert abs(max(map(abs, own)) / min(abs(x) for x in own if x) - 1 - math.log(2)) < 1e-14 or len({x for x in own if x}) < 2


def test_responses_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(f"A{i}", "glm", json.dumps({"md_results": f"# H\n\none {i}\n\ntwo"}), None) for i in range(12)]
    payloads = spark.createDataFrame(rows, "attachment_key string, provider string, payload string, error string")
    attachments = spark.createDataFrame([(f"A{i}", f"K{i}", "application/pdf", "f") for i in range(12)], "key string, parent_key string, content_type string, path string")
    items = attachments.select(F.col("parent_key").alias("key"))
    blocks, chunks, report = jobs.ocr_job(items, attachments, payloads.mapInArrow(counted, payloads.schema), items.limit(0))
    assert blocks.count() == 36 and chunks.count() == 12 and {(r.status, r.chunks) for r in report.collect()} == {("ok", 1)}
    assert seen.value == 12


def test_texts_are_written_once(spark):
    """The job's report and the number of blocks: texts stand in the shared folder once, and pass no shuffle."""
    r = random.Random(4)
    texts = [f"# H\n\n{r.randbytes(5000).hex()}\n\n{r.randbytes(5000).hex()}" for _ in range(100)]
    payloads = spark.createDataFrame([(f"A{i}", "glm", json.dumps({"md_results": t}), None) for i, t in enumerate(texts)], "attachment_key string, provider string, payload string, error string")
    attachments = spark.createDataFrame([(f"A{i}", f"K{i}", "application/pdf", "f") for i in range(100)], "key string, parent_key string, content_type string, path string")
    items = attachments.select(F.col("parent_key").alias("key"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before = held()
    blocks, chunks, report = jobs.ocr_job(items, attachments, payloads, items.limit(0))
    assert blocks.groupBy("item_key").count().count() == 100 and {(x.status, x.chunks) for x in report.collect()} == {("ok", 2)}
    assert held() - before < 1.5 * sum(map(len, texts))
    assert {t for x in chunks.collect() for t in x.text.split("\n\n")} == {t for x in texts for t in x.split("\n\n")[1:]}


@pytest.mark.parametrize("structured", [True, False])
def test_headings_of_a_response(spark, structured):
    r = random.Random(structured)
    rows, want = [], []
    for i in range(60):
        parts = [(r.random() < 0.4, f"t{i} {k}") for k in range(r.randint(0, 7))]
        if structured:
            payload = {"blocks": [x for h, t in parts for x in [{"type": "title" if h else "text", "text": t}, {"type": "title", "text": " "}]]}
        else:
            payload = {"markdown": "\n \n\n".join("# " * h + t for h, t in parts)}
        rows.append((f"A{i}", f"I{i}", "p", json.dumps(payload)))
        section = ""
        for k, (h, t) in enumerate(parts):
            section = t if h else section
            own = section if structured or not h else ""
            want.append((f"A{i}:p1:b{2 * k}" if structured else f"A{i}:p0:b{k}", f"I{i}", 2 * k if structured else k, "heading" if h else "paragraph", own, t))
    got = block_ops.provider_blocks(spark.createDataFrame(rows, "attachment_key string, item_key string, provider string, payload string").repartition(3))
    assert "Exchange" not in got.select("block_id")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobinPartitioning(3)", "")
    assert sorted((x.block_id, x.item_key, x.reading_order, x.type, x.section_heading, x.text) for x in got.collect()) == sorted(want)


def test_a_response_without_an_item_and_one_of_two_items(spark):
    rows = [("A", "glm", json.dumps({"md_results": "one\n\ntwo"}), None), ("B", "glm", json.dumps({"md_results": "left out"}), None), (None, "glm", "x", None), ("D", "unheard", "{}", None)]
    payloads = spark.createDataFrame(rows, "attachment_key string, provider string, payload string, error string")
    attachments = spark.createDataFrame([("A", "a", "application/pdf", "f"), ("A", "b", "application/pdf", "f"), ("C", "c", "application/pdf", "f"), ("D", "d", "application/pdf", "f")], "key string, parent_key string, content_type string, path string")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    blocks, chunks, report = jobs.ocr_job(items, attachments, payloads, items.limit(0), max_chars=3)
    assert sorted((x.item_key, x.block_id, x.text) for x in blocks.collect()) == [(i, f"A:p0:b{k}", t) for i in "ab" for k, t in enumerate(["one", "two"])]
    assert sorted((x.item_key, x.text) for x in chunks.collect()) == [(i, t) for i in "ab" for t in ["one", "two"]]
    assert sorted(map(tuple, report.collect())) == [("a", "ok", 2), ("b", "ok", 2), ("c", "error: no response", 0), ("d", "error: unreadable response of unheard", 0)]
