"""Groups of a million rows: members, merges, positions and store documents."""

from pyspark.sql import functions as F

from lectern import stages
from lectern.operators import aggregates, mutations, ranks, setops
from lectern.plans import files
from lectern.sources import stores

N = 1_000_000


def test_members_of_a_large_group(spark):
    items = spark.range(N + 10).select(F.format_string("k%07d", "id").alias("key"), F.when(F.col("id") < N, "same").when(F.col("id") < N + 4, "pair").when(F.col("id") < N + 6, "").otherwise(F.col("id").cast("string")).alias("doi"))
    found = aggregates.duplicate_members(items, F.col("doi"))
    rows = found.groupBy("group_key", "head", "size").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in rows} == {("same", "k0000000", N, N), ("pair", f"k{N:07d}", 4, 4)}


def test_merge_of_a_large_set(spark):
    n = 200_000
    fields = F.map_from_arrays(F.array(F.lit("DOI"), F.lit("date"), F.lit("extra")), F.array(F.when(F.col("id") == 7, "10.1/7").otherwise(""), F.col("id").cast("string"), F.lit("")))
    items = spark.range(n + 1).select(F.format_string("k%07d", "id").alias("key"), F.concat(F.lit("t"), "id").alias("title"), F.array(F.struct(F.concat(F.lit("tag"), F.col("id") % 3).alias("tag"), F.lit(0).alias("type"))).alias("tags"), F.array(F.lit("C")).alias("collections"), fields.alias("fields"))
    sets = items.where("key < 'k0200000'").select("key", F.lit("k0000000").alias("head"))
    got = {r.key: r for r in aggregates.merge_duplicates(items, sets).collect()}
    assert set(got) == {"k0000000", "k0200000"}
    head = got["k0000000"]
    assert (head.title, head.tags, head.collections, head.fields, head.merged) == ("t0", ["tag0", "tag1", "tag2"], ["C"], {"DOI": "10.1/7", "date": "0"}, n)
    assert got["k0200000"].fields == {"date": "200000"} and got["k0200000"].merged == 1


def test_positions_in_a_large_group(spark):
    own = spark.range(N).select(F.lit("hot").alias("g"), F.xxhash64("id").alias("k"))
    placed = ranks.positions(own, ["g"], ["k"])
    row = placed.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(row) == (0, N - 1, N)
    assert placed.where("position < 3").orderBy("position").collect() == own.orderBy("k").limit(3).withColumn("position", F.monotonically_increasing_id()).collect()


def _written(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_places_write_rows_once(spark, tmp_path, monkeypatch):
    """What positions writes is the rows in their ranges, and no second copy of them."""
    monkeypatch.setattr(stages, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    own = spark.range(2000).select((F.col("id") % 7).alias("g"), "id", F.concat(*[F.sha2(F.concat(F.lit(str(k)), "id"), 512) for k in range(8)]).alias("text"))
    own.write.parquet(f"{tmp_path}/own")
    placed = ranks.positions(own, ["g"], ["id"])
    assert placed.agg(F.sum("position")).first()[0] == sum(k // 7 for k in range(2000))
    assert _written(tmp_path / "shared") < 1.3 * _written(tmp_path / "own")


def test_places_of_chunks_move_no_texts(spark, tmp_path, monkeypatch):
    """The store's query finds places among ids: below the shared folder, ranks hold no texts."""
    n = 300
    text = F.concat(*[F.sha2(F.concat(F.lit(str(k)), "id"), 512) for k in range(40)])
    spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.length(text).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(stages, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    rows = files.artifact_store(spark, f"{tmp_path}/in").collect()
    assert sorted((r.item_key, r.chunk_index, int(r.chunk_id)) for r in rows) == sorted((f"s{k % 3}", k // 3, k) for k in range(n))
    assert _written(tmp_path / "shared") < 0.2 * _written(tmp_path / "in")


def test_documents_of_a_large_collection(spark, tmp_path):
    n = 100_000
    row = spark.range(n).select(F.lit("C").alias("collection"), F.lit("1").alias("collection_id"), F.lit("m").alias("model"), F.format_string("i%03d", F.col("id") % 100).alias("item_key"), F.lit("t").alias("title"), F.lit("a").alias("authors"), F.lit("s").alias("section"), F.col("id").cast("int").alias("chunk_index"), F.lit("x").alias("text"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    assert {r.part: r.size for r in stores.store_documents(row, 30_000).select("part", F.size(F.from_json("document", stores.DOCUMENT)["chunks"]).alias("size")).collect()} == {0: 30_000, 1: 30_000, 2: 30_000, 3: 10_000}
    stores.export_store(row, f"{tmp_path}/documents")
    back = stores.import_store(spark, f"{tmp_path}/documents")
    assert back.count() == n and back.agg(F.count_distinct("chunk_index")).first()[0] == n


ITEM = "key string, title string, fields map<string, string>, tags array<struct<tag: string, type: int>>"


def test_repeated_keys_of_changes(spark):
    items = spark.createDataFrame([("a", "A", {"x": "1"}, [("old", 1)]), ("b", "B", {}, [])], ITEM)
    changes = spark.createDataFrame([("a", {"x": "2"}, "first", 1), ("a", {"x": "3"}, "last", 2)], "key string, fields map<string, string>, title string, n int")
    got = mutations.update_items(items, changes, F.col("n")).orderBy("key").collect()
    assert [(r.key, r.title, r.fields) for r in got] == [("a", "last", {"x": "3"}), ("b", "B", {})]
    operations = spark.createDataFrame([("a", ["n2", "n1"], ["old"]), ("a", ["n1", "n3"], []), ("b", None, None)], "key string, add array<string>, remove array<string>")
    got = setops.batch_tags(items, operations).orderBy("key").collect()
    assert [(r.key, sorted(t.tag for t in r.tags)) for r in got] == [("a", ["n1", "n2", "n3"]), ("b", [])]
