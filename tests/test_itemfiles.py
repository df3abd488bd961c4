"""Item files as a data source: what is written is read back, a failed job leaves nothing, filters choose the files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull

from lectern.sources import artifacts, itemfiles


def rows(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("k/"), (F.col("id") % 5).cast("string")).alias("item_key"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("text é\n"), "id").alias("text"), F.concat(F.lit("c"), "id").alias("chunk_id")).repartition(7)


def test_lines(spark, tmp_path):
    written = {x.item_key: x for x in itemfiles.write_items(rows(spark), str(tmp_path), "chunks").collect()}
    assert sorted(os.listdir(tmp_path)) == ["_written", *[f"k_{k}.chunks.jsonl" for k in range(5)]]
    for k in range(5):
        data = (tmp_path / f"k_{k}.chunks.jsonl").read_bytes()
        want = [{"chunk_id": f"c{j}", "item_key": f"k/{k}", "ordinal": j, "text": f"text é\n{j}"} for j in range(k, 40, 5)]
        assert [json.loads(x) for x in data.decode().splitlines()] == want and list(json.loads(data.decode().split("\n")[0])) == sorted(want[0])
        assert (written[f"k/{k}"].n_bytes, written[f"k/{k}"].sha256) == (len(data), hashlib.sha256(data).hexdigest())
    back = itemfiles.read_item_rows(spark, str(tmp_path), "chunks", "ordinal int, text string")
    assert back.count() == 40 and {x.item_key for x in back.collect()} == {f"k_{k}" for k in range(5)}
    one = itemfiles.read_items(spark, str(tmp_path), "chunks").where("item_key = 'k/3' AND line > 2")
    assert {x.item_key for x in one.collect()} == {"k/3"} and one.count() == 6


def test_vectors_and_zips(spark, tmp_path):
    vecs = rows(spark).select("item_key", "ordinal", "chunk_id", F.sha2("text", 256).alias("text_sha256"), F.array(F.col("ordinal").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.lit("m").alias("model"))
    assert itemfiles.write_items(vecs, f"{tmp_path}/npz", "npz").count() == 5
    back = itemfiles.read_items(spark, f"{tmp_path}/npz", "npz").where(F.col("item_key").isin("k/1", "k/2")).collect()
    assert {(x.item_key, x.chunk_id, x.vector[0]) for x in back} == {(f"k/{k}", f"c{j}", float(j)) for k in (1, 2) for j in range(k, 40, 5)}
    zips = spark.range(6).select(F.concat(F.lit("z"), "id").alias("item_key"), F.lit("glm").alias("provider"), F.to_json(F.struct("id")).alias("payload"))
    assert itemfiles.write_items(zips, f"{tmp_path}/zip", "zip").count() == 6
    members = itemfiles.read_items(spark, f"{tmp_path}/zip", "zip").where("member = 'provider_raw.json'").collect()
    assert {(x.item_key, json.loads(x.text)["id"]) for x in members} == {(f"z{k}", k) for k in range(6)}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    bad = rows(spark).withColumn("text", F.when(F.col("item_key") == "k/4", F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken row"):
        itemfiles.write_items(bad, str(tmp_path), "chunks")
    assert [x for _, _, names in os.walk(tmp_path) for x in names] == []
    mixed = rows(spark).select("item_key", "ordinal", "chunk_id", F.lit("s").alias("text_sha256"), F.array(F.lit(1.0)).alias("vector"), F.when(F.col("ordinal") == 7, "m").otherwise("n").alias("model"))
    with pytest.raises(Exception, match="one model"):
        itemfiles.write_items(mixed, str(tmp_path), "npz")
    assert [x for _, _, names in os.walk(tmp_path) for x in names] == []


def test_only_files_asked_for_are_opened(spark, tmp_path, monkeypatch):
    itemfiles.write_items(rows(spark), str(tmp_path), "chunks").count()
    (tmp_path / "k_1.raw.zip").write_bytes(b"never opened")

    def opened(*filters):
        reader = itemfiles.ItemReader(str(tmp_path), "chunks")
        rest = list(reader.pushFilters(filters))
        return rest, [[os.path.basename(p) for _, p in b.files] for b in reader.partitions()]

    other = IsNotNull(("item_key",))
    assert opened() == ([], [[f"k_{k}.chunks.jsonl" for k in range(5)]])
    assert opened(other, EqualTo(("item_key",), "k/2")) == ([other], [["k_2.chunks.jsonl"]])
    assert opened(In(("item_key",), ("k/0", "k/4", "none")), EqualTo(("item_key",), "k/4")) == ([], [["k_4.chunks.jsonl"]])
    monkeypatch.setattr(itemfiles, "BUNDLE_FILES", 2)
    assert [len(b) for b in opened()[1]] == [2, 2, 1]


def test_empty_and_unknown(spark, tmp_path):
    assert itemfiles.write_items(rows(spark).limit(0), str(tmp_path), "blocks").count() == 0
    assert itemfiles.read_items(spark, str(tmp_path), "blocks").count() == 0
    with pytest.raises(Exception, match="kind of"):
        itemfiles.read_items(spark, str(tmp_path), "nonsense").count()


def test_a_repeated_job_replaces_files(spark, tmp_path):
    itemfiles.write_items(rows(spark), str(tmp_path), "chunks").count()
    itemfiles.write_items(rows(spark, 10), str(tmp_path), "chunks").count()
    assert itemfiles.read_items(spark, str(tmp_path), "chunks").count() == 10
    assert artifacts.item_keys(spark, str(tmp_path), artifacts.CHUNKS).count() == 5
