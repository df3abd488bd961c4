"""Importance resampling against a plain recount, rank offsets against sorting, and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import importance, registry
from lectern.llm.common import Workspace

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def buckets(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(docs, target):
    own, want = collections.Counter(), collections.Counter()
    for _, t in docs:
        own.update(buckets(t)[1])
    for t in target:
        want.update(buckets(t)[1])
    s_all, t_all, rows = own.total(), want.total(), []
    for k, (doc_id, text) in enumerate(docs):
        n, cells = buckets(text)
        weight = sum(math.floor(1000 * math.log((want[b] + 1) * (s_all + 10_000) / ((own[b] + 1) * (t_all + 10_000)))) for b in cells)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(cells), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    return sorted(((*r[:4], able.index(r) + 1 if r in able and able.index(r) < 5 * len(able) // 100 else None) for r in rows), key=str)


def random_docs(r, n):
    voc = ["a", "B1", "éé", "Wörd", "x", "中文", "İ", "z" * 300, "0"] + [f"w{k}" for k in range(60)]
    return [(k, r.choice([" ", "-", "\n", "\x7f", "\x00"]).join(r.choices(voc, k=r.choice([0, 5, 19, 20, 21, 60])))) for k in range(n)]


def test_query_against_recount(spark, tmp_path):
    r = random.Random(8)
    docs = random_docs(r, 400) + [(1000, None), (None, "p q " * 15), (1001, ""), (1002, "É" * 40)]
    target = [" ".join(r.choices(["w1", "w2", "w3", "a", "Wörd"], k=30)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("weight", F.lit(1))
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.op12_importance_draw(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, target)


def test_checksums_of_joined_words():
    r = random.Random(1)
    sums = importance.Checksums()
    for _ in range(300):
        a, b = (bytes(r.randrange(256) for _ in range(r.randint(0, 255))) for _ in range(2))
        moved = sums.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("scores", [[5] * 40, list(range(-50, 50)), [-(1 << 49), 1 << 49, 0, 0, -1, 4095, 4096, -4096, -4097], [k // 7 * 1000 - 9000 for k in range(200)], [3]])
def test_rank_offsets(spark, scores):
    frame = spark.createDataFrame([(x,) for x in scores], "score long").repartition(3)
    for most in (0, 1, 3, 17, len(scores), len(scores) + 5):
        want = {(x, sum(y > x for y in scores)) for x in scores}
        got = {(x.score, x.offset) for x in importance.rank_offsets(Workspace(spark, "t"), frame, most).collect()}
        assert got == {(x, n) for x, n in want if n < most}


def test_repeated_rows_share_ranks(spark):
    docs = [(7, "same words " * 20)] * 60 + [(k, f"other{k} words " * 20) for k in range(100, 140)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("same words",)], "text string")
    got = importance.importance_draw(spark, frame, target)
    assert sorted(x.rank for x in got.where("rank IS NOT NULL").collect()) == [1, 2, 3, 4, 5] and got.count() == 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    assert importance.importance_draw(spark, none, some).count() == 0
    got = importance.importance_draw(spark, some, none).collect()
    assert len(got) == 1 and got[0]["rank"] is None and got[0].n_features == 30 + 29 + 28


def test_drawn_documents(spark):
    docs = spark.createDataFrame([(k, f"w{k % 9} " * 30, "x") for k in range(100)], "doc_id long, text string, rank string")
    drawn = importance.importance_draw(spark, docs, spark.createDataFrame([("w1 w1",)], "text string"))
    got = importance.drawn_documents(docs, drawn).orderBy("rank").collect()
    assert [x["rank"] for x in got] == [1, 2, 3, 4, 5] and all(x.text.startswith("w1") for x in got)
