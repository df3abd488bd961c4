"""Positions, sums and neighbours over hot groups against plain Python; chunks between headings."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks, ranks


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(None if k % 11 == 0 else "hot" if k % 3 else f"g{k % 7}", k, r.randint(-3, 9)) for k in r.sample(range(2000), 900)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, k int, v int").repartition(6).cache()


def grouped(rows):
    out = {}
    for g, k, v in sorted(rows, key=lambda x: x[1]):
        out.setdefault(g, []).append((k, v))
    return out


def test_positions(frame, rows):
    got = {(x.g, x.k): x.position for x in ranks.positions(frame, ["g"], ["k"]).collect()}
    assert got == {(g, k): n for g, own in grouped(rows).items() for n, (k, _) in enumerate(own)}


def test_numbers_and_sums(frame, rows):
    order = sorted(rows, key=lambda x: x[1])
    got = {x.k: x.number for x in ranks.numbered(frame, ["k"]).collect()}
    assert got == {k: n for n, (_, k, _) in enumerate(order)}
    sums, total = {}, 0
    for _, k, v in order:
        total += v
        sums[k] = total
    assert {x.k: x.total for x in ranks.running(frame, ["k"], F.col("v"), "total").collect()} == sums


def test_previous(frame, rows):
    got = {(x.g, x.k): (x.before, x.last) for x in ranks.with_previous(frame, ["g"], ["k"], {"before": "v", "last": "k"}).collect()}
    want = {}
    for g, own in grouped(rows).items():
        for n, (k, _) in enumerate(own):
            want[g, k] = (own[n - 1][1], own[n - 1][0]) if n else (None, None)
    assert got == want


def test_no_window_over_a_group(frame):
    """A window's partition is a range, or holds a row a range."""
    plan = ranks.positions(frame, ["g"], ["k"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "g string, k int, v int")
    assert ranks.positions(none, ["g"], ["k"]).count() == 0 and ranks.running(none, ["k"], F.col("v"), "s").count() == 0 and ranks.with_previous(none, ["g"], ["k"], {"b": "v"}).count() == 0


BLOCK = "attachment_key string, reading_order int, block_id string, item_key string, type string, page int, bbox array<double>, section_heading string, text string, caption string, image_ref string, provenance_strength string"


@pytest.mark.parametrize("max_chars", [1, 12, 1000])
def test_chunks_of_a_hot_attachment(spark, max_chars):
    r = random.Random(max_chars)
    rows, section = [], {}
    for k in range(1500):
        a = "hot" if k % 4 else f"a{k % 5}"
        if r.random() < 0.1:
            section[a] = f"s{k}"
            rows.append((a, k, f"{a}:{k}", "i", "heading", 1, None, section[a], section[a], None, None, "weak"))
        else:
            rows.append((a, k, f"{a}:{k}", "i", r.choice(["paragraph", "table"]), k, None, section.get(a, ""), "x" * r.randint(1, 9), None, None, r.choice(["weak", "strong"])))
    found = {}
    for x in blocks.chunk_blocks(spark.createDataFrame(rows, BLOCK).repartition(7), max_chars).collect():
        found.setdefault(x.attachment_key, []).append(x)
    text = {x[2]: x[8] for x in rows}
    kind = {x[2]: x[4] for x in rows}
    for a, chunks in found.items():
        chunks.sort(key=lambda c: int(c.chunk_id.rpartition(":c")[2]))
        assert [int(c.chunk_id.rpartition(":c")[2]) for c in chunks] == list(range(len(chunks)))
        own = [x for x in rows if x[0] == a]
        # every block but headings stands in one chunk, in order
        assert [b for c in chunks for b in c.block_ids] == [x[2] for x in own if x[4] != "heading"]
        place = {x[2]: n for n, x in enumerate(own)}
        for c, after in zip(chunks, [*chunks[1:], None]):
            size = sum(len(text[b]) for b in c.block_ids)
            assert size <= max_chars or len(c.block_ids) == 1
            assert c.text == "\n\n".join(text[b] for b in c.block_ids) and c.char_end == len(c.text) and set(c.block_types) == {kind[b] for b in c.block_ids}
            # no chunk runs over a heading, and none could have taken the next block
            assert place[c.block_ids[-1]] - place[c.block_ids[0]] == len(c.block_ids) - 1
            if after and place[after.block_ids[0]] == place[c.block_ids[-1]] + 1:
                assert size + len(text[after.block_ids[0]]) > max_chars
