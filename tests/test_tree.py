"""Paths of deep trees: the same as a walk gives, without whole paths of all rows on disk."""

import random

import pytest

from lectern.operators import hierarchy
from lectern.stages import Stages


def walked(rows):
    """key: (depth, path, sort_path); None for what hangs on a cycle."""
    by, found = {k: (n, p) for k, n, p in rows}, {}
    for key in by:
        way, at = [], key
        while at in by and at not in way:
            way.append(at)
            at = by[at][1]
        lost = at in by
        found[key] = (None, None, None) if lost else (len(way) - 1, "/".join(by[k][0] for k in reversed(way)), "/".join(reversed(way)))
    return found


@pytest.mark.parametrize("reach", [2, 4, 128])
def test_paths_of_a_random_tree(spark, reach):
    r = random.Random(reach)
    rows = [(f"k{i}", f"n{i % 5}", f"k{max(0, i - r.choice([1, 1, 1, 2, 9]))}" if i else None) for i in range(150)]
    rows += [("o", "orphan", "gone"), ("p", "below", "o"), ("x", "x", "y"), ("y", "y", "x"), ("z", "z", "y")]
    got = hierarchy.tree(spark.createDataFrame(rows, "key string, name string, parent_key string"), reach=reach).collect()
    assert {g.key: (g.depth, g.path, g.sort_path) for g in got} == walked(rows) and len(got) == len(rows)
    assert {g.key: (g["name"], g.parent_key) for g in got} == {k: (n, p) for k, n, p in rows}


def test_a_chain_writes_few_whole_paths(spark, monkeypatch):
    written, put = [], Stages.put

    def noted(self, df, name):
        out = put(self, df, name)
        if "sort_path" in out.columns:
            written.append(out.selectExpr("coalesce(sum(length(sort_path)), 0) AS n").first().n)
        return out

    monkeypatch.setattr(Stages, "put", noted)
    rows = [(f"{i:04}", "n", f"{i - 1:04}" if i else None) for i in range(400)]
    got = hierarchy.tree(spark.createDataFrame(rows, "key string, name string, parent_key string"), reach=16)
    whole = got.selectExpr("sum(length(sort_path)) AS n").first().n
    assert whole > 390_000 and max(written) < whole / 10
