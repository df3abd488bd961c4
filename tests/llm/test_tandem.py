"""Periodic runs against brute force: random strings, planted repetitions, and the whole query on a small table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import registry, tandem

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(part):
    return next(p for p in range(1, len(part) + 1) if all(part[i] == part[i + p] for i in range(len(part) - p)))


def brute(words, rules):
    out, n = [], len(words)
    for q in range(1, n // rules.min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(rules.min_words, rules.min_exponent * q) and smallest_period(words[i : i + size]) == q:
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def found(texts, rules):
    at = np.cumsum([0] + [len(x) for x in texts])
    start, length, period = tandem.runs_in_texts(np.array([x for w in texts for x in w], np.int64), at, rules)
    text = np.searchsorted(at, start, side="right") - 1
    return [[(int(s - at[k]), int(n), int(p)) for t, s, n, p in zip(text, start, length, period) if t == k] for k in range(len(texts))]


def planted(r, letters, n):
    out = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        a = r.randint(0, len(out))
        out[a:a] = out[a : a + r.randint(1, 12)] * r.randint(1, 7)
    return out


@pytest.mark.parametrize("rules", [tandem.RunRules(), tandem.RunRules(2, 2), tandem.RunRules(6, 2), tandem.RunRules(5, 3), tandem.RunRules(9, 4)])
def test_runs_of_random_texts(rules):
    r = random.Random(11)
    for _ in range(300):
        letters = r.randint(1, 5)
        texts = [planted(r, letters, r.randint(0, 60)) for _ in range(r.randint(1, 4))]
        assert found(texts, rules) == [brute(t, rules) for t in texts]


def test_vocabulary_is_complete():
    r = random.Random(5)
    for _ in range(200):
        s = planted(r, r.randint(1, 3), 25)
        text = np.array([*s, 99], np.int64)
        ext = tandem.Extensions(text)
        start, half = tandem.covering_squares(ext)
        kept = tandem.primitive(ext, start, half)
        if not kept.any():
            continue
        node, length = tandem.SuffixTree(text, ext).walks(start[kept], half[kept])
        first = ext.suffixes[tandem.SuffixTree(text, ext).left[node]]
        got = {tuple(text[i : i + n].tolist()) for i, n in zip(first.tolist(), length.tolist())}
        all_squares = {tuple(s[i : i + 2 * k]) for k in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * k + 1) if s[i : i + k] == s[i + k : i + 2 * k]}
        primitive = {x for x in all_squares if not any(len(x) // 2 % d == 0 and x[: len(x) // 2] == x[:d] * (len(x) // 2 // d) for d in range(1, len(x) // 2))}
        assert got == primitive


def expected(doc_id, text):
    words, h = WORDS.findall(text or ""), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    rules = tandem.RunRules()
    runs = brute(words, rules)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    voc = ["a", "b", "é", "wörd", "x.", "中文", "nb sp"]
    rows = [(None, "a " * 30), (0, None), (1, ""), (2, " \n\t "), (3, "a\x0bb\x0cc " * 9), (3, "a\x0bb\x0cc " * 9)]
    rows += [(k, r.choice([" ", "\n", "  "]).join(voc[x % len(voc)] for x in planted(r, r.choice([2, 7, 50]), r.randint(0, 90)))) for k in range(4, 300)]
    rows.append((1000, " ".join(f"w{k % 700}" for k in range(3000)) + " " + " ".join(["x y z"] * 400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("runs", F.lit(1))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: tuple((v is not None, v) for v in x)
    want = [expected(*x) for x in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(x[1] > 0 for x in want) > 30 and max(x[1] for x in want) > 1


def test_long_and_hostile_texts(spark):
    r = random.Random(4)
    period = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    texts = [" ".join(["a"] * 300_000), " ".join(period * 4), " ".join(f"u{k}" for k in range(200_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in tandem.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 300_000, 1)] and got[0].collapsed == "a"
    assert (0, 160_000, 40_000) in [tuple(x) for x in got[1].runs] and got[1].collapsed.startswith(" ".join(period[:100]))
    assert got[2].runs == [] and got[2].collapsed == texts[2]


def test_empty_table(spark):
    assert tandem.run_digests(tandem.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_exponent_below_two(spark):
    with pytest.raises(ValueError):
        tandem.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), tandem.RunRules(24, 1))
