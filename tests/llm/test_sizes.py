"""The same result on both sides of a size: large Poisson means, windows of any length, encoders, workspaces of other threads."""

import hashlib
import math
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import common, mixing, pieces, quality_rules, registry, sst


def inverse(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def share(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / (1 << 48)


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_draws_as_rows_equal_draws_in_the_row(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "PART_RATE", 1.5)
    monkeypatch.setattr(mixing, "BLOCK", block)
    docs = spark.createDataFrame([(1, "x", "tiny"), (1, "x", "tiny"), (2, "yy", "tiny"), (3, "z" * 300, "large"), (4, None, "large"), (5, "w" * 40, None)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    want = Counter()
    for doc_id, text, source in [tuple(r) for r in docs.collect()]:
        rate = rates[source or ""]
        name = f"42|{doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}"
        parts = math.ceil(rate / 1.5)
        n = inverse(share(name), rate) if parts <= 1 else sum(inverse(share(f"{name}|part|{k}"), rate / parts) for k in range(1, parts + 1))
        want.update((doc_id, copy, hashlib.md5(f"{name}|{copy}".encode()).hexdigest()) for copy in range(n))
    assert Counter(tuple(r) for r in mixing.mix(docs).select("doc_id", "copy", "mix_key").collect()) == want
    assert max(want.values()) == 2 and max(x[1] for x in want) > 20


def test_a_source_of_one_character(spark):
    docs = spark.createDataFrame([(k, "t" * 1000, "large") for k in range(150)] + [(1000, "x", "tiny")], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count_distinct("doc_id", "copy").alias("rows"), F.max("copy").alias("last")).collect()
    chars = {r.source: r.chars for r in got}
    # a rate of 75,000 is above PART_RATE * BLOCK
    assert chars["tiny"] == pytest.approx(75_000, rel=0.05) and chars["large"] == pytest.approx(75_000, rel=0.4)
    assert {r.source: r.last + 1 for r in got}["tiny"] == chars["tiny"] == {r.source: r.rows for r in got}["tiny"]


@pytest.mark.parametrize("most", [0, 1, 4, 5, 63, 64, 65, 200])
def test_numbered(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = spark.createDataFrame([(k,) for k in {0, 1, most // 2, most}], "n long")
    got = Counter((r.n, r.k) for r in mixing.numbered(rows, "n", "k", most).collect())
    assert got == Counter((n, k) for n in {0, 1, most // 2, most} for k in range(n))


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 6, 7, 11])
def test_windows_of_any_length(spark, window):
    r = random.Random(window)
    texts = [" ".join(r.choices("abcde", k=r.randint(0, 40))) for _ in range(60)] + ["a b c x y z a b c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.quality_report(docs, rules=quality_rules.LineRules(window=window)).collect()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        twice = Counter(grams)
        assert got[k] == len({i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(window)}), (window, text)


def test_encoders_that_disagree_raise(monkeypatch):
    encoder = sst.WordEncoder(registry.tokenizer_path("byte_bpe_50k.json"))
    monkeypatch.setattr(encoder, "_by_words", lambda texts: [b"\0\0"] * len(texts))
    with pytest.raises(ValueError, match="by_word=False"):
        encoder.encode(["some text"])
    whole = sst.WordEncoder(registry.tokenizer_path("byte_bpe_50k.json"), by_word=False)
    assert not whole.by_word and whole.encode(["some text"]) == sst.WordEncoder(registry.tokenizer_path("byte_bpe_50k.json")).encode(["some text"])
    path = registry.tokenizer_path("piece_bpe_32k.model")
    agenda = pieces.Agenda(path)
    monkeypatch.setattr(agenda, "cut", lambda t: ["▁other"])
    with pytest.raises(ValueError, match="by_word=False"):
        agenda.encode_batch(["some text"])
    assert pieces.Agenda(path, by_word=False).encode_batch(["some  text"]) == pieces.Agenda(path).encode_batch(["some  text"])


def test_words_encoded_together(monkeypatch):
    encoder = sst.WordEncoder(registry.tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["a", "Bc", "é", "中", "\u00a0", "\u2003", "\x1f", "\x85", "7", "'s", "'", ".", "\t", "\n", "\u200b", "😀", "Ċ"]
    words = list(dict.fromkeys(["don't", "x\ny", "\n", "tail\u00a0", *("".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(3000))]))
    want = encoder._encode([" " + w for w in words])
    for most in (1, 7, 1024):
        monkeypatch.setattr(encoder, "WORDS_AT_ONCE", most)
        assert encoder._encode_words(words) == want
    # a line feed that isn't where it should be: each word by itself
    monkeypatch.setattr(encoder, "feed", 0)
    assert encoder._encode_words(words) == want and encoder._encode_words([]) == []


def test_released_spares_other_threads(spark):
    inside, done, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        kept.append(common.Workspace(spark, "other").put(spark.range(3), "t"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    before = common.Workspace(spark, "before").put(spark.range(2), "t")
    with common.released(spark):
        own = common.Workspace(spark, "own").put(spark.range(4), "t")
        with common.released(spark):
            common.Workspace(spark, "inner").put(spark.range(1), "t")
        assert own.count() == 4
        inside.set()
        done.wait(60)
    thread.join()
    assert kept[0].count() == 3 and before.count() == 2
    with pytest.raises(Exception, match="(?i)file|path"):
        own.count()
