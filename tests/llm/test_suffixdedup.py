"""Repeated passages against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from lectern.llm import deepshallow, suffixdedup


def brute(texts, n=200):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = [" ".join(word() for _ in range(r.randint(30, 120))) for _ in range(6)]
    texts = ["", "a" * 199, "a" * 200, "a" * 700, "ab" * 400, passage[0], passage[0], "x" + passage[0][:210], passage[1] + passage[1]]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, 200)
            parts += [p[a : a + r.randint(150, 700)], word()]
        texts.append(" ".join(parts))
    texts += [texts[20]] * 3 + [texts[21] + "!"]
    return texts


def test_deep_shallow_order():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(500)] + [b"", b"", b"a" * 100, b"a" * 99]
    for shallow in (0, 8, 16, 64):
        order = deepshallow.deep_shallow_order(strings, shallow)
        assert [strings[k] for k in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    prefixed = [b"12345678" * 2 + s for s in strings]
    assert [prefixed[k] for k in deepshallow.deep_shallow_order(prefixed, start=16)] == sorted(prefixed)


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 1 << 10)
    texts = [b"q" * 5000, b"w" * 1024, b"e" * 1025, b"", b"z" * 199]
    seen = Counter()
    for own in suffixdedup._pieces(texts, 200):
        for k, at, part in own:
            seen.update((k, at + i) for i in range(len(part) - 199))
    assert set(seen.values()) == {1} and len(seen) == 4801 + 825 + 826


@pytest.mark.parametrize("most_in_group", [512, 3])
def test_against_brute_force(spark, most_in_group):
    texts = corpus()
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.repeat_digests(spark, docs, most_in_group=most_in_group).collect()}
    want = brute([t.encode() for t in texts])
    assert got.pop(None) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert [got[k] for k in range(len(texts))] == want


def test_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "x" * 300, 5), (2, "x" * 300, 6), (3, None, 7), (4, "é" * 150 + "y", 8)], "doc_id long, text string, dk int")
    out = {r.doc_id: r for r in suffixdedup.without_repeats(spark, docs).collect()}
    assert out[1].text == "" and out[2].text == "" and out[3].text is None and out[1].dk == 5 and len(out) == 4
    assert suffixdedup.without_repeats(spark, docs.limit(0)).count() == 0
    assert suffixdedup.repeat_digests(spark, docs.limit(0)).count() == 0
