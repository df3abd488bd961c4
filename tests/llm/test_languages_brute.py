"""The whole result of language identification against plain loops: counts, scores, best path, shares."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langspans

CONFIG = langspans.LangConfig()
MASK = (1 << 64) - 1


def cells(word):
    out = []
    codes = [2, *map(ord, word), 3]
    for n in CONFIG.orders:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = (h * 0x100000001B3 + c) & MASK
            out.append((((h ^ n) * 0x9E3779B97F4A7C15 & MASK) >> 40) % CONFIG.cells)
    return out


def letters(word):
    return "".join(c for c in word if c.isalpha()).lower()


def script(word):
    for c in word:
        for name, ranges in langspans.SCRIPT_RANGES.items():
            if any(a <= ord(c) <= b for a, b in ranges):
                return name
    return "other"


def predicted(rows):
    """doc_id, held_out, lang_pred, score, n_spans of (doc_id, text, lang)."""
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    langs = sorted({lang for d, t, lang in rows if fold(d) and lang})
    grams = {x: [0] * CONFIG.cells for x in langs}
    scripts = {x: {} for x in langs}
    for d, t, lang in rows:
        if fold(d) and lang:
            for w in filter(None, map(letters, (t or "").split())):
                for c in cells(w):
                    grams[lang][c] += 1
                scripts[lang][script(w)] = scripts[lang].get(script(w), 0) + 1
    total = {x: sum(grams[x]) for x in langs}
    log = {x: lambda c, x=x: float(np.float32(math.log((grams[x][c] + CONFIG.smooth) / (total[x] + CONFIG.smooth * CONFIG.cells)))) for x in langs}
    uses = {x: {s for s, n in scripts[x].items() if n >= CONFIG.script_share * max(1, sum(scripts[x].values()))} for x in langs}

    def scores(word):
        w = letters(word)
        if not w:
            return [0.0] * len(langs)
        allowed = [x for x in langs if script(w) in uses[x]] or langs
        raw = {x: sum(map(log[x], cells(w))) / len(CONFIG.orders) for x in allowed}
        top = max(raw.values())
        return [float(np.float32(max(raw[x] - top, -CONFIG.most_a_word) if x in raw else -4 * CONFIG.most_a_word)) for x in langs]

    out = []
    for d, t, _ in rows:
        words = (t or "").split()
        if not any(map(letters, words)):
            out.append((d, fold(d) == 0, "und", 0.0, 0))
            continue
        best, ways = None, [(s, [k]) for k, s in enumerate(scores(words[0]))]
        for w in words[1:]:
            own = scores(w)
            ways = [max(((v - (CONFIG.switch if path[-1] != k else 0) + own[k], [*path, k]) for v, path in ways), key=lambda x: x[0]) for k in range(len(langs))]
        best = max(ways, key=lambda x: x[0])[1]
        share = [sum(len(letters(w)) for w, k in zip(words, best) if k == j) for j in range(len(langs))]
        spans = 1 + sum(a != b for a, b in zip(best, best[1:]))
        out.append((d, fold(d) == 0, langs[share.index(max(share))], max(share) / sum(share), spans))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result(spark, seed):
    r = random.Random(seed)
    make = {"en": "the of and ing tion was", "de": "der und ung schaft ein straße", "ru": "привет мир это слово", "uk": "привіт світ це слово"}
    text = lambda lang, n: " ".join(r.choice(make[lang].split()) + r.choice(["", ",", "s", "7"]) for _ in range(n))
    rows = [(k, text(lang, r.randint(1, 25)), lang) for k, lang in enumerate(list(make) * 12)]
    rows += [(100 + k, text("en", 20) + " " + text(r.choice(["ru", "de"]), 25) + " 12 " + text("uk", 15), None) for k in range(8)]
    rows += [(200, None, "en"), (201, "", None), (202, "1 2 3", "de"), (203, "漢字 漢", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).repartition(3)
    got = {x.doc_id: (x.doc_id, x.held_out, x.lang_pred, round(x.score, 9), x.n_spans) for x in langspans.languages(df).collect()}
    assert got == {x[0]: (*x[:3], round(x[3], 9), x[4]) for x in predicted(rows)}
    assert max(x[4] for x in got.values()) > 1
