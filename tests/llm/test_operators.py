"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, htmlrender, langspans, mixing, ogg, pieces, pulearn, quality_rules, registry, simhash, sst

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "one two", "a b c", "A B C", "x\x0by\x0cz\r\nq", "　 w", "#$% <b> | a & b * c"]
    for _ in range(n):
        words = [r.choice(vocabulary) + r.choice(["", "", ".", ","]) for _ in range(r.randint(1, 90))]
        if r.random() < 0.3:
            words += words[:20]
        texts.append("".join(w + r.choice([" ", " ", " ", "\n", "  "]) for w in words))
    for k in range(20, 40):
        words = texts[k].split(" ")
        words[len(words) // 2] = "changed"
        texts += [texts[k], " ".join(words)]
    texts.append(" ".join(r.choice(vocabulary) for _ in range(30_000)))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else "de", None if k % 11 == 0 else f"s{k % 4}", k * 2) for k, t in enumerate(corpus())]
    rows += [rows[30], (None, "a null id here", None, None, None), (None, None, None, None, None)]
    # clashing and odd column names
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long").withColumns({"key": F.lit(1), "fp": F.lit("x"), "n_words": F.lit(2), "h": F.lit(3), "odd name": F.lit(4)}).repartition(7).cache()


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules(spark, docs):
    got = quality_rules.quality_report(docs).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (d, t), n in texts.items():
        want[(d, *base(t))] += n
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    clean = quality_rules.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == sum(r.kept for r in got)
    assert quality_rules.quality_report(docs.limit(0)).count() == 0


def test_line_rules(spark):
    cases = {
        "A plain sentence of words.": True, "": True, "  ": True, "no end of sentence": False, "Home": False, "Home | About | News | Mail.": False, "ALL OF THIS LINE IS SHOUTED!": False,
        "Licensed under CC BY 4.0.": False, "An essay on why all rights reserved notices fail, " + "with many words " * 12 + ".": True, "a## b## c## d.": False, "Call 555-0100": True, "He said “yes.”": True, "ABC. DEF.": True,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, line string")
    got = {r.line: r.ok for r in df.select("line", quality_rules.line_passes(F.col("line")).alias("ok")).collect()}
    assert got == cases


def simhash_brute(texts):
    import xxhash

    fps = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    return fps


def components_brute(fps, ids):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {}
    for x, d in zip(root, ids):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return [least.get(x) for x in root]


def wide_groups_brute(texts, ids):
    """Smallest id of each text's group by the wider relation: fingerprints over different words, and over shingles."""
    import xxhash

    shingles, fps = simhash_brute(texts), []
    for t, few in zip(texts, shingles):
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())))
        hs = [xxhash.xxh64_intdigest(w, 42) for w in words]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if len(words) >= 16 else few)
    second = {}
    for f, x in zip(fps, shingles):
        second[f] = min(second.get(f, x), x, key=simhash._signed)
    root = {f: f for f in second}
    for a in second:
        for b in second:
            if root[a] != root[b] and (a ^ b).bit_count() <= 7 and (second[a] ^ second[b]).bit_count() <= 16:
                old, new = root[a], root[b]
                root = {f: new if x == old else x for f, x in root.items()}
    least = {}
    for f, d in zip(fps, ids):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    return [least.get(root[f]) for f in fps]


def test_simhash(spark, docs):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.text is None or len(r.text) < 5000]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fps = simhash_brute([r.text for r in rows])
    want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], components_brute(fps, [r.doc_id for r in rows])))
    assert Counter(tuple(r) for r in simhash.groups(spark, own).collect()) == want
    first = simhash.one_of_each(spark, docs)
    assert first.columns == docs.columns
    every = docs.select("doc_id", "text").collect()
    assert {r.doc_id for r in first.collect()} == set(wide_groups_brute([r.text for r in every], [r.doc_id for r in every]))
    assert simhash.groups(spark, docs.limit(0)).count() == 0 and simhash.one_of_each(spark, docs.limit(0)).count() == 0


def test_one_of_each_keeps_smallest(spark):
    texts = ["same words in this very text"] * 3 + ["something else that stands quite alone"]
    rows = spark.createDataFrame([(9, texts[0]), (4, texts[1]), (4, texts[2]), (None, texts[0]), (7, texts[3])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(spark, rows).collect()) == [4, 7]


def test_crowded_buckets_lose_nothing(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(150):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    fps |= {r.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    space = common.Workspace(spark, "test_links")
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    from lectern.llm.components import components

    edges = simhash.links(space, frame, most_in_bucket=40)
    root = {row.node: row.root for row in components(space, edges).collect()}
    got = [root.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = components_brute(fps, list(range(len(fps))))
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_crowded_buckets_of_words_lose_nothing(spark):
    from lectern.llm.components import components

    r = random.Random(4)
    fps = {}
    for _ in range(3):
        centre, other = r.getrandbits(64), r.getrandbits(64)
        for _ in range(100):
            fps[centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7)))] = other ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 18)))
    for _ in range(50):
        fps[r.getrandbits(64)] = r.getrandbits(64)
    frame = spark.createDataFrame([(simhash._signed(a), simhash._signed(b)) for a, b in fps.items()], "fp long, second long")
    space = common.Workspace(spark, "test_links")
    root = {row.node: row.root for row in components(space, simhash.word_links(space, frame, most_in_bucket=40)).collect()}
    want = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if want[a] != want[b] and (a ^ b).bit_count() <= 7 and (fps[a] ^ fps[b]).bit_count() <= 16:
                old, new = want[a], want[b]
                want = {f: new if x == old else x for f, x in want.items()}
    got = [root.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = list(want.values())
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


@pytest.mark.parametrize("words, edits", [(300, 6), (80, 1)])
def test_near_copies_are_found_and_others_stay(spark, words, edits):
    """Copies with two words in a hundred replaced have a similarity of about 0.8 over five words."""
    r = random.Random(words)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(4000)] + ["the", "of"] * 600
    rows = []
    for k in range(300):
        text = r.choices(vocabulary, k=words)
        rows.append((k, " ".join(text)))
        if k % 2:
            for at in r.sample(range(words), edits):
                text[at] = r.choice(vocabulary)
            rows.append((1000 + k, " ".join(text)))
    kept = {x.doc_id for x in simhash.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(300)) <= kept and len(kept - set(range(300))) <= 15


def test_pivots_discard_no_link():
    r = np.random.default_rng(0)
    fp = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = np.array([x ^ np.uint64(1 << int(r.integers(64))) for x in fp], np.uint64)
    both = np.concatenate([fp, near])
    found = simhash.spanning_links(np.zeros(400, np.int64), both)
    assert len(found) >= 200 and all(np.bitwise_count(both[a] ^ both[b]) <= 3 for a, b in found)


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing(spark, docs):
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source or ""] += len(r.text or "")
    assert rates == pytest.approx({s: sum(sizes.values()) / len(sizes) / n for s, n in sizes.items()})
    got = Counter((r.doc_id, r.text) for r in mixing.mix(docs).collect())
    want = Counter()
    for r in docs.select("doc_id", "text", "source").collect():
        name = "|".join(["42", "" if r.doc_id is None else str(r.doc_id), hashlib.md5((r.text or "").encode()).hexdigest()])
        want[(r.doc_id, r.text)] += poisson(int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2**48, rates[r.source or ""])
    assert got == +want
    only = mixing.mix(docs, {"s1": 1.0})
    assert {r.source for r in only.select("source").distinct().collect()} <= {"s1"}
    keys = [r.mix_key for r in mixing.mix(docs).select("mix_key").collect()]
    assert keys == sorted(keys) and mixing.mix(docs.limit(0)).count() == 0


def test_poisson_mean(spark):
    u = F.col("id") / 20_000
    for rate in (0.1, 1.0, 7.5):
        got = spark.range(20_000).select(F.avg(mixing.poisson_inverse(u, F.lit(rate)))).first()[0]
        assert got == pytest.approx(rate, rel=0.02)


def test_mixing_of_small_sources_is_not_cut(spark):
    """A source far below 1/(50 S) of all characters still gets its equal share."""
    rows = [(k, "x" * 4000, "large") for k in range(60)] + [(100 + k, f"{k:02d} small doc", "small") for k in range(10)] + [(200, "y", "tiny")]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {"large": 240_000, "small": 120, "tiny": 1}
    rates = {r.source: r.rate for r in mixing.source_rates(own).collect()}
    assert rates == pytest.approx({s: sum(sizes.values()) / 3 / n for s, n in sizes.items()}) and rates["small"] > 600 and rates["tiny"] > 80_000
    copies = {}
    for r in mixing.mix(own).select("doc_id", "copy").collect():
        copies.setdefault(r.doc_id, []).append(r.copy)
    unit = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2**48
    for d, t, s in rows:
        name, parts = f"42|{d}|{hashlib.md5(t.encode()).hexdigest()}", math.ceil(rates[s] / 50)
        n = poisson(unit(name), rates[s]) if parts == 1 else sum(poisson(unit(f"{name}|part|{k}"), rates[s] / parts) for k in range(1, parts + 1))
        assert sorted(copies.get(d, [])) == list(range(n))
    assert sum(len(copies[100 + k]) for k in range(10)) * 12 == pytest.approx(sizes["large"] / 3, rel=0.05)
    assert len(copies[200]) == pytest.approx(rates["tiny"], rel=0.02)
    # the whole job: targets and a budget that need a rate above 50 in one source
    assert mixing.mix(own.where("source = 'small'"), {"small": 1.0}, budget=120.0).count() == pytest.approx(1200, rel=0.15)


def test_shards(spark, docs):
    manifest = sst.write_shards(spark, docs, registry.tokenizer_path("byte_bpe_50k.json"))
    got = sorted(sst.read_digests(spark, manifest).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {t: np.append(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u2"), np.uint16(2)) for _, t in texts}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids[t]), zlib.crc32(ids[t].astype("<u4").tobytes())) for d, t in texts)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    found = sst.lookup(manifest, [35, None, 10**9])
    assert [x.tolist() for x in found[35]] == [ids[t][:-1].tolist() + [2] for d, t in texts if d == 35] and len(found[None]) == 2 and not found[10**9]
    spans = [(r.first_key, r.last_key) for r in manifest.orderBy("part").collect()]
    assert all(a <= b for a, b in spans) and all(b <= a for (_, b), (a, _) in zip(spans, spans[1:]))
    empty = sst.write_shards(spark, docs.limit(0), registry.tokenizer_path("byte_bpe_50k.json"))
    assert sst.read_digests(spark, empty).count() == 0


def test_media(spark, docs):
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in ogg.store_and_probe(spark, docs).collect())
    want = Counter()
    for r in docs.collect():
        data = ogg.payload_of_text(r.text)
        want[(r.doc_id, len((r.text or "").encode()), hashlib.sha256(data).hexdigest())] += 1
    assert got == want and ogg.store_and_probe(spark, docs.limit(0)).count() == 0


def test_pieces(spark, docs):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    library = pieces.Agenda(path).library
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoded_digests(docs, path).collect())
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert got == want
    out = pieces.encode_documents(docs.withColumn("ids", F.lit(1)), path)
    assert out.columns == [*docs.columns, "ids", "decoded"] and out.count() == docs.count()
    assert pieces.encoded_digests(docs.limit(0), path).count() == 0


def test_non_negative_risk_finds_the_classes():
    r = np.random.default_rng(0)
    p, n = r.normal(1.5, 1, (800, 3)), r.normal(-1.5, 1, (400, 3))
    u = np.concatenate([r.normal(1.5, 1, (1200, 3)), n])
    config = pulearn.PuConfig(steps=400)
    prior = pulearn.estimate_prior(p, u, config)
    assert 0.65 < prior < 0.88
    w = pulearn.non_negative_risk(p, u, prior, config)
    right = ((p @ w[:-1] + w[-1] > 0).mean() + (n @ w[:-1] + w[-1] < 0).mean()) / 2
    assert right > 0.93


def test_quality_scores(spark, docs):
    labels = spark.createDataFrame([(k, 1) for k in range(10, 60)] + [(12, 0), (13, None), (None, 1)], "doc_id long, quality int")
    out = pulearn.quality_scores(docs, labels, pulearn.PuConfig(steps=50)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (common.crc32_of_id(r.doc_id) % 4 == 2) for r in out)
    alone = pulearn.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    assert pulearn.quality_scores(docs.limit(0), labels).count() == 0


def viterbi_brute(scores, cost):
    best = None
    n, m = scores.shape
    for code in range(m**n):
        path = [code // m**k % m for k in range(n)]
        value = sum(scores[k, p] for k, p in enumerate(path)) - cost * sum(a != b for a, b in zip(path, path[1:]))
        best = max(best or value, value)
    return best


def test_viterbi_is_best():
    r = np.random.default_rng(4)
    model = langspans.LangModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((len(langspans.SCRIPTS), 3), bool), langspans.LangConfig(switch=1.5))
    lengths = [6, 1, 4, 0, 5]
    scores = -r.exponential(1, (sum(lengths), 3))
    at = np.concatenate([[0], np.cumsum(lengths)])
    labels = model.paths(at, scores)
    for a, b in zip(at, at[1:]):
        if b > a:
            own, path = scores[a:b], labels[a:b].tolist()
            value = sum(own[k, p] for k, p in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
            assert value == pytest.approx(viterbi_brute(own, 1.5))
            assert model._path(own.tolist()) == path


def test_languages(spark):
    r = random.Random(2)
    make = {"xx": "the of and ing tion", "yy": "der und ung schaft ein", "zz": "привет мир это слово"}
    text = lambda lang, n: " ".join(r.choice(make[lang].split()) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(500, None, "xx"), (501, "123 456 !!", "xx"), (502, text("xx", 40) + " " + text("zz", 60), None), (503, "漢字", None), (None, "the the", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langspans.languages(df).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:120]) and len(got) == len(rows)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert got[502].lang_pred == "zz" and got[502].n_spans == 2 and got[503].lang_pred in make
    model = langspans.learn(df, lambda i: F.lit(True))
    spans = sorted(tuple(r) for r in langspans.spans(df.where("doc_id = 502"), model).collect())
    assert [(s[2], s[3], s[4]) for s in spans] == [(0, 40, "xx"), (40, 60, "zz")]
    assert {r.lang_pred for r in langspans.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langspans.languages(df.limit(0)).count() == 0


RENDERED = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br/>c": "a\nb\nc",
    "<b>a</b>  <i>b</i>\n c": "a b c",
    "<title>t</title><body>x<script>y</script><style>z</style><!-- c --><template>q</template>": "x",
    "<p hidden>a</p><p style='color:red;display : none'>b</p><p style='visibility:hidden'>c</p>d": "d",
    "<ul><li>a<li>b<ol><li>c<li value=7>d<li>e</ol></ul>z": "- a\n- b\n  1. c\n  7. d\n  8. e\n\nz",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><thead><tr><th>x</thead><tbody><tr><td>1<br>2<td>q</table>after": "x\n1  q\n2\n\nafter",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "<h1>T</h1>text": "T\n\ntext",
    "a</p>b": "a\n\nb",
    "<select><option>x<option>y</select><textarea>a\n  b</textarea>z": "x\na\n  b\nz",
    "<select multiple><optgroup label=g><option>x<option hidden>y<option>z</select>": "x\nz",
    "<select><option>x<option selected>y</select>": "y",
    "<form>Name <input value=Ann><input type=hidden value=h><input type=submit><input type=password value=p> <button>Go</button></form>": "Name Ann Submit Go",
    "<details><summary>more</summary>closed</details><details open><summary>s</summary>in</details><dialog>d</dialog>": "more\ns\nin",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>y</table>": "wide cell     x\na          b  y",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>": "a  b\n   c\n   d",
    "<p title='a>b' id=x/>in<p/ hidden>out": "in",
    "a<!-->b<!--->c<!-- x --!>d<!-- open": "abcd",
    "a <b title='never closed>text": "a",
    "a </ b>c</>d": "a cd",
    "<ul><li><li><p>x</p><li><ul><li>q</ul></ul><dl><dd></dl>z": "-\n- x\n- - q\n\nz",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "1 < 2 and <3": "1 < 2 and <3",
    "<a title=\"x > y\">l</a>": "l",
    "<p>日本<table><tr><td>漢字<td>x<tr><td>abc<td>y</table>": "日本\n\n漢字  x\nabc   y",
}


@pytest.mark.parametrize("page", RENDERED)
def test_render(page):
    assert htmlrender.render(page) == RENDERED[page]


def test_render_never_raises_and_keeps_text():
    r = random.Random(8)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<div", ">", "</", "<b>", "&lt;", "\"", "<!--", "-->", "<br>", "<h2>", "</h3>", "<pre>", "\n", " "]
    for k in range(300):
        page = "".join(r.choice(bits) if r.random() < 0.6 else f"word{k}" for _ in range(r.randint(0, 40)))
        assert isinstance(htmlrender.render(page), str)
    deep = "<div>" * 5000 + "in" + "</div>" * 5000 + "out"
    assert htmlrender.render(deep).split() == ["in", "out"]


def test_depth_has_no_limit():
    for n in (3, 199, 200, 201, 205, 20_000):
        assert htmlrender.render("<div>" * n + "<p hidden>secret</p>seen" + "</div>" * n + "after") == "seen\nafter"
        assert htmlrender.render("<div hidden>" + "<b>" * n + "secret" + "</b>" * n + "</div>seen") == "seen"
        assert htmlrender.render("<ul><li>" * n + "x").split() == ["-"] * n + ["x"]
    tables = htmlrender.render("".join(f"<table><tr><td>w{k}<td>" for k in range(300)))
    assert sorted(tables.split()) == sorted(f"w{k}" for k in range(300))


def test_broken_pages_take_time_in_proportion():
    """Ten times the page may not take a hundred times as long."""

    def pages(n):
        yield from ("<a " * n, '<a href="x>' * n, "<" * n, "<!--" * n, "</" * n, "<div>" * n, "<p><table><td>" + "<div>" * n, "<ul><li>x" * n, "<table>" + "<b><tr>" * n, "<script>" * n, "<td colspan=9 rowspan=9>" * n, "<dl><dd>x" * n)
        yield "<table>" + "<tr><td colspan=900 rowspan=60000>x<td>y" * (n // 10)

    def seconds(page):
        start = time.process_time()
        htmlrender.render(page)
        return time.process_time() - start

    for small, large in zip(pages(1500), pages(15_000)):
        assert seconds(large) < 40 * max(seconds(small), 0.02), large[:60]


def test_render_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (2, None, None, None)], "page_id long, url string, html string, text int")
    out = htmlrender.render_pages(df)
    assert out.columns == ["page_id", "url", "text"] and sorted((r.page_id, r.text) for r in out.collect()) == [(1, "a"), (2, "")]
    assert htmlrender.render_pages(df.limit(0)).count() == 0


def test_broken_tables_keep_all_words():
    assert htmlrender.render("<table><tr><td>a</td></tr><form><tr><td>b</td></form></table>") == "a\nb"
    assert htmlrender.render("<table><form hidden><tr><td>b</td></tr></form></table>") == "b"
    assert htmlrender.render("<table><tr><form><td>x</td></form></tr></table>") == "x"
    assert htmlrender.render("<table><tr><td>a</td></tr>note</table>") == "note\na"
    assert htmlrender.render("<table><tr><div>n</div><td>x<td>y</tr><tr hidden><td>z</tr></table>") == "n\nx  y"
    r = random.Random(7)
    tags = "table tr td th thead tbody tfoot form div b p a caption colgroup center".split()
    for _ in range(3000):
        bits = ["<table>"]
        for k in range(r.randint(1, 40)):
            tag = r.choice(tags)
            bits.append(r.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f" w{k} "]))
        page = "".join(bits)
        assert Counter(htmlrender.render(page).split()) == Counter(re.findall(r"w\d+", page)), page
    deep = "<table>" + "<div><tr><b><td>" * 400 + " end " + "<table><tr><td>" * 400 + " last "
    assert sorted(htmlrender.render(deep).split()) == ["end", "last"]


def test_end_punctuation_of_padded_lines_and_long_words(spark):
    cases = {
        "A padded sentence of words." + " " * 40: True, "A padded sentence of words.\t \x0b\r" + "\t" * 20: True, "no end of a sentence" + " " * 40: False, "see https://host/1/" + "path" * 20: True,
        "see https://host/" + "path" * 20: False, "He said “yes.”" + "”" * 20: True, "a 1 b " + "c" * 30: False, "a.\tb" + "c" * 30: False, "9" * 50_000 + " then none": False,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, line string")
    got = {r.line: r.ok for r in df.select("line", quality_rules.line_passes(F.col("line")).alias("ok")).collect()}
    assert got == cases
