"""Very long texts, repeated ids, empty tables, clashing columns and held-out accuracy."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import common, htmlrender, langspans, mixing, ogg, pieces, pulearn, quality_rules, registry, simhash, sst, suffixdedup
from tests.llm.test_operators import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(n_bytes=5 << 20, seed=3):
    """Some MB of lines that don't repeat, with words that do."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    out, size, k = [], 0, 0
    while size < n_bytes:
        line = " ".join(r.choices(words, k=14)) + f" number {k}."
        out.append(line)
        size += len(line) + 1
        k += 1
    return "\n".join(out)


@pytest.fixture(scope="module")
def text():
    return long_text()


@pytest.fixture(scope="module")
def long_docs(spark, text):
    return spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "a short one.", "en", "a", 12), (3, None, None, None, None)], SCHEMA).cache()


def test_long_text_shards(spark, long_docs, text):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in sst.read_digests(spark, sst.write_shards(spark, long_docs, path)).collect()}
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]
    assert got[1].n_tokens == len(ids) and got[1].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) and got[3].n_tokens == 1


def test_long_text_media(spark, long_docs, text):
    got = {r.doc_id: r for r in ogg.store_and_probe(spark, long_docs).collect()}
    data = ogg.payload_of_text(text)
    assert got[1].n_bytes == len(text) and got[1].payload_sha256 == hashlib.sha256(data).hexdigest() and f"ms={len(data) // 8};" in got[1].feature


def test_long_text_pieces(spark, long_docs, text):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in pieces.encoded_digests(long_docs, path).collect()}
    ids = pieces.Agenda(path).library.encode(text)
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_text_mixing(spark, long_docs, text):
    got = mixing.mix(long_docs, budget=3.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("size")).collect()
    assert {r.doc_id: r.size for r in got}.get(1, len(text)) == len(text)


def test_long_page(text):
    page = "<p>" + text.replace("\n", "</p><p>") + "</p>"
    assert htmlrender.render(page) == text.replace("\n", "\n\n")


def test_long_text_languages(spark, long_docs):
    own = long_docs.withColumn("doc_id", F.col("doc_id") + 1)
    got = {r.doc_id: r.lang_pred for r in langspans.languages(own).collect()}
    assert got[2] == "en" and got[4] == "und"


def test_long_text_quality(spark, long_docs):
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert pulearn.quality_scores(long_docs, labels, pulearn.PuConfig(steps=5)).count() == 3


def test_long_text_groups(spark, long_docs, text):
    got = {r.doc_id: r.fingerprint for r in simhash.groups(spark, long_docs).collect()}
    assert got[1] == f"{simhash.fingerprint(text):016x}" and got[3] == "0" * 16


def test_long_text_repeats(spark, text):
    """A long text whose last part repeats one in its middle, byte for byte."""
    part = text[2 << 20 : (2 << 20) + 100_000]
    docs = spark.createDataFrame([(1, text + "§" + part), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixdedup.repeat_digests(spark, docs).collect()}
    assert got[1].n_removed == 2 * len(part) and got[1].n_spans == 2 and got[2].n_removed == 0


def test_long_text_rules(spark, long_docs, text):
    got = {r.doc_id: r for r in quality_rules.quality_report(long_docs).collect()}
    assert tuple(got[1][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(text) and got[1].kept


def test_windows_compare_every_word(spark):
    """Windows that differ in their first word only aren't repeated, whatever follows."""
    r = random.Random(1)
    texts = [" ".join(f"w{r.randint(0, 5)}" for _ in range(400)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.quality_report(docs).collect()}
    assert got == {k: base(t)[4] for k, t in enumerate(texts)}


def test_boilerplate_in_four_languages(spark):
    cases = {
        "Tous droits réservés.": False, "ALLE RECHTE VORBEHALTEN.": False, "Todos los derechos reservados.": False, "Mentions légales.": False, "Menü": False, "ZURÜCK": False, "Leer más": False, "Lire la suite": False,
        "Un texte sur les droits de chacun.": True, "Ein Satz über Rechte.": True, "Una frase normal.": True,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, line string")
    assert {x.line: x.ok for x in df.select("line", quality_rules.line_passes(F.col("line")).alias("ok")).collect()} == cases


def test_repeated_ids_are_learnt_from_once(spark):
    good, bad = "A plain sentence of some words, well made and long enough.", "### $$$ %% BUY !!! <<< >>> ||"
    rows = [(k, f"{good} {k}", None, None, None) for k in range(40)] + [(100 + k, f"{bad} {k}", None, None, None) for k in range(60)]
    rows += [(7, f"{good} again {k}", "en", None, None) for k in range(500)] + [(107, f"{bad} again {k}", "en", None, None) for k in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    config = pulearn.PuConfig(steps=30, max_positive=30, max_unlabelled=50)
    seen = []
    fitted, pulearn.fit = pulearn.fit, lambda p, u, c: seen.append((len(p), len(u))) or fitted(p, u, c)
    try:
        out = pulearn.quality_scores(docs, labels, config)
        assert out.count() == len(rows) and seen[0][0] <= 30 and seen[0][1] <= 50
    finally:
        pulearn.fit = fitted
    chosen = common.least_hashes(docs.where("lang = 'en'").select(F.col("doc_id").alias("id"), "lang").distinct(), "lang", 5).collect()
    assert sorted((r.id, r.lang) for r in chosen) == [(7, "en"), (107, "en")]


def test_sample_is_the_least_hashes(spark):
    rows = [(k, "en" if k % 10 else "de") for k in range(5000)] + [(3, "en")] * 50 + [(None, "fr"), (1, "fr")]
    df = spark.createDataFrame(rows, "id long, lang string").repartition(9)
    hashed = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
    got = {}
    for r in common.least_hashes(df.where("id IS NOT NULL").distinct(), "lang", 70).collect():
        got.setdefault(r.lang, set()).add(r.id)
    for lang in ("en", "de", "fr"):
        ids = {i for i, x in rows if x == lang and i is not None}
        assert got[lang] == set(sorted(ids, key=lambda i: (hashed[i], i))[:70])


def test_spans_agree_on_both_sides_of_the_long_path(spark):
    """Texts above 1000 words take another path through Viterbi; cut to the same words, labels are the same."""
    import numpy as np

    r = np.random.default_rng(0)
    model = langspans.LangModel(["a", "b", "c"], np.zeros((4, 3), np.float32), np.ones((26, 3), bool), langspans.LangConfig(switch=2.0))
    for n in (999, 1000, 1001, 1500):
        scores = (-r.random((n, 3)) * 6).astype(np.float32)
        one = model.paths(np.array([0, n]), scores)
        assert one.tolist() == model._path(scores.tolist())
        together = np.zeros(n, np.int64)
        model._paths_together(np.array([0]), np.array([n]), scores, together)
        assert together.tolist() == one.tolist()


def test_pivot_tables_lose_no_pair_and_figures_add_up(spark):
    import numpy as np

    r = np.random.default_rng(5)
    heads = r.integers(0, 1 << 63, 60).astype(np.uint64)
    fp = np.unique(np.concatenate([heads, *(heads ^ np.uint64(1 << int(b)) for b in range(0, 60, 7))]))
    figures = np.zeros(4, np.int64)
    links = simhash.spanning_links(np.zeros(len(fp), np.int64), fp, figures=figures)
    near = sum(bin(int(a) ^ int(b)).count("1") <= 3 for k, a in enumerate(fp) for b in fp[:k])
    pairs = len(fp) * (len(fp) - 1) // 2
    assert figures[0] == pairs and figures[3] == near and near <= figures[2] <= figures[1] < pairs and figures[2] < pairs // 20
    assert all(bin(int(fp[a]) ^ int(fp[b])).count("1") <= 3 for a, b in links) and len(links) == len(fp) - 60
    texts = spark.createDataFrame([(k, " ".join(f"w{j % (k + 3)}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    row = simhash.pair_figures(spark, texts).first()
    assert row.in_buckets >= row.made >= row.left_by_tables >= row.linked


def test_routes_cover_what_is_removed(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(50)) + " " + passage + " " + " ".join(word() for _ in range(50)) for _ in range(6)] + [passage, passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = sum(x.n_removed for x in suffixdedup.repeat_digests(spark, docs).collect())
    for most in (512, 2):
        routes = {x.route: x.n_bytes for x in suffixdedup.route_figures(spark, docs, most_in_group=most).collect()}
        assert max(routes.values()) <= removed <= sum(routes.values()) and ("crowded" in routes) == (most == 2)


def test_pipeline_of_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    schema = SCHEMA + ", copy string, ids int, decoded string, mix_key int, route string, key int, `odd name` int"
    line = "\n".join(f"A whole sentence of words that stands alone as number {k} of this text." for k in range(6))
    rows = [(k, f"{line}\nAnd a closing line for document {k * 7919} only.", "en", None if k % 2 else "s", 1, f"c{k}", k, "d", k, "r", k, k) for k in range(12)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None, None)]
    for name, own in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(own, schema)
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            out = run(spark, docs, "")
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if stage == "mix_sources":
                assert all(r.copy == f"c{r.doc_id}" and r.mix_key == r.doc_id and r["odd name"] == r.doc_id for r in docs.collect())
        assert docs.columns == [*(c for c in out.columns if c not in ("ids", "decoded")), "ids", "decoded"]
        assert name == "some" or docs.count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == 0


def test_run_leaves_only_its_result(spark):
    top = common.shared_dir(spark).removeprefix("file://")
    import os

    before = set(os.listdir(top))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    after = set(os.listdir(top)) - before
    assert rows > 0 and len(after) == 1
    assert [x for x in os.listdir(f"{top}/{after.pop()}") if not x.startswith(".")] == ["4_sentencepiece"]


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in registry.QUERIES["op7_language_spans"](spark, data).collect() if r.held_out and truth[r.doc_id]]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    own = [(r.score, r.predicted, labels[r.doc_id]) for r in registry.QUERIES["op2_pu_quality"](spark, data).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, _, y in own if y == k] for k in (1, 0))
    assert len(good) > 40 and len(bad) > 10
    wins = sum((a > b) + (a == b) / 2 for a in good for b in bad)
    assert wins >= 0.98 * len(good) * len(bad) and sum(p == y for _, p, y in own) >= 0.95 * len(own)
