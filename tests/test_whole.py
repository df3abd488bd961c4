"""Queries over every row of small tables, against brute force: nothing is left out by size, kind or id."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import setops
from lectern.operators.chunks import find_sections, split_text
from lectern.plans.catalogue import QUERIES

md5 = lambda x: hashlib.md5(x.encode()).hexdigest()


SENTENCES = " ".join(f"This is sentence {k} of a long text." for k in range(60))
PARAGRAPHS = "\n\n".join(f"paragraph {k} " + "word " * 30 for k in range(20))
TEXTS = [None, "", "short", "One. Two.", "x" * 512, "y" * 513, "z" * 2000, SENTENCES, PARAGRAPHS, "列" * 700 + "。" + "表" * 700, "no end " * 300 + "\nlast line"]


def chunks_of(spark, texts, size=512, overlap=64):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", split_text(F.col("t"), size, overlap).alias("c"))
    return {r.k: r.c or [] for r in rows.collect()}


def bodies(chunks, overlap):
    """Each chunk without the end of the one before, with which it must begin."""
    out = chunks[:1]
    for before, chunk in zip(chunks, chunks[1:]):
        assert chunk.startswith(before[-overlap:] + "\n\n")
        out.append(chunk[overlap + 2 :])
    return out


def test_chunks_hold_the_text(spark):
    got = chunks_of(spark, TEXTS)
    joined = lambda x: re.sub(r"\n", "", x)
    for k, text in enumerate(TEXTS):
        if not text:
            assert got[k] == []
        elif len(text) <= 512:
            assert got[k] == [text]
        elif len(set(text)) == 1:
            # nothing to cut at: strides of equal length that overlap
            assert [c[:448] for c in got[k][:-1]] == [text[:448]] * (len(got[k]) - 1) and 448 * (len(got[k]) - 1) + len(got[k][-1]) == len(text)
        else:
            own = bodies(got[k], 64)
            assert joined("".join(own)) == joined(text)
            assert all(len(joined(c)) <= 512 or "\n\n" not in body.strip("\n") for c, body in zip(got[k], own))
    for k in (TEXTS.index(SENTENCES), TEXTS.index(PARAGRAPHS)):
        parts = [body.split("\n\n") for body in bodies(got[k], 64)]
        for n in range(len(parts) - 1):
            assert 64 * (n > 0) + sum(map(len, parts[n])) + len(parts[n + 1][0]) > 512


def test_chunk_sentences_of_all_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in QUERIES["chunk_sentences"].run(spark, str(tmp_path)).collect())
    assert got == Counter((k, i, md5(c), len(c)) for k, own in chunks_of(spark, TEXTS).items() for i, c in enumerate(own))
    assert {k for k, _, _, _ in got} == set(range(2, len(TEXTS)))


def test_chunk_text_of_all_conversations(spark, tmp_path):
    turns = [(k, j, "user" if j % 2 else "assistant", t) for k in range(len(TEXTS) - 2) for j, t in enumerate(TEXTS[2 + k : 5 + k])]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = Counter()
    for conv in {t[0] for t in turns}:
        page = "\n\n".join(f"# {role}\n\n{text}" for c, _, role, text in turns if c == conv)
        sections = find_sections(page)
        split = chunks_of(spark, [body for _, body in sections])
        rows = [(title, c) for n, (title, _) in enumerate(sections) for c in split[n] if c.strip()]
        want.update((conv, title, i, md5(c)) for i, (title, c) in enumerate(rows))
    got = Counter(tuple(r) for r in QUERIES["chunk_text"].run(spark, str(tmp_path)).collect())
    assert got == want and len({r[0] for r in got}) == len(TEXTS) - 2 and sum(got.values()) > len(turns)


def library(spark, path):
    """60 documents, some with equal or short titles: (key, doc_id, doi, title, kind) of each."""
    docs = [(k, "tiny" if k % 13 == 5 else f"the title of document number {k % 23}", "en", "src1", 9) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    kinds = {0: "note", 1: "attachment"}
    return [(f"I{d:08d}", d, f"10.1000/{d % 300}" if d % 4 == 0 else "", t[:60], kinds.get(d % 10, "item")) for d, t, *_ in docs]


def duplicate(own, doi, title):
    by_doi = min((k for k, _, x, _, _ in own if doi and x == doi), default=None)
    return by_doi or min((k for k, _, _, x, _ in own if len(title) >= 10 and x == title), default=None)


def test_dup_lookup_of_all_items(spark, tmp_path):
    own = library(spark, tmp_path)
    got = {r.ref: r.dup_key for r in QUERIES["dup_lookup"].run(spark, str(tmp_path)).collect()}
    assert got == {d: duplicate(own, doi, title) for _, d, doi, title, _ in own} and None in got.values()


def test_upserts_of_all_items(spark, tmp_path):
    own = library(spark, tmp_path)
    pushed = {}
    for _, d, doi, title, kind in own:
        if kind == "item":
            pushed[d] = duplicate(own, doi if d % 3 == 0 else "", f"brand new {d}" if d % 3 == 2 else title)
    with_pdf = {f"I{d - d % 10 + 3:08d}" for _, d, _, _, kind in own if kind == "attachment" and (d % 20 == 1 or d % 40 == 11)}
    keys = {d: k or f"new-{d}" for d, k in pushed.items()}
    run = lambda name: Counter(tuple(r) for r in QUERIES[name].run(spark, str(tmp_path)).collect())
    assert run("upsert_skip") == Counter((d, "skipped_duplicate" if k else "created", keys[d], d % 2 == 0 and keys[d] not in with_pdf) for d, k in pushed.items())
    assert run("upsert_update") == Counter([(k, doi, k in pushed.values()) for k, _, doi, _, _ in own] + [(f"new-{d}", "", True) for d, k in pushed.items() if not k])
    assert run("upsert_create") == Counter((d, "created", f"new-{d}") for d in pushed)


def test_hit_rows_of_all_kinds(spark, tmp_path):
    texts = {k: "the nation" if k % 2 else "nothing" for k in range(40)} | {k: "the tion and, ered" for k in (3, 10, 21, 32)}
    rows = [(k, t, "en", "src1", 9) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = lambda t: sum(x in t for x in ("the tion and, ered", "the", "tion", "and", "ered"))
    want = sorted((-score(t), f"I{k:08d}") for k, t in texts.items() if score(t))[:20]
    got = QUERIES["hit_rows"].run(spark, str(tmp_path)).collect()
    assert sorted((-r.score, r.chunk_id) for r in got) == want and [r for r in want if r[0] == -5] == [(-5, f"I{k:08d}") for k in (3, 10, 21, 32)]


def test_relation_changes_of_all_rows(spark, tmp_path):
    lines = [(o, (o * 37 + n * 11) % 900, n) for o in range(1, 300) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = {(a, b) for a, b, _ in lines} | {(b, a) for a, b, _ in lines}
    # a pair that is removed goes both ways
    want = {(a, b) for a, b in pairs if a % 5 != b % 5}
    got = [tuple(r) for r in QUERIES["relation_changes"].run(spark, str(tmp_path)).select("key_a", "key_b").collect()]
    assert sorted(got) == sorted(want) and len(got) > 1000


def test_citations_of_whole_texts(spark, tmp_path):
    texts = ["short", "two\nlines of a text\n\nand more " * 20, "x" * 5000]
    spark.createDataFrame([(k, t, "en", "src1") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunk_index: r.markdown for r in QUERIES["citations"].run(spark, str(tmp_path)).collect()}
    assert got == {k: f"**{t}** — en [item:I{k}] (section: src1, score: {k}.50)\n\n> {t}\n" for k, t in enumerate(texts)}


def test_relations_added_to_what_is_there(spark):
    """Repeats, both directions, relations to itself and relations that stand one way only."""
    frame = lambda rows: spark.createDataFrame(rows, "key_a long, key_b long")
    got = setops.add_relations(frame([(1, 2), (2, 1), (4, 3), (5, 5)]), frame([(2, 1), (3, 4), (4, 3), (6, 6), (8, 7), (8, 7), (None, 1)]))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 1), (3, 4), (4, 3), (7, 8), (8, 7)]
    left = setops.remove_relations(got, frame([(2, 1), (1, 2), (2, 1)]))
    assert sorted(map(tuple, left.collect())) == [(3, 4), (4, 3), (7, 8), (8, 7)]
    turned = setops.add_relations(frame([]), frame([(1, 2)]))._jdf.queryExecution().optimizedPlan().toString()
    # the aggregate lies below the union of both directions
    assert turned.index("Union") < turned.index("Aggregate")
