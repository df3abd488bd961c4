"""Each stage of the pipeline against brute force over its own input."""

import random
from collections import Counter

import corpus_pipeline
from lectern.llm import quality_rules, registry
from tests.llm.test_operators import wide_groups_brute


def docs_of(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    line = lambda n=9: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(line(20) for _ in range(3))
    texts = ["\n".join(line() for _ in range(r.randint(2, 8))) for _ in range(40)]
    texts += [texts[3], texts[4].replace(texts[4].split()[5], "other"), texts[0] + "\n" + passage, passage + "\n" + texts[1] + "\n" + line(30), "JUNK!! " * 30, "too short.", None, ""]
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages(spark, tmp_path):
    docs = docs_of(spark)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (before, docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["quality_rules"]
    report = {r.doc_id: r.kept for r in quality_rules.quality_report(spark.createDataFrame(before)).collect()}
    assert {r.doc_id for r in after} == {d for d, ok in report.items() if ok} and not {44, 45, 46, 47} & {r.doc_id for r in after} and len(after) >= 40
    before, after = kept["simhash_near_dedup"]
    groups = wide_groups_brute([r.text for r in before], [r.doc_id for r in before])
    assert Counter(r.doc_id for r in after) == Counter(set(groups)) and 40 not in {r.doc_id for r in after}
    before, after = kept["suffix_array_dedup"]
    data = {r.doc_id: r.text.encode() for r in before}
    seen = Counter(t[i : i + 200] for t in data.values() for i in range(len(t) - 199))
    want = {}
    for d, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        want[d] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in after} == want and any(len(want[d]) < len(data[d].decode()) for d in want)
    before, after = kept["mix_sources"]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    before, after = kept["sentencepiece"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    assert all(r.ids == library.encode(r.text) and r.decoded == library.decode(r.ids) for r in after) and len(after) == len(before)


def test_run_on_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_sql_where_there_is_some(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.QUERIES[name](spark, data)
        names = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want)
