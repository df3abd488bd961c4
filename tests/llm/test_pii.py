"""Personal data: base patterns against the plain regular expressions, message passing against enumeration, mentions beside the patterns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import pii, registry
from tests.llm.test_whole_tables import long_text

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in d[::-1]]
            sum_ = sum(odd[0::2]) + sum(sum(divmod(2 * c, 10)) for c in odd[1::2])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else False, 14 <= len(d) <= 19 and sum_ % 10 == 0, 10 <= len(d) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(13)
    parts = ["@", ".", "-", " ", "+", "(", ")", "a", "b.c", "é", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (743) 555-3824", "x@y.zz", "1.2.3.4", "007", "\n", "_", "%", "5" * 20, "0000000000000000"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def chain(seed=0):
    r = np.random.default_rng(seed)
    return pii.SkipChain(r.normal(size=(len(pii.FEATURES), pii.LABELS)), r.normal(size=(pii.LABELS, pii.LABELS)), r.normal(size=pii.LABELS), r.normal(size=pii.LABELS), pii.PiiRules(rounds=60))


@pytest.mark.parametrize("pairs, kinds", [([], []), ([(0, 1), (1, 2), (2, 3)], [0, 0, 0]), ([(0, 2), (1, 2), (2, 4), (3, 4)], [1, 0, 2, 0])])
def test_marginals_on_trees_are_exact(pairs, kinds):
    model, n = chain(), 5
    local = np.random.default_rng(1).normal(size=(n, pii.LABELS))
    table, total = model.potentials(), np.zeros((n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n):
        p = np.exp(sum(local[i, y[i]] for i in range(n)) + sum(table[k][y[a], y[b]] for (a, b), k in zip(pairs, kinds)))
        for i in range(n):
            total[i, y[i]] += p
    got = model.marginals(local, np.array(pairs, np.int64).reshape(-1, 2), np.array(kinds, np.int64))
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_weights_raise_the_pseudo_likelihood():
    text = "mail a.b@mail7.example.com or call +1 (743) 555-3824 twice +1 (743) 555-3824 with 4111111111111111 and 10.0.0.7, version 2.0 of 1999"
    base = pii.base_spans(text)
    pattern, n = np.unique(np.concatenate([pii.patterns_of(w) for w in (pii.words_of(text, base), pii.made_words(text, base))]), return_counts=True)
    words = pii.words_of(text, base)
    none, model = pii.fit(pattern, n, pii.PiiRules(steps=0)), pii.fit(pattern, n * 100)
    score = lambda m: sum(np.log(pii._softmax(pii._features(words) @ m.forms)[k, w.label]) for k, w in enumerate(words))
    assert score(model) > score(none) and np.array_equal(pii.fit(pattern, n * 100).forms, model.forms)
    assert pii.fit(np.zeros(0, np.int64), np.zeros(0, np.int64)).forms[0, 0] == pii.PiiRules().prior


DOCS = [
    (1, "call +1 (743) 555-3824 or (743) 555-3824, 743 pages and 555 days"),
    (2, "to a.b@mail7.example.com, from A.B@mail7 and from b.a@mail7"),
    (3, "paid by 4111111111111111; again 4111.1111.1111.1111 but not 4111.1111.1111.1112 or 1999"),
    (4, "host 227.5.221.1 is 227-5-221-1 not 300.5.221.1 nor 2.0"),
    (5, "(743) 555-3824 and 4111.1111.1111.1111 and a.b@mail7 alone"),
    (6, None),
    (7, ""),
    (None, "é +1 (743) 555-3824"),
    (1, "call +1 (743) 555-3824 or (743) 555-3824, 743 pages and 555 days"),
]
ADDED = {1: [("phone", "(743) 555-3824")], 2: [("email", "A.B@mail7")], 3: [("card", "4111.1111.1111.1111")], 4: [("ip", "227-5-221-1")]}


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(registry.read_table(spark, "/root/testdata/sf0.01", "documents"))


def test_other_mentions(spark, model):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(((x.doc_id, x.spans) for x in pii.personal_data(docs, model).collect()), key=str)
    text = dict(DOCS)
    assert len(got) == len(DOCS)
    for doc_id, spans in got:
        assert [(s.start, pii.KINDS.index(s.kind), s.stop) for s in spans if s.base] == plain(text[doc_id] or "")
        assert [(s.kind, text[doc_id][s.start : s.stop]) for s in spans if not s.base] == ADDED.get(doc_id, [])


def test_redacted(spark, model):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").select(F.lit("k").alias("source"), "text", "doc_id")
    got = {x.doc_id: x.text for x in pii.redacted(docs, model).collect()}
    assert got[1] == "call <phone> or <phone>, 743 pages and 555 days" and got[6] is None and got[7] == "" and got[5] == dict(DOCS)[5]


def test_query_on_the_small_table(spark, tmp_path):
    frame = spark.createDataFrame(DOCS * 3, "doc_id long, text string")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_personal_data(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and got.count() == len(DOCS) * 3
    text = dict(DOCS)
    for x in got.collect():
        base = plain(text[x.doc_id] or "")
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        names = [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in base]
        assert x.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(x.spans.split(",") if x.spans else [])


def test_clean_documents_get_no_spans(spark, model):
    docs = registry.read_table(spark, "/root/testdata/sf0.01", "documents")
    for x in pii.personal_data(docs, model).join(docs, "doc_id").collect():
        assert [(s.start, pii.KINDS.index(s.kind), s.stop) for s in x.spans if s.base] == plain(x.text)
        assert x.spans or not plain(x.text)


def test_long_and_hostile_texts(spark, model):
    texts = [long_text(3 << 20) + " +1 (743) 555-3824 or (743) 555-3824", "1" * 500_000, "a" * 500_000 + "@b.c", "1." * 100_000, "+1 " + "(" * 300_000, "a@" * 100_000, "9 " * 100_000 + "1.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.personal_data(docs, model).collect()}
    assert [(s.kind, s.base) for s in got[0]][-2:] == [("phone", True), ("phone", False)] and got[1] == [] and len(got[2]) == 1 and len(got[3]) == 25_000 and got[4] == got[5] == []


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.span_digests(pii.personal_data(none, pii.learn(none))).count() == 0
