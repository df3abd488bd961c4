"""Row programs against expected rows."""

import json

import pytest

from lectern.errors import InvalidParams
from lectern.operators.programs import run_program

ROWS = [
    {"id": 1, "name": "Ann Lee", "lang": "en", "n": 5, "x": 1.5, "tags": ["b", "a", "b"], "meta": {"src": "s1", "year": 2020}, "ok": True, "more": {"k": "v"}},
    {"id": 2, "name": "bo", "lang": "fr", "n": 12, "x": None, "tags": [], "meta": {"src": "s2", "year": None}, "ok": False, "more": {}},
    {"id": 3, "name": None, "lang": "en", "n": None, "x": -2.0, "tags": ["c"], "meta": {"src": None, "year": 1999}, "ok": None, "more": {"k": "w", "l": "z"}},
]
SCHEMA = "id int, name string, lang string, n int, x double, tags array<string>, meta struct<src: string, year: int>, ok boolean, more map<string, string>"

PROGRAMS = [
    (".[].name", ["Ann Lee", "bo", None]),
    (".name", ["Ann Lee", "bo", None]),
    (".meta.src", ["s1", "s2", None]),
    ("[.[] | {id}]", [{"id": 1}, {"id": 2}, {"id": 3}]),
    ('.[] | select(.lang == "en") | .id', [1, 3]),
    ("map(.id)", [1, 2, 3]),
    ("map(.id) | add", [6]),
    ("map(.x) | min", [-2.0]),
    ("map(select(.ok | not)) | map(.id)", [2, 3]),
    (".n // 0", [5, 12, 0]),
    (".n + 1", [6, 13, None]),
    (".id * 2 - 1", [1, 3, 5]),
    (".id % 2", [1, 0, 1]),
    (".id / 2", [0.5, 1.0, 1.5]),
    ("-.id", [-1, -2, -3]),
    ('.lang + "-" + (.id | tostring)', ["en-1", "fr-2", "en-3"]),
    ('if .n > 10 then "many" elif .n > 1 then "some" else "none" end', ["some", "many", "none"]),
    ('.name | test("^[A-Z]")', [True, False, False]),
    ('select(.name | test("e$") | not) | .id', [2, 3]),
    (".tags | length", [3, 0, 1]),
    (".tags | unique", [["a", "b"], [], ["c"]]),
    (".tags | map(ascii_upcase)", [["B", "A", "B"], [], ["C"]]),
    ('.tags | map(select(. != "b"))', [["a"], [], ["c"]]),
    ('[.tags[] | select(. == "b") | . + "!"]', [["b!", "b!"], [], []]),
    ('.tags | join(",")', ["b,a,b", "", "c"]),
    (".tags[0]", ["b", None, "c"]),
    (".tags[-1]", ["b", None, "c"]),
    (".tags[1:]", [["a", "b"], [], []]),
    (".name[0:3]", ["Ann", "bo", None]),
    (".tags[]", ["b", "a", "b", "c"]),
    (".more.k", ["v", None, "w"]),
    ('.more["l"]', [None, None, "z"]),
    (".more | keys", [["k"], [], ["k", "l"]]),
    ('.more | has("k")', [True, False, True]),
    ('.name | split(" ")', [["Ann", "Lee"], ["bo"], None]),
    ('.lang | gsub("[aeiou]"; "_")', ["_n", "fr", "_n"]),
    ('.name | ascii_downcase | ltrimstr("ann ")', ["lee", "bo", None]),
    ("[.id, .n]", [[1, 5], [2, 12], [3, None]]),
    (".missing?", [None, None, None]),
    ("(.missing? // .lang)", ["en", "fr", "en"]),
    (".x | type", ["number", "null", "number"]),
    (".ok", [True, False, None]),
    (".id > 1 and .lang == \"en\" or .id == 2", [False, True, True]),
    ("first(2) | .id", [1, 2]),
    ("sort_by(.x) | .id", [2, 3, 1]),
    ('.[] | {id, src: .meta.src, many: (.tags | length > 1)}', [{"id": 1, "src": "s1", "many": True}, {"id": 2, "src": "s2", "many": False}, {"id": 3, "src": None, "many": False}]),
    ('{a: (.tags | any(. == "a")), n: (.tags | map(length) | add)}', [{"a": True, "n": 3}, {"a": False, "n": None}, {"a": False, "n": 1}]),
    ("(.tags | sort | first)", ["a", None, "c"]),
    ("{pair: {id, lang}}", [{"pair": {"id": k, "lang": x}} for k, x in ((1, "en"), (2, "fr"), (3, "en"))]),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA).coalesce(1)


@pytest.mark.parametrize("program, want", PROGRAMS)
def test_programs(frame, program, want):
    found = run_program(frame, program)
    got = [r.asDict(recursive=True) for r in found.collect()]
    assert [r["value"] if found.columns == ["value"] else r for r in got] == want


def test_groups(frame):
    found = run_program(frame, "group_by(.lang) | map({lang: .[0].lang, n: length, ids: (map(.id) | add), best: (map(.x) | max), srcs: (map(.meta.src) | unique | length)})")
    assert sorted(json.dumps(r.asDict()) for r in found.collect()) == sorted(json.dumps(x) for x in ({"lang": "en", "n": 2, "ids": 4, "best": 1.5, "srcs": 1}, {"lang": "fr", "n": 1, "ids": 2, "best": None, "srcs": 1}))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert {r.lang for r in run_program(frame, "unique_by(.lang)").collect()} == {"en", "fr"}


@pytest.mark.parametrize("bad", ["[[[broken", ".missing", ".name.first", ".id | join(\",\")", "select(", "{id", ".[] |", ".lang + .id", "nonsense", "group_by(.lang)", "group_by(.lang) | map({x: .[0].id})", "first(.id)", '"open', ".tags | map(.x)", "if .id then 1", ".id | test(\"x\")"])
def test_errors(frame, bad):
    with pytest.raises(InvalidParams, match="row program"):
        run_program(frame, bad)
