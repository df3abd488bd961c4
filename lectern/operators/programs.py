"""Row programs: a small pipeline language over rows, compiled to DataFrame operations, so that Catalyst plans it.

Stages are joined by | and see the rows of a list, one at a time:

    .lang  .meta.source  .tags[0]  .tags[1:3]      the value at a path; of an array an element or a part
    .tags[]                                        a row for each element (a leading .[] changes nothing)
    select(.n > 3 and (.lang | test("^e") | not))  keep rows
    {id, src: .meta.source, n: (.n // 0) + 1}      new rows;  [.a, .b] an array
    map(...)  if .n > 3 then "a" else "b" end      of a value; map on an array goes through its elements
    sort_by(.n)  first(10)  unique_by(.lang)       order, limit, one row of each value
    group_by(.lang) | map({lang: .[0].lang, n: length, sum: (map(.n) | add)})
    map(.n) | add                                  one row: also min, max

Operators, weakest first: //  or  and  == != < <= > >=  + -  * / %. A value that is null or false isn't true; `not` turns it. Comparison
treats null as a value. A ? behind a term makes null of what can't be read. Functions: length keys not tostring tonumber
ascii_downcase ascii_upcase floor sqrt abs type add any all min max unique sort reverse first last join split test startswith
endswith contains gsub has ltrimstr rtrimstr.

A program is read into a tree; each node is compiled with the type of its value, known from the schema, so a program that can't fit the rows is
an error before anything runs. After group_by a map may use what adds up over a group: length, the grouped path of .[0], and add, min,
max or unique | length of map(path).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.errors import InvalidParams
from lectern.operators.setops import one_per_key

VALUE = "value"
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*")|(\d+(?:\.\d+)?)|(\.[A-Za-z_]\w*|\.)|(//|==|!=|<=|>=|[-+*/%<>(){}\[\],:;|?])|([A-Za-z_]\w*))""")
_KINDS = ("text", "number", "path", "sign", "word")
_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a.eqNullSafe(b),
    "!=": lambda a, b: ~a.eqNullSafe(b),
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_NULL, _TEXT, _BOOL, _LONG, _DOUBLE = T.NullType(), T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()


@dataclass(frozen=True)
class Node:
    """kind, what it says, and the nodes that it is made of."""

    kind: str
    says: object = None
    parts: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType


def _fail(message: str):
    raise InvalidParams(f"row program: {message}")


# reading


class _Reader:
    def __init__(self, program: str):
        self.tokens, at, program = [], 0, program.rstrip()
        while at < len(program):
            m = _TOKEN.match(program, at) or _fail(f"can't read {program[at:]!r}")
            self.tokens.append((_KINDS[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in wanted and self.tokens[self.at][0] in ("sign", "word", "path")

    def take(self, *wanted: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted and not self.peek(*wanted):
            _fail(f"expected {' or '.join(wanted) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def got(self, *wanted: str) -> str | None:
        return self.take(*wanted)[1] if self.peek(*wanted) else None

    def pipeline(self) -> Node:
        stages = [self.either()]
        while self.got("|"):
            stages.append(self.either())
        return stages[0] if len(stages) == 1 else Node("pipe", None, tuple(stages))

    def either(self) -> Node:
        left = self.level(0)
        return Node("either", None, (left, self.either())) if self.got("//") else left

    LEVELS = (("or",), ("and",), tuple(_COMPARE), ("+", "-"), ("*", "/", "%"))

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.term()
        left = self.level(k + 1)
        while sign := self.got(*self.LEVELS[k]):
            left = Node("binary", sign, (left, self.level(k + 1)))
            if k == 2:
                break
        return left

    def term(self) -> Node:
        out = self.atom()
        while True:
            if self.got("?"):
                out = Node("try", None, (out,))
            elif self.got("not"):
                out = Node("pipe", None, (out, Node("call", "not")))
            elif self.got("["):
                out = self.inside(out)
            elif self.at < len(self.tokens) and self.tokens[self.at][0] == "path" and self.tokens[self.at][1] != ".":
                out = Node("field", self.take()[1][1:], (out,))
            else:
                return out

    def inside(self, of: Node) -> Node:
        if self.got("]"):
            return Node("each", None, (of,))
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            name = self.string()
            self.take("]")
            return Node("field", name, (of,))
        first = None if self.peek(":") else self.whole()
        if self.got(":"):
            last = None if self.peek("]") else self.whole()
            self.take("]")
            return Node("part", (first, last), (of,))
        self.take("]")
        return Node("element", first, (of,))

    def whole(self) -> int:
        sign = -1 if self.got("-") else 1
        kind, text = self.take()
        return sign * int(text) if kind == "number" and text.isdigit() else _fail(f"{text!r} isn't a whole number")

    def string(self) -> str:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.take()[1][1:-1])

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            _fail("expected more")
        kind, text = self.tokens[self.at]
        if kind == "text":
            return Node("literal", self.string())
        self.at += 1
        if kind == "number":
            return Node("literal", float(text) if "." in text else int(text))
        if kind == "path":
            return Node("here") if text == "." else Node("field", text[1:], (Node("here"),))
        if text == "-":
            return Node("binary", "-", (Node("literal", 0), self.term()))
        if text == "(":
            out = self.pipeline()
            self.take(")")
            return out
        if text == "[":
            parts = []
            while not self.got("]"):
                parts.append(self.pipeline())
                if not self.got(","):
                    self.take("]")
                    break
            return Node("array", None, tuple(parts))
        if text == "{":
            return self.object()
        if text == "if":
            return self.branches()
        if text in ("true", "false", "null"):
            return Node("literal", {"true": True, "false": False, "null": None}[text])
        if kind != "word":
            _fail(f"{text!r} isn't a value")
        parts = []
        if self.got("("):
            parts.append(self.pipeline())
            while self.got(";"):
                parts.append(self.pipeline())
            self.take(")")
        return Node("call", text, tuple(parts))

    def object(self) -> Node:
        names, parts = [], []
        while not self.got("}"):
            kind, text = self.tokens[self.at] if self.at < len(self.tokens) else _fail("expected }")
            if kind not in ("word", "text"):
                _fail(f"{text!r} can't name a column")
            name = self.string() if kind == "text" else self.take()[1]
            names.append(name)
            parts.append(self.either() if self.got(":") else Node("field", name, (Node("here"),)))
            if not self.got(","):
                self.take("}")
                break
        return Node("object", tuple(names), tuple(parts))

    def branches(self) -> Node:
        test = self.pipeline()
        self.take("then")
        yes = self.pipeline()
        if self.got("elif"):
            return Node("if", None, (test, yes, self.branches()))
        no = self.pipeline() if self.got("else") else Node("here")
        self.take("end")
        return Node("if", None, (test, yes, no))


def read(program: str) -> Node:
    """The tree of a program."""
    reader = _Reader(program)
    out = reader.pipeline()
    if reader.at < len(reader.tokens):
        _fail(f"can't go on at {reader.tokens[reader.at][1]!r}")
    return out


# values


def _number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def truth(x: Typed) -> Column:
    if isinstance(x.type, T.BooleanType):
        return F.coalesce(x.col, F.lit(False))
    return x.col.isNotNull()


def _same(a: Typed, b: Typed) -> tuple[Column, Column, T.DataType]:
    """Both as one type: equal ones, a null and anything, two numbers."""
    if a.type == b.type or isinstance(b.type, T.NullType):
        return a.col, b.col.cast(a.type), a.type
    if isinstance(a.type, T.NullType):
        return a.col.cast(b.type), b.col, b.type
    if _number(a.type) and _number(b.type):
        kind = _LONG if all(isinstance(x, T.IntegralType) for x in (a.type, b.type)) else _DOUBLE
        return a.col.cast(kind), b.col.cast(kind), kind
    _fail(f"{a.type.simpleString()} and {b.type.simpleString()} don't go together")


def _field(x: Typed, name: str) -> Typed:
    if isinstance(x.type, T.StructType):
        if name not in x.type.names:
            _fail(f"there is no {name}")
        return Typed(x.col[name] if x.col is not None else F.col(f"`{name}`"), x.type[name].dataType)
    if isinstance(x.type, T.MapType):
        return Typed(F.try_element_at(x.col, F.lit(name)), x.type.valueType)
    return x if isinstance(x.type, T.NullType) else _fail(f"{x.type.simpleString()} has no {name}")


def _binary(sign: str, a: Typed, b: Typed) -> Typed:
    if sign in ("and", "or"):
        return Typed(truth(a) & truth(b) if sign == "and" else truth(a) | truth(b), _BOOL)
    x, y, kind = _same(a, b)
    if sign in _COMPARE:
        return Typed(F.coalesce(_COMPARE[sign](x, y), F.lit(False)), _BOOL)
    if _number(kind):
        if sign == "/":
            return Typed(F.try_divide(x.cast("double"), y.cast("double")), _DOUBLE)
        if sign == "%":
            return Typed(F.try_mod(x.cast("long"), y.cast("long")), _LONG)
        return Typed({"+": x + y, "-": x - y, "*": x * y}[sign], kind)
    if sign == "+" and isinstance(kind, (T.StringType, T.ArrayType)):
        return Typed(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y)), kind)
    if sign == "-" and isinstance(kind, T.ArrayType):
        return Typed(F.array_except(x, y), kind)
    _fail(f"{kind.simpleString()} has no {sign}")


def _elements(x: Typed) -> T.DataType:
    return x.type.elementType if isinstance(x.type, T.ArrayType) else _fail(f"{x.type.simpleString()} isn't an array")


def _through(x: Typed, steps: tuple[Node, ...]) -> Typed:
    """An array after these steps on its elements; select leaves elements out."""
    for step in steps:
        kind = _elements(x)
        if step.kind == "pipe":
            x = _through(x, step.parts)
        elif step.kind == "call" and step.says == "select":
            x = Typed(F.filter(x.col, lambda e: truth(value(step.parts[0], Typed(e, kind)))), x.type)  # noqa: B023
        else:
            found: list[T.DataType] = []

            def one(e: Column) -> Column:
                made = value(step, Typed(e, kind))  # noqa: B023
                found.append(made.type)  # noqa: B023
                return made.col

            x = Typed(F.transform(x.col, one), T.ArrayType(found[0]) if found else x.type)
    return x


def _length(x: Typed) -> Typed:
    if isinstance(x.type, T.StringType):
        return Typed(F.coalesce(F.length(x.col), F.lit(0)).cast("long"), _LONG)
    if isinstance(x.type, (T.ArrayType, T.MapType)):
        return Typed(F.greatest(F.coalesce(F.size(x.col), F.lit(0)), F.lit(0)).cast("long"), _LONG)
    if isinstance(x.type, T.StructType):
        return Typed(F.lit(len(x.type.names)).cast("long"), _LONG)
    return Typed(F.coalesce(F.abs(x.col), F.lit(0).cast(x.type)), x.type) if _number(x.type) else _fail(f"{x.type.simpleString()} has no length")


def _keys(x: Typed) -> Typed:
    kind = T.ArrayType(_TEXT)
    if isinstance(x.type, T.StructType):
        return Typed(F.array(*[F.lit(n) for n in sorted(x.type.names)]), kind)
    return Typed(F.sort_array(F.map_keys(x.col)), kind) if isinstance(x.type, T.MapType) else _fail(f"{x.type.simpleString()} has no keys")


def _added(x: Typed) -> Typed:
    kind = _elements(x)
    if _number(kind):
        wide = _LONG if isinstance(kind, T.IntegralType) else _DOUBLE
        return Typed(F.when(F.size(x.col) > 0, F.aggregate(x.col, F.lit(0).cast(wide), lambda a, b: a + F.coalesce(b.cast(wide), F.lit(0).cast(wide)))), wide)
    if isinstance(kind, T.StringType):
        return Typed(F.when(F.size(x.col) > 0, F.array_join(x.col, "")), _TEXT)
    return Typed(F.flatten(x.col), kind) if isinstance(kind, T.ArrayType) else _fail(f"{kind.simpleString()} has no sum")


def _name_of(t: T.DataType) -> str:
    kinds = ((T.StringType, "string"), (T.BooleanType, "boolean"), (T.NumericType, "number"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"))
    return next((n for k, n in kinds if isinstance(t, k)), "null")


def _text(x: Typed) -> Typed:
    return x if isinstance(x.type, T.StringType) else Typed(F.to_json(x.col) if isinstance(x.type, (T.StructType, T.ArrayType, T.MapType)) else x.col.cast("string"), _TEXT)


def _only_text(x: Typed) -> Column:
    return x.col if isinstance(x.type, (T.StringType, T.NullType)) else _fail(f"{x.type.simpleString()} isn't text")


#: Functions of the value alone.
_PLAIN: dict[str, Callable[[Typed], Typed]] = {
    "length": _length,
    "keys": _keys,
    "not": lambda x: Typed(~truth(x), _BOOL),
    "tostring": _text,
    "tonumber": lambda x: x if _number(x.type) else Typed(x.col.try_cast("double"), _DOUBLE),
    "type": lambda x: Typed(F.when(x.col.isNull(), F.lit("null")).otherwise(F.lit(_name_of(x.type))), _TEXT),
    "ascii_downcase": lambda x: Typed(F.translate(_only_text(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _TEXT),
    "ascii_upcase": lambda x: Typed(F.translate(_only_text(x), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _TEXT),
    "floor": lambda x: Typed(F.floor(x.col).cast("long"), _LONG),
    "sqrt": lambda x: Typed(F.sqrt(x.col), _DOUBLE),
    "abs": lambda x: Typed(F.abs(x.col), x.type),
    "add": _added,
    "any": lambda x: Typed(F.coalesce(F.exists(x.col, lambda e: truth(Typed(e, _elements(x)))), F.lit(False)), _BOOL),
    "all": lambda x: Typed(F.coalesce(F.forall(x.col, lambda e: truth(Typed(e, _elements(x)))), F.lit(True)), _BOOL),
    "min": lambda x: Typed(F.array_min(x.col), _elements(x)),
    "max": lambda x: Typed(F.array_max(x.col), _elements(x)),
    "unique": lambda x: Typed(F.sort_array(F.array_distinct(x.col)), x.type),
    "sort": lambda x: Typed(F.sort_array(x.col), x.type),
    "reverse": lambda x: Typed(F.reverse(x.col), x.type),
    "first": lambda x: Typed(F.get(x.col, F.lit(0)), _elements(x)),
    "last": lambda x: Typed(F.try_element_at(x.col, F.lit(-1)), _elements(x)),
}
#: Functions of the value and a constant text.
_WITH_TEXT: dict[str, Callable[[Column, str], tuple[Column, T.DataType]]] = {
    "test": lambda c, s: (F.coalesce(c.rlike(s), F.lit(False)), _BOOL),
    "startswith": lambda c, s: (F.coalesce(F.startswith(c, F.lit(s)), F.lit(False)), _BOOL),
    "endswith": lambda c, s: (F.coalesce(F.endswith(c, F.lit(s)), F.lit(False)), _BOOL),
    "contains": lambda c, s: (F.coalesce(F.contains(c, F.lit(s)), F.lit(False)), _BOOL),
    "split": lambda c, s: (F.split(c, re.escape(s)), T.ArrayType(_TEXT)),
    "ltrimstr": lambda c, s: (F.when(F.startswith(c, F.lit(s)), F.substring(c, F.lit(len(s) + 1), F.length(c))).otherwise(c), _TEXT),
    "rtrimstr": lambda c, s: (F.when(F.endswith(c, F.lit(s)), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(c), _TEXT),
}


def _constant(node: Node) -> str:
    return node.says if node.kind == "literal" and isinstance(node.says, str) else _fail("expected a text in quotes")


def _call(node: Node, x: Typed) -> Typed:
    name, parts = node.says, node.parts
    if not parts and name in _PLAIN:
        return _PLAIN[name](x)
    if len(parts) == 1 and name in _WITH_TEXT:
        if name == "contains" and isinstance(x.type, T.ArrayType):
            return Typed(F.array_contains(x.col, _constant(parts[0])), _BOOL)
        return Typed(*_WITH_TEXT[name](_only_text(x), _constant(parts[0])))
    if name == "map" and len(parts) == 1:
        return _through(x, parts)
    if name == "join" and len(parts) == 1:
        kind = _elements(x)
        texts = x.col if isinstance(kind, T.StringType) else F.transform(x.col, lambda e: e.cast("string"))
        return Typed(F.array_join(texts, _constant(parts[0])), _TEXT)
    if name == "gsub" and len(parts) == 2:
        return Typed(F.regexp_replace(_only_text(x), F.lit(_constant(parts[0])), F.lit(_constant(parts[1]))), _TEXT)
    if name == "has" and len(parts) == 1:
        if isinstance(x.type, T.StructType):
            return Typed(F.lit(_constant(parts[0]) in x.type.names), _BOOL)
        return Typed(F.map_contains_key(x.col, F.lit(_constant(parts[0]))), _BOOL) if isinstance(x.type, T.MapType) else _fail(f"{x.type.simpleString()} has no keys")
    if name in ("any", "all") and len(parts) == 1:
        return _PLAIN[name](_through(x, parts))
    _fail(f"unknown: {name}" if name not in _PLAIN and name not in _WITH_TEXT else f"{name} needs other arguments")


def _literal(says) -> Typed:
    kind = _NULL if says is None else _BOOL if isinstance(says, bool) else _LONG if isinstance(says, int) else _DOUBLE if isinstance(says, float) else _TEXT
    return Typed(F.lit(says) if says is None else F.lit(says).cast(kind), kind)


def _whole_row(x: Typed) -> Typed:
    return x if x.col is not None else Typed(F.struct(*[F.col(f"`{n}`") for n in x.type.names]), x.type)


def value(node: Node, x: Typed) -> Typed:
    """What a node makes of a value. A column of None stands for the row."""
    kind, parts = node.kind, node.parts
    if kind == "here":
        return _whole_row(x)
    if kind == "literal":
        return _literal(node.says)
    if kind == "field":
        return _field(x if parts[0].kind == "here" else value(parts[0], x), node.says)
    if kind == "pipe":
        for k, part in enumerate(parts):
            if part.kind == "each":
                # the elements go through the rest as a list
                return _through(value(part.parts[0], x), parts[k + 1 :])
            x = value(part, x)
        return x
    if kind == "each":
        return value(parts[0], x)
    if kind == "element":
        of = value(parts[0], x)
        at = node.says if node.says < 0 else node.says + 1
        return Typed(F.try_element_at(of.col, F.lit(at)), _elements(of))
    if kind == "part":
        of = value(parts[0], x)
        is_text = isinstance(of.type, T.StringType)
        size = F.length(of.col) if is_text else F.size(of.col)
        ends = [F.lit(d) if n is None and d is not None else size if n is None else F.lit(n) if n >= 0 else F.greatest(size + n, F.lit(0)) for n, d in zip(node.says, (0, None))]
        count = F.greatest(F.least(ends[1], size) - ends[0], F.lit(0))
        return Typed(F.substring(of.col, ends[0] + 1, count) if is_text else F.slice(of.col, ends[0] + 1, count), of.type)
    if kind == "try":
        try:
            return value(parts[0], x)
        except InvalidParams:
            return _literal(None)
    if kind == "either":
        a, b = value(parts[0], x), value(parts[1], x)
        first, second, both = _same(a, b)
        return Typed(F.when(truth(a), first).otherwise(second), both)
    if kind == "binary":
        return _binary(node.says, value(parts[0], x), value(parts[1], x))
    if kind == "if":
        yes, no, both = _same(value(parts[1], x), value(parts[2], x))
        return Typed(F.when(truth(value(parts[0], x)), yes).otherwise(no), both)
    if kind == "object":
        made = [value(p, x) for p in parts]
        return Typed(F.struct(*[m.col.alias(n) for n, m in zip(node.says, made)]), T.StructType([T.StructField(n, m.type) for n, m in zip(node.says, made)]))
    if kind == "array":
        if len(parts) == 1 and _goes_through(parts[0]):
            return value(parts[0], x)
        made = [value(p, x) for p in parts]
        if not made:
            return Typed(F.array().cast("array<string>"), T.ArrayType(_TEXT))
        both = made[0]
        for m in made[1:]:
            both = Typed(*_same(both, m)[0::2])
        return Typed(F.array(*[m.col.cast(both.type) for m in made]), T.ArrayType(both.type))
    return _call(node, x)


def _goes_through(node: Node) -> bool:
    return node.kind == "each" or node.kind == "pipe" and any(p.kind == "each" for p in node.parts)


# rows


def _row(df: DataFrame) -> Typed:
    return Typed(F.col(VALUE), df.schema[VALUE].dataType) if df.columns == [VALUE] else Typed(None, df.schema)


#: Functions that make one row of all.
_FOLDS = {"add": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}


def _one_value(df: DataFrame, node: Node) -> DataFrame:
    made = value(node, _row(df))
    if node.kind == "object":
        return df.select(*[value(p, _row(df)).col.alias(n) for n, p in zip(node.says, node.parts)])
    return df.select(made.col.alias(VALUE))


def _stage(df: DataFrame, node: Node) -> DataFrame:
    if node.kind == "here":
        return df
    if node.kind == "pipe":
        return run_tree(df, node)
    if node.kind == "each":
        if node.parts[0].kind == "here" and df.columns != [VALUE]:
            return df
        found = value(node.parts[0], _row(df))
        _elements(found)
        return df.select(F.explode(found.col).alias(VALUE))
    if node.kind == "array" and len(node.parts) == 1 and (node.parts[0].parts[:1] or (node.parts[0],))[0] == Node("each", None, (Node("here"),)):
        return _stage(df, node.parts[0])
    if node.kind == "call":
        name, parts = node.says, node.parts
        if name == "select" and len(parts) == 1:
            return df.where(truth(value(parts[0], _row(df))))
        if name == "map" and len(parts) == 1 and not (df.columns == [VALUE] and isinstance(df.schema[VALUE].dataType, T.ArrayType)):
            return _stage(df, parts[0])
        if name == "first" and len(parts) == 1:
            return df.limit(parts[0].says) if parts[0].kind == "literal" and isinstance(parts[0].says, int) else _fail("first needs a number")
        if name == "sort_by" and parts:
            return df.orderBy(*[value(p, _row(df)).col for p in parts])
        if name == "unique_by" and len(parts) == 1:
            return one_per_key(df.withColumn("__by", value(parts[0], _row(df)).col), ["__by"]).drop("__by")
        if name in _FOLDS and not parts and df.columns == [VALUE] and not isinstance(df.schema[VALUE].dataType, T.ArrayType):
            return df.agg(_FOLDS[name](F.col(VALUE)).alias(VALUE))
    return _one_value(df, node)


def _group_value(node: Node, by: Node, row: Typed) -> Column:
    """A column of a group: what adds up over its rows."""
    if node == Node("call", "length"):
        return F.count("*")
    if node.kind == "field":
        path: list[str] = []
        while node.kind == "field":
            path.insert(0, node.says)
            node = node.parts[0]
        own = Node("here")
        for name in path:
            own = Node("field", name, (own,))
        if node == Node("element", 0, (Node("here"),)) and own == by:
            return F.first(value(by, row).col)
    if node.kind == "pipe" and node.parts[0].kind == "call" and node.parts[0].says == "map" and len(node.parts[0].parts) == 1:
        of, rest = value(node.parts[0].parts[0], row).col, [p.says for p in node.parts[1:] if p.kind == "call" and not p.parts]
        if len(rest) == 1 and rest[0] in _FOLDS:
            return _FOLDS[rest[0]](of)
        if rest == ["unique", "length"]:
            return F.count_distinct(of)
    _fail("a group has its length, its own path and sums")


def run_tree(df: DataFrame, tree: Node) -> DataFrame:
    stages = list(tree.parts) if tree.kind == "pipe" else [tree]
    while stages:
        node = stages.pop(0)
        if node.kind == "call" and node.says == "group_by" and len(node.parts) == 1:
            after = stages.pop(0) if stages else _fail("group_by needs a map behind it")
            if after.kind != "call" or after.says != "map" or len(after.parts) != 1 or after.parts[0].kind != "object":
                _fail("group_by needs a map to an object behind it")
            made, row = after.parts[0], _row(df)
            columns = [_group_value(p, node.parts[0], row).alias(n) for n, p in zip(made.says, made.parts)]
            df = df.groupBy(value(node.parts[0], row).col.alias("__group")).agg(*columns).drop("__group")
        else:
            df = _stage(df, node)
    return df


def run_program(df: DataFrame, program: str) -> DataFrame:
    """df after each stage of the program; what a path yields stands in the column `value`."""
    return run_tree(df, read(program))
