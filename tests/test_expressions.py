"""Expressions: parsing, and the same values on the driver and in Spark."""

import math

import pytest

from chartloom.functions.compile import Compiler, Scope
from chartloom.functions.host import Host
from chartloom.functions.parser import Binary, ExpressionError, Literal, Name, datasets_of, fields_of, parse

CASES = [
    ("1 + 2 * 3", 7.0), ("(1 + 2) * 3", 9.0), ("7 % 4 - 1", 2.0), ("-5.5 % 2", -1.5), ("1 / 0", math.inf), ("-1 / 0", -math.inf), ("'a' + 1", "a1"), ("1.5 + 'b'", "1.5b"), ("'a' + null", "anull"),
    ("'12' * 2", 24.0), ("3 > 2 && 2 > 1", True), ("3 < 2 || 1 == '1'", True), ("1 === '1'", False), ("null == 0", False), ("!0", True), ("2 << 3", 16.0), ("13 & 7", 5.0), ("12 | 3", 15.0), ("5 ^ 1", 4.0),
    ("1 > 2 ? 'a' : 2 > 1 ? 'b' : 'c'", "b"), ("[1, 2, 3][1]", 2.0), ("[1, 2, 3].length", 3.0), ("'hello'.length", 5.0), ("'hello'[1]", "e"), ("{a: 1, b: {c: 2}}.b.c", 2.0), ("length('hello')", 5.0),
    ("indexof('hello', 'l')", 2.0), ("indexof(['a', 'b'], 'c')", -1.0), ("span([1, 5, 9])", 8.0), ("abs(-2)", 2.0), ("floor(-1.5)", -2.0), ("ceil(1.2)", 2.0), ("round(2.5)", 3.0), ("pow(2, 10)", 1024.0), ("sqrt(16)", 4.0),
    ("log(E)", 1.0), ("log(0)", -math.inf), ("exp(0)", 1.0), ("cos(0)", 1.0), ("isValid(null)", False), ("isNaN(NaN)", True), ("isFinite(1 / 0)", False), ("toNumber('3.5')", 3.5), ("toString(3)", "3"), ("toBoolean(2)", True),
    ("if(1, 'x', 'y')", "x"), ("format(2.0, '')", "2"), ("foo + 1", 24.5), ("hello + '!'", "Hello!"), ("valid ? 1 : 2", 2.0), ("year(datetime(2012, 1, 29))", 2012.0), ("month(datetime(2012, 1, 29))", 1.0),
    ("day(datetime(2012, 0, 1))", 0.0), ("utchours(utc(2012, 0, 1, 5))", 5.0), ("time(utc(1970, 0, 2))", 86400000.0), ("quarter(datetime(2012, 4, 1))", 2.0), ("dayofyear(datetime(2012, 1, 1))", 32.0),
    ("utcFormat(utc(2012, 10, 6), '%Y/%m/%d')", "2012/11/06"), ("time(toDate('2012-01-01'))", 1325376000000.0), ("milliseconds(utc(2012, 0, 1, 0, 0, 0, 7))", 7.0), ("MAX_VALUE > 1e308", True), ("PI > 3.14", True),
    ("0x10 + 1e2", 116.0), ("'it\\'s' + \"\\u0041\"", "it'sA"), ("~5", -6.0), ("+'4'", 4.0), ("null", None), ("isDate(datetime(2012, 1, 1))", True), ("timeFormat(datetime(2012, 0, 1, 13, 5), '%I:%M')", "01:05"),
]
SIGNALS = {"foo": 23.5, "bar": 100.0, "valid": False, "hello": "Hello"}


def same(a, b):
    return a == b or isinstance(b, float) and a is not None and not isinstance(a, str) and (math.isclose(a, b, abs_tol=1e-9) or math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize(("text", "value"), CASES)
def test_on_the_driver(text, value):
    assert same(Host(Scope(SIGNALS)).value(text), value)


def test_in_spark(spark):
    df = spark.range(1)
    compiler = Compiler(df, Scope(SIGNALS, session="UTC"))
    got = df.select(*[compiler.typed(t).col.alias(f"c{i}") for i, (t, _) in enumerate(CASES)]).first()
    assert [(t, g, v) for (t, v), g in zip(CASES, got, strict=True) if not same(g, v)] == []


def test_structure():
    assert parse("a - b - c") == Binary("-", Binary("-", Name("a"), Name("b")), Name("c"))
    assert parse("'\\n'") == Literal("\n")
    assert fields_of(parse("datum.a + datum['b c'] + x")) == {"a", "b c"}
    assert fields_of(parse("datum[x]")) is None
    assert datasets_of(parse("data('t')[0].x + vlSelectionTest('s', datum)")) == {"t", "s"}


@pytest.mark.parametrize("text", ["1 +", "(1", "a b", "f(1,", "1 = 2", "'open", "[1, 2"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_unknown_names_and_functions(spark):
    for text in ("nope", "upper('a')", "datum.x.y(1)"):
        with pytest.raises(ExpressionError):
            Compiler(spark.range(1), Scope()).typed(text)


def test_missing_column_is_null(spark):
    df = spark.range(1)
    c = Compiler(df, Scope())
    assert tuple(df.select(c.typed("datum.nope == null").col, c.typed("datum.nope").col, c.typed("datum.nope.deeper").col).first()) == (True, None, None)


@pytest.mark.parametrize(
    ("store", "op", "want"),
    [
        ([{"fields": [{"field": "a", "type": "R"}], "values": [[2, 4]]}], "union", [2, 3, 4]), ([{"fields": [{"field": "a", "type": "R-E"}], "values": [[4, 2]]}], "union", [3]),
        ([{"fields": [{"field": "a", "type": "R-RE"}], "values": [[2, 4]]}], "union", [2, 3]), ([{"fields": [{"field": "a", "type": "R-LE"}], "values": [[2, 4]]}], "union", [3, 4]),
        ([{"fields": [{"field": "a", "type": "E"}], "values": [1]}, {"fields": [{"field": "a"}], "values": [7]}], "union", [1, 7]), ([], "union", []),
        ([{"fields": [{"field": "a", "type": "E"}], "values": [[1, 2]]}, {"fields": [{"field": "s", "type": "E"}], "values": ["x1"]}], "intersect", [1]),
        ([{"fields": [{"field": "s", "type": "E"}, {"field": "a", "type": "R"}], "values": ["x3", [0, 9]]}], "union", [3]),
    ],
)
def test_selections(spark, store, op, want):
    df = spark.range(1, 8).selectExpr("id AS a", "'x' || id AS s")
    c = Compiler(df, Scope(rows=lambda name: store))
    assert [r.a for r in df.filter(c.typed(f"vlSelectionTest('st', datum, '{op}')").col).orderBy("a").collect()] == want
