"""Expressions as Spark columns: nothing runs, types are followed statically."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import selections, times
from chartloom.functions.parser import Array, Binary, Call, Conditional, ExpressionError, Literal, Logical, Member, Name, Object, Unary, parse
from chartloom.functions.types import Typed, boolean, divided, floored, js_number, kind_of, literal, may_be_nan, number, remainder, string, unified

#: Names with fixed values. MIN_VALUE is the least normal double.
CONSTANTS = {
    "NaN": math.nan, "E": math.e, "LN2": math.log(2), "LN10": math.log(10), "LOG2E": math.log2(math.e), "LOG10E": math.log10(math.e), "MAX_VALUE": 1.7976931348623157e308,
    "MIN_VALUE": 2.2250738585072014e-308, "PI": math.pi, "SQRT1_2": math.sqrt(0.5), "SQRT2": math.sqrt(2),
}


@dataclass
class Scope:
    """What expressions can see: signals, datasets as rows, zones."""

    signals: dict = field(default_factory=dict)
    rows: object = None  # dataset name -> list of dicts
    zone: str = "UTC"
    input_zone: str | None = None
    session: str = "UTC"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unescaped(name: str) -> str:
    """A field name without its backslashes before quotes, dots and brackets."""
    out, i = [], 0
    while i < len(name):
        if name[i] == "\\" and i + 1 < len(name):
            i += 1
        out.append(name[i])
        i += 1
    return "".join(out)


class Compiler:
    def __init__(self, df: DataFrame | None, scope: Scope):
        self.types = {f.name: f.dataType for f in df.schema.fields} if df is not None else {}
        self.scope = scope

    def typed(self, text) -> Typed:
        return self.of(parse(text) if isinstance(text, str) else text)

    def column(self, name: str) -> Typed:
        """A field of the data; null where there is none."""
        if name not in self.types:
            return Typed(F.lit(None).cast("boolean"), "null", T.BooleanType())
        dtype = self.types[name]
        col = quoted(name)
        if isinstance(dtype, T.TimestampNTZType):
            col, dtype = times.localized(col, self.scope.input_zone or self.scope.zone, self.scope.session), T.TimestampType()
        elif isinstance(dtype, T.DateType):
            col, dtype = times.localized(col.cast("timestamp_ntz"), "UTC", self.scope.session), T.TimestampType()
        return Typed(col, kind_of(dtype), dtype)

    def of(self, node) -> Typed:
        match node:
            case Literal():
                return literal(node.value)
            case Name():
                if node.name in self.scope.signals:
                    return literal(self.scope.signals[node.name])
                if node.name in CONSTANTS:
                    return literal(CONSTANTS[node.name])
                raise ExpressionError(f"unknown name {node.name!r}")
            case Unary():
                return self.unary(node)
            case Binary():
                return self.binary(node.op, self.of(node.left), self.of(node.right), node)
            case Logical():
                return self.logical(node)
            case Conditional():
                return self.conditional(node)
            case Member():
                return self.member(node)
            case Array():
                return self.array([self.of(x) for x in node.items])
            case Object():
                items = {k: self.of(x) for k, x in node.items}
                return Typed(F.struct(*[x.col.alias(k) for k, x in items.items()]), "object", T.StructType([T.StructField(k, x.dtype) for k, x in items.items()]))
            case Call():
                return self.call(node)
        raise ExpressionError(f"{type(node).__name__} is not supported")

    def array(self, items: list[Typed]) -> Typed:
        items = unified(items)
        dtype = items[0].dtype if items else T.DoubleType()
        return Typed(F.array(*[x.col for x in items]) if items else F.array().cast(T.ArrayType(dtype)), "array", T.ArrayType(dtype))

    def unary(self, node: Unary) -> Typed:
        x = self.of(node.arg)
        if node.op == "!":
            return Typed(~boolean(x), "boolean", T.BooleanType())
        if node.op == "~":
            return _double(F.bitwise_not(F.coalesce(number(x).cast("long"), F.lit(0))))
        if x.constant and isinstance(x.value, int | float) and not isinstance(x.value, bool):
            return literal(x.value if node.op == "+" else -x.value)
        return _double(number(x) if node.op == "+" else -number(x))

    def binary(self, op: str, a: Typed, b: Typed, node=None) -> Typed:
        if op == "+" and "string" in (a.kind, b.kind):
            spelled = lambda t: F.coalesce(string(t), F.lit("null"))
            return Typed(F.concat(spelled(a), spelled(b)), "string", T.StringType())
        if op in ("+", "-", "*"):
            x, y = number(a), number(b)
            return _double(x + y if op == "+" else x - y if op == "-" else x * y)
        if op == "/":
            return _double(divided(number(a), number(b)))
        if op == "%":
            return _double(remainder(number(a), number(b)))
        if op in ("<", "<=", ">", ">="):
            x, y = number(a), number(b)
            # NaN is below and above nothing; Spark takes it for the greatest number, so it matters on the greater side
            ok, greater, t = {"<": (x < y, y, b), "<=": (x <= y, y, b), ">": (x > y, x, a), ">=": (x >= y, x, a)}[op]
            return Typed(ok & ~F.isnan(greater) if may_be_nan(t) else ok, "boolean", T.BooleanType())
        if op in ("==", "===", "!=", "!=="):
            same = self.equal(a, b, strict=len(op) == 3)
            return Typed(same if op[0] == "=" else ~same, "boolean", T.BooleanType())
        whole = lambda t: F.coalesce(number(t).cast("long"), F.lit(0).cast("long"))
        x, y = whole(a), whole(b)
        if op in ("<<", ">>"):
            y = F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int"))
            return _double(y)
        if op in ("&", "|", "^"):
            return _double({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y))
        raise ExpressionError(f"operator {op} is not supported")

    def equal(self, a: Typed, b: Typed, strict: bool) -> Column:
        if "null" in (a.kind, b.kind):
            return (a.col if b.kind == "null" else b.col).isNull()
        if a.kind == b.kind == "string":
            return F.coalesce(a.col == b.col, F.lit(False))
        if a.kind == b.kind == "boolean":
            return F.coalesce(a.col == b.col, F.lit(False))
        if strict and ("string" in (a.kind, b.kind) or "boolean" in (a.kind, b.kind)):
            return F.lit(False)
        return F.coalesce(self._same_number(a, b), F.lit(False))

    @staticmethod
    def _same_number(a: Typed, b: Typed) -> Column:
        x, y = number(a), number(b)
        return (x == y) & ~F.isnan(x) if may_be_nan(a) and may_be_nan(b) else x == y

    def condition(self, text) -> Column:
        """An expression as a filter's condition: where only true counts, nulls need no guard and scans can take the tests."""
        node = parse(text) if isinstance(text, str) else text
        if isinstance(node, Logical):
            sides = [self.of(node.left), self.of(node.right)]
            if all(x.kind == "boolean" for x in sides):
                a, b = self.condition(node.left), self.condition(node.right)
                return a & b if node.op == "&&" else a | b
        if isinstance(node, Binary) and node.op in ("==", "==="):
            a, b = self.of(node.left), self.of(node.right)
            if a.kind == b.kind == "string" or a.kind == b.kind == "boolean":
                return a.col == b.col
            if a.kind == b.kind == "number":
                return self._same_number(a, b)
        typed = self.of(node)
        return typed.col if typed.kind == "boolean" else boolean(typed)

    def logical(self, node: Logical) -> Typed:
        a, b = self.of(node.left), self.of(node.right)
        if a.kind == b.kind == "boolean":
            return Typed(a.col & b.col if node.op == "&&" else a.col | b.col, "boolean", T.BooleanType())
        x, y = unified([a, b])
        test = boolean(a)
        return Typed(F.when(test, y.col if node.op == "&&" else x.col).otherwise(x.col if node.op == "&&" else y.col), x.kind, x.dtype)

    def conditional(self, node: Conditional) -> Typed:
        tests, values = [], []
        while isinstance(node, Conditional):  # a chain is one CASE
            tests.append(boolean(self.of(node.test)))
            values.append(self.of(node.yes))
            node = node.no
        values = unified([*values, self.of(node)])
        out = F.when(tests[0], values[0].col)
        for test, value in zip(tests[1:], values[1:-1], strict=True):
            out = out.when(test, value.col)
        return Typed(out.otherwise(values[-1].col), values[0].kind, values[0].dtype)

    def member(self, node: Member) -> Typed:
        key = node.key
        if isinstance(node.base, Name) and node.base.name == "datum":
            if not isinstance(key, Literal):
                key = Literal(self.of(key).value)
            if not isinstance(key.value, str):
                raise ExpressionError("a field of datum must have a constant name")
            return self.column(key.value)
        base = self.of(node.base)
        index = self.of(key)
        if not index.constant:
            raise ExpressionError("an index must be constant")
        value = index.value
        if base.constant and isinstance(base.value, dict | list | str):
            return literal(_host_member(base.value, value))
        if value == "length":
            return self.length(base)
        if base.kind == "object":
            known = {f.name: f.dataType for f in base.dtype.fields}
            if str(value) not in known:
                return Typed(F.lit(None).cast("boolean"), "null", T.BooleanType())
            return Typed(base.col.getField(str(value)), kind_of(known[str(value)]), known[str(value)])
        if base.kind == "array" and isinstance(value, int | float):
            inner = base.dtype.elementType
            return Typed(F.get(base.col, F.lit(int(value))), kind_of(inner), inner)
        if base.kind == "string" and isinstance(value, int | float):
            return Typed(F.nullif(F.substring(base.col, int(value) + 1, 1), F.lit("")), "string", T.StringType())
        return Typed(F.lit(None).cast("boolean"), "null", T.BooleanType())

    def length(self, x: Typed) -> Typed:
        if x.kind == "array":
            return _double(F.when(x.col.isNotNull(), F.size(x.col)))
        if x.kind == "string":
            return _double(F.length(x.col))
        return Typed(F.lit(None).cast("double"), "number", T.DoubleType())

    # calls

    def call(self, node: Call) -> Typed:
        name = node.name
        if name == "if":
            if len(node.args) != 3:
                raise ExpressionError("if takes three arguments")
            return self.conditional(Conditional(*node.args))
        if name in ("data", "vlSelectionTest", "vlSelectionResolve"):
            return self.of_data(node)
        args = [self.of(x) for x in node.args]
        if name in _MATH:
            _arity(name, args, 1)
            return _double(_MATH[name](number(args[0])))
        if name in _PARTS or name[:3] == "utc" and name[3:] in _PARTS:
            _arity(name, args, 1)
            utc = name not in _PARTS
            instant = self.instant(args[0])
            zone = "UTC" if utc else self.scope.zone
            return _double(_PARTS[name[3:] if utc else name](times.wall(instant, zone, self.scope.session), instant))
        method = getattr(self, "f_" + name, None)
        if method is None:
            raise ExpressionError(f"function {name} is not supported")
        return method(args)

    def of_data(self, node: Call) -> Typed:
        if not node.args or not isinstance(node.args[0], Literal):
            raise ExpressionError(f"{node.name} takes the name of a dataset")
        rows = self.scope.rows(node.args[0].value) if self.scope.rows else []
        if node.name == "data":
            return literal(rows)
        if node.name == "vlSelectionResolve":
            operation = self.of(node.args[1]).value if len(node.args) > 1 else "union"
            return literal(selections.resolve(rows, operation or "union"))
        operation = self.of(node.args[2]).value if len(node.args) > 2 else "union"
        return Typed(selections.test(rows, lambda f: self.column(unescaped(f)), operation or "union", self.scope.zone), "boolean", T.BooleanType())

    def instant(self, x: Typed, zone: str | None = None) -> Column:
        """As a timestamp: numbers are epoch milliseconds, strings are parsed."""
        if x.kind == "time":
            return x.col.cast("timestamp")
        if x.kind == "string":
            return times.parsed(x.col, zone or self.scope.input_zone or self.scope.zone, self.scope.session)
        return times.of_millis(number(x))

    def f_pow(self, args: list[Typed]) -> Typed:
        _arity("pow", args, 2)
        return _double(F.pow(number(args[0]), number(args[1])))

    def f_isNaN(self, args: list[Typed]) -> Typed:
        x = number(args[0])
        return Typed(F.coalesce(F.isnan(x), F.lit(False)), "boolean", T.BooleanType())

    def f_isFinite(self, args: list[Typed]) -> Typed:
        if args[0].kind != "number" or isinstance(args[0].dtype, T.IntegralType):
            return Typed(F.lit(True), "boolean", T.BooleanType())
        x = number(args[0])
        return Typed(~F.isnan(x) & (F.abs(x) != math.inf), "boolean", T.BooleanType())

    def f_isValid(self, args: list[Typed]) -> Typed:
        return Typed(args[0].col.isNotNull(), "boolean", T.BooleanType())

    def f_isDate(self, args: list[Typed]) -> Typed:
        return Typed(F.lit(args[0].kind == "time"), "boolean", T.BooleanType())

    def f_toBoolean(self, args: list[Typed]) -> Typed:
        return Typed(boolean(args[0]), "boolean", T.BooleanType())

    def f_toNumber(self, args: list[Typed]) -> Typed:
        return _double(number(args[0]))

    def f_toString(self, args: list[Typed]) -> Typed:
        return Typed(string(args[0]), "string", T.StringType())

    def f_toDate(self, args: list[Typed]) -> Typed:
        zone = args[1].value if len(args) > 1 else None
        return Typed(self.instant(args[0], self.scope.zone if zone == "local" else zone), "time", T.TimestampType())

    def f_length(self, args: list[Typed]) -> Typed:
        return self.length(args[0])

    def f_span(self, args: list[Typed]) -> Typed:
        x = args[0]
        if x.kind != "array":
            return literal(0)
        inner = x.dtype.elementType
        at = lambda i: number(Typed(F.get(x.col, i), kind_of(inner), inner))
        return _double(F.when(F.size(x.col) == 0, 0.0).otherwise(at(F.size(x.col) - 1) - at(F.lit(0))))

    def f_indexof(self, args: list[Typed]) -> Typed:
        x, y = args
        if x.kind == "array":
            inner = x.dtype.elementType
            want = y.col if kind_of(inner) == y.kind else string(y) if kind_of(inner) == "string" else number(y).cast(inner)
            return _double(F.coalesce(F.array_position(x.col, want), F.lit(0)) - 1)
        return _double(F.call_function("instr", string(x), string(y)) - 1)

    def f_format(self, args: list[Typed]) -> Typed:
        if len(args) != 2 or args[1].value != "":
            raise ExpressionError("format is supported with an empty format only")
        return Typed(js_number(args[0].col) if args[0].kind == "number" else string(args[0]), "string", T.StringType())

    def _built(self, args: list[Typed], zone: str) -> Typed:
        parts = [number(a) for a in args] + [None] * (7 - len(args))
        default = [None, 0, 1, 0, 0, 0, 0]
        year, month, date, hour, minute, second, ms = (F.lit(float(d)) if p is None else p for p, d in zip(parts, default, strict=True))
        seconds = second + ms / 1000
        naive = F.try_make_timestamp_ntz(year.cast("int"), (month + 1).cast("int"), date.cast("int"), hour.cast("int"), minute.cast("int"), seconds.cast("decimal(16,6)"))
        return Typed(times.localized(naive, zone, self.scope.session), "time", T.TimestampType())

    def f_datetime(self, args: list[Typed]) -> Typed:
        if len(args) == 1:
            return Typed(self.instant(args[0], self.scope.zone), "time", T.TimestampType())
        return self._built(args, self.scope.zone)

    def f_utc(self, args: list[Typed]) -> Typed:
        if len(args) == 1:
            return self._built([*args, literal(0)], "UTC")
        return self._built(args, "UTC")

    def f_time(self, args: list[Typed]) -> Typed:
        return _double(times.millis(self.instant(args[0])))

    def _formatted(self, args: list[Typed], zone: str) -> Typed:
        fmt = args[1].value if len(args) > 1 else "%I:%M"
        if not isinstance(fmt, str):
            raise ExpressionError("a time format must be a constant string")
        return Typed(times.formatted(self.instant(args[0]), fmt, zone, self.scope.session), "string", T.StringType())

    def f_timeFormat(self, args: list[Typed]) -> Typed:
        return self._formatted(args, args[2].value if len(args) > 2 else self.scope.zone)

    def f_utcFormat(self, args: list[Typed]) -> Typed:
        return self._formatted(args, "UTC")

    def f_timeOffset(self, args: list[Typed]) -> Typed:
        unit, step = args[0].value, args[2].value if len(args) > 2 else 1
        if unit not in times.UNITS or not isinstance(step, int | float):
            raise ExpressionError("timeOffset takes a constant unit and step")
        size, n = times._STEPS[unit]
        local = times.wall(self.instant(args[1]), self.scope.zone, self.scope.session)
        moved = F.timestamp_add(size, F.lit(int(step) * n), local) if size != "MILLISECOND" else local + F.make_dt_interval(secs=F.lit(int(step) / 1000).cast("decimal(18,6)"))
        return Typed(times.localized(moved, self.scope.zone, self.scope.session), "time", T.TimestampType())


def _double(c: Column) -> Typed:
    return Typed(c.cast("double"), "number", T.DoubleType())


def _arity(name: str, args: list, n: int) -> None:
    if len(args) != n:
        raise ExpressionError(f"{name} takes {n} argument{'s' * (n > 1)}, not {len(args)}")


def _host_member(base, key):
    if key == "length" and not isinstance(base, dict):
        return len(base)
    if isinstance(base, dict):
        return base.get(key if isinstance(key, str) else str(int(key)))
    return base[int(key)] if isinstance(key, int | float) and 0 <= key < len(base) else None


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.log(x))


_MATH = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": functools.partial(floored, up=True), "cos": F.cos, "exp": F.exp, "floor": floored,
    "round": lambda x: floored(x + 0.5), "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan, "log": _log,
}
_PARTS = {
    "year": lambda w, i: F.year(w), "quarter": lambda w, i: F.quarter(w), "month": lambda w, i: F.month(w) - 1, "date": lambda w, i: F.dayofmonth(w), "day": lambda w, i: F.dayofweek(w) - 1,
    "dayofyear": lambda w, i: F.dayofyear(w), "hours": lambda w, i: F.hour(w), "minutes": lambda w, i: F.minute(w), "seconds": lambda w, i: F.floor(F.second(w)), "milliseconds": lambda w, i: F.pmod(F.unix_millis(i), F.lit(1000)),
}
#: Every function that expressions can call.
FUNCTIONS = frozenset(
    [*_MATH, *_PARTS, *["utc" + p for p in _PARTS], "if", "data", "vlSelectionTest", "vlSelectionResolve", *[m[2:] for m in dir(Compiler) if m.startswith("f_")]]
)
