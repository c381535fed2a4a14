"""Values of expressions: Spark columns that know what kind they are, and JavaScript-like coercions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for "no host value known".
UNKNOWN = object()


@dataclass(frozen=True)
class Typed:
    """A column and its kind: number, string, boolean, time, array, object or null; ``value`` if it is constant."""

    col: Column
    kind: str
    dtype: T.DataType | None = None
    value: object = UNKNOWN

    @property
    def constant(self) -> bool:
        return self.value is not UNKNOWN


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, T.StructType):
        return "object"
    if isinstance(dtype, T.NullType):
        return "null"
    return "string"


def number(t: Typed) -> Column:
    """As double: strings that are no numbers are null, times are epoch milliseconds."""
    if t.kind == "time":
        return _instant(t).cast("double")
    if t.kind == "null":
        return F.lit(None).cast("double")
    if t.kind in ("array", "object"):
        return F.lit(None).cast("double")
    if t.kind == "number":
        return t.col if isinstance(t.dtype, T.DoubleType) else t.col.cast("double")
    return t.col.try_cast("double")


def may_be_nan(t: Typed) -> bool:
    """Whether a value can be NaN as a number (whole numbers, times and plain constants cannot)."""
    if t.kind == "number":
        return not isinstance(t.dtype, T.IntegralType | T.DecimalType) and not (t.constant and not math.isnan(t.value))
    return t.kind == "string"


def _instant(t: Typed) -> Column:
    return F.unix_millis(t.col.cast("timestamp"))


def boolean(t: Typed) -> Column:
    """Null is false; numbers are true unless 0; strings by what they spell."""
    if t.kind == "boolean":
        return F.coalesce(t.col, F.lit(False))
    if t.kind == "number":
        return F.coalesce(t.col != 0, F.lit(False))
    if t.kind == "null":
        return F.lit(False)
    if t.kind == "string":
        return F.coalesce(t.col.try_cast("boolean"), F.lit(False))
    return t.col.isNotNull()


def js_number(c: Column) -> Column:
    """A double as JavaScript writes it: integral values without a fraction."""
    c = c.cast("double")
    text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string"))
    return text.when(F.isnan(c), "NaN").when(c == math.inf, "Infinity").when(c == -math.inf, "-Infinity").otherwise(c.cast("string"))


def string(t: Typed) -> Column:
    if t.kind == "number":
        return js_number(t.col) if not isinstance(t.dtype, T.IntegralType) else t.col.cast("string")
    if t.kind == "time":
        return js_number(number(t))
    if t.kind == "null":
        return F.lit(None).cast("string")
    return t.col.cast("string")


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it; null only for null."""
    inf = F.lit(math.inf)
    zero = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, F.try_divide(a, b)).otherwise(zero)


def remainder(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, F.try_mod(a, b)).otherwise(F.lit(math.nan))


def floored(c: Column, up: bool = False) -> Column:
    """floor or ceil in doubles: infinities and NaN stay."""
    c = c.cast("double")
    whole = F.ceil(c) if up else F.floor(c)
    return F.when(F.isnan(c) | (F.abs(c) >= 1e15), c).otherwise(whole.cast("double"))


def literal(value: object) -> Typed:
    """A constant; numbers are doubles."""
    if value is None:
        return Typed(F.lit(None).cast("double"), "null", T.DoubleType(), None)
    if isinstance(value, bool):
        return Typed(F.lit(value), "boolean", T.BooleanType(), value)
    if isinstance(value, int | float):
        return Typed(F.lit(float(value)), "number", T.DoubleType(), value)
    if isinstance(value, str):
        return Typed(F.lit(value), "string", T.StringType(), value)
    if hasattr(value, "timestamp"):  # an instant
        ms = round(value.timestamp() * 1000)
        return Typed(F.timestamp_millis(F.lit(ms)), "time", T.TimestampType(), value)
    if isinstance(value, list | tuple):
        items = unified([literal(x) for x in value])
        dtype = T.ArrayType(items[0].dtype if items else T.DoubleType())
        return Typed(F.array(*[x.col for x in items]) if items else F.array().cast(dtype), "array", dtype, list(value))
    if isinstance(value, dict):
        items = {k: literal(v) for k, v in value.items()}
        if not items:
            items = {"__dummy": literal(0)}
        dtype = T.StructType([T.StructField(k, x.dtype) for k, x in items.items()])
        return Typed(F.struct(*[x.col.alias(k) for k, x in items.items()]), "object", dtype, value)
    raise TypeError(f"no literal of {type(value).__name__}")


def unified(items: list[Typed]) -> list[Typed]:
    """Items brought to one kind: strings if any is a string, else numbers where they differ."""
    kinds = {x.kind for x in items if x.kind != "null"}
    if len(kinds) <= 1:
        kind = next(iter(kinds), "null")
        if kind == "number":
            return [Typed(number(x), "number", T.DoubleType(), x.value) for x in items]
        dtype = next((x.dtype for x in items if x.kind == kind), T.DoubleType())
        return [x if x.kind == kind else Typed(F.lit(None).cast(dtype), kind, dtype, x.value) for x in items]
    if kinds <= {"number", "boolean", "time"}:
        return [Typed(number(x), "number", T.DoubleType(), x.value) for x in items]
    return [Typed(string(x), "string", T.StringType(), x.value) for x in items]
