"""Interactive selections: stores of brushed ranges and clicked values."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import times
from chartloom.functions.parser import ExpressionError
from chartloom.functions.types import Typed, number, string

#: Range types and whether they leave out their lower and upper bound. Fixed values.
RANGES = {"R": (False, False), "R-E": (True, True), "R-LE": (True, False), "R-RE": (False, True)}


def _as_number(v: object, zone: str) -> float | None:
    """A store's value as a number; times that the chart sends without a zone are local."""
    if not isinstance(v, str):
        return float(v)
    try:
        return float(v)
    except ValueError:
        t = times.host_parsed(v, zone)
        return None if t is None else round(t.timestamp() * 1000)


def _truth(value: object) -> bool:
    return value not in ("false", "", False, None, 0)


def _in(column: Typed, values: list, zone: str) -> Column:
    some = [v for v in values if v is not None]
    if column.kind == "boolean":
        test = column.col.isin([_truth(v) for v in some])
    elif column.kind in ("number", "time"):
        numbers = [n for v in some if (n := _as_number(v, zone)) is not None]
        whole = isinstance(column.dtype, T.IntegralType) and all(n == int(n) for n in numbers if math.isfinite(n))
        test = column.col.isin([int(n) for n in numbers]) if whole else number(column).isin(numbers)
    else:
        test = string(column).isin([_text(v) for v in some])
    if len(some) < len(values):
        test = F.coalesce(test, F.lit(False)) | column.col.isNull()
    return F.coalesce(test, F.lit(False))


def _text(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def _within(column: Typed, values: list, kind: str, zone: str) -> Column:
    if len(values) < 2:
        raise ExpressionError("a range selection needs two bounds")
    ends = [_as_number(v, zone) for v in (values[0], values[-1])]
    if None in ends:
        return F.lit(False)
    low, high = sorted(ends)
    less, more = RANGES[kind]
    if isinstance(column.dtype, T.IntegralType) and math.isfinite(low) and math.isfinite(high):
        # whole bounds on the column's own type let the scan use its statistics
        c, a, b = column.col, (math.floor(low) + 1 if less else math.ceil(low)), (math.ceil(high) - 1 if more else math.floor(high))
        return F.coalesce((c >= F.lit(a)) & (c <= F.lit(b)), F.lit(False))
    c = number(column)
    return F.coalesce((c > low if less else c >= low) & (c < high if more else c <= high), F.lit(False))


def test(rows: list[dict], column_of, operation: str = "union", zone: str = "UTC") -> Column:
    """Whether a row of the data is selected by a store's rows; an empty store selects nothing.

    ``column_of`` gives the typed column of a field. In a store's row all fields must hold;
    rows are combined by union (any of them) or intersect (all of them).
    """
    if operation not in ("union", "intersect"):
        raise ExpressionError(f"unknown selection operation {operation!r}")
    if not rows:
        return F.lit(False)
    if operation == "union":
        rows = _merged(rows)
    tests = []
    for row in rows:
        fields = row.get("fields") or []
        values = row.get("values") or []
        one = []
        for field, value in zip(fields, values, strict=False):
            column = column_of(field["field"])
            kind = field.get("type", "E")
            value = value if isinstance(value, list | tuple) else [value]
            if kind == "E":
                one.append(_in(column, list(value), zone))
            elif kind in RANGES:
                one.append(_within(column, list(value), kind, zone))
            else:
                raise ExpressionError(f"unknown selection type {kind!r}")
        tests.append(functools.reduce(operator.and_, one) if one else F.lit(True))
    return functools.reduce(operator.or_ if operation == "union" else operator.and_, tests)


def _merged(rows: list[dict]) -> list[dict]:
    """Rows of one equality on the same field as one list of values, which scans can push down."""
    lists: dict[str, list] = {}
    rest = []
    for row in rows:
        fields = row.get("fields") or []
        if len(fields) == 1 and fields[0].get("type", "E") == "E" and row.get("values"):
            value = row["values"][0]
            lists.setdefault(fields[0]["field"], []).extend(value if isinstance(value, list | tuple) else [value])
        else:
            rest.append(row)
    return rest + [{"fields": [{"field": f, "type": "E"}], "values": [v]} for f, v in lists.items()]


def resolve(rows: list[dict], operation: str = "union") -> dict:
    """What a selection amounts to: for each field its values, or the bounds of its ranges."""
    ranges: dict[str, list] = {}
    lists: dict[str, list] = {}
    for row in rows:
        for field, value in zip(row.get("fields") or [], row.get("values") or [], strict=False):
            name = field["field"]
            value = list(value) if isinstance(value, list | tuple) else [value]
            if field.get("type", "E") == "E":
                known = lists.setdefault(name, [] if operation == "union" or name not in lists else lists[name])
                if operation == "intersect" and known:
                    lists[name] = [v for v in known if v in value]
                else:
                    known += [v for v in value if v not in known]
            else:
                low, high = min(value), max(value)
                if name not in ranges:
                    ranges[name] = [low, high]
                elif operation == "union":
                    ranges[name] = [min(low, ranges[name][0]), max(high, ranges[name][1])]
                else:
                    ranges[name] = [max(low, ranges[name][0]), min(high, ranges[name][1])]
    return lists | ranges
