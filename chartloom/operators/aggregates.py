"""Aggregate operations by name, for groups and for window frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.types import Typed, number

#: Operations that groups can compute.
SUPPORTED = (
    "count", "valid", "missing", "distinct", "sum", "mean", "average", "min", "max", "median", "q1", "q3", "variance", "variancep", "stdev", "stdevp", "product", "stderr", "values",
)


def of(op: str, field: Typed | None, framed: bool = False) -> Column:
    """The aggregate of a column; ``field`` None stands for a column that does not exist. ``framed``: for a window."""
    if op == "count":
        return F.count(F.lit(1))
    if field is None:
        return F.lit(0.0) if op == "sum" else F.max(F.lit(None).cast("double"))
    c = field.col
    match op:
        case "valid":
            return F.count(F.when(c.isNotNull(), 1))
        case "missing":
            return F.count(F.when(c.isNull(), 1))
        case "distinct":
            return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
        case "min":
            return F.min(c)
        case "max":
            return F.max(c)
        case "values":
            return F.collect_list(c)
    x = number(field)
    match op:
        case "sum":
            return F.sum(x)
        case "mean" | "average":
            return F.avg(x)
        case "median" | "q1" | "q3":
            shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
            if framed:
                return F.percentile(x, shares[op])
            # one and the same aggregate for all three, so that a field's values are gathered once
            return F.get(F.percentile(x, F.array(*map(F.lit, shares.values()))), F.lit([*shares].index(op)))
        case "variance":
            return F.var_samp(x)
        case "variancep":
            return F.var_pop(x)
        case "stdev":
            return F.stddev_samp(x)
        case "stdevp":
            return F.stddev_pop(x)
        case "product":
            return F.product(x)
        case "stderr":
            return F.stddev_samp(x) / F.sqrt(F.count(x))
    raise ValueError(f"aggregate operation {op!r} is not supported")


def named(op: str, field: str | None, given: str | None) -> str:
    """The output column's name: the given one, else the operation, with its field if it has one."""
    return given or (op if not field or op == "count" and not field else f"{op}_{field}")
