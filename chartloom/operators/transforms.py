"""The sixteen transforms: each takes a frame and its parameters and returns (frame, output signals)."""

from __future__ import annotations

import math
from collections import ChainMap

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import times
from chartloom.functions.compile import Compiler, Scope, quoted, unescaped
from chartloom.functions.host import Host
from chartloom.functions.types import Typed, kind_of, number, string, unified
from chartloom.operators import aggregates
from chartloom.operators.binning import solve
from chartloom.operators.frame import ORDER, exact_names, numbered, ordered, reordered

Result = tuple[DataFrame, dict]


def constant(value, scope: Scope):
    """A parameter: a plain value, or ``{"signal": expression}`` evaluated on the driver."""
    if isinstance(value, dict) and "signal" in value:
        return Host(scope).value(value["signal"])
    if isinstance(value, list):
        return [constant(v, scope) for v in value]
    return value


def name_of(field) -> str:
    """A field's name: a string or ``{"field": name}``."""
    return unescaped(field["field"] if isinstance(field, dict) else field)


def names(fields, scope: Scope) -> list[str]:
    return list(dict.fromkeys(name_of(f) for f in constant(fields, scope) or []))


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns added or overwritten in place."""
    return df.withColumns({k: v for k, v in new.items()}) if new else df


def sort_keys(df: DataFrame, sort: dict | None) -> list[Column]:
    """Keys of a sort; ascending puts nulls first, descending last. Unknown fields are left out."""
    fields, orders = (sort or {}).get("field") or [], (sort or {}).get("order") or []
    fields = fields if isinstance(fields, list) else [fields]
    orders = orders if isinstance(orders, list) else [orders]
    orders = orders + ["ascending"] * (len(fields) - len(orders))
    keys = [(quoted(name_of(f)), o) for f, o in zip(fields, orders, strict=False) if name_of(f) in df.columns]
    return [c.desc_nulls_last() if o == "descending" else c.asc_nulls_first() for c, o in keys]


def filter_(df: DataFrame, spec: dict, scope: Scope) -> Result:
    return df.filter(Compiler(df, scope).condition(spec["expr"])), {}


def formula(df: DataFrame, spec: dict, scope: Scope) -> Result:
    return with_columns(df, {unescaped(spec["as"]): Compiler(df, scope).typed(spec["expr"]).col}), {}


def project(df: DataFrame, spec: dict, scope: Scope) -> Result:
    fields = [name_of(f) for f in spec.get("fields", [])]
    given = spec.get("as") or []
    columns = [quoted(f).alias(unescaped(given[i]) if i < len(given) and given[i] else f) for i, f in enumerate(fields) if f in df.columns]
    return df.select(*[c for c in (ORDER,) if c in df.columns], *columns), {}


def extent(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """The least and greatest value of a field as a signal: one aggregation runs."""
    if not spec.get("signal"):
        return df, {}
    x = number(Compiler(df, scope).column(name_of(constant(spec["field"], scope))))
    row = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    return df, {spec["signal"]: [row["a"], row["b"]]}


def collect(df: DataFrame, spec: dict, scope: Scope) -> Result:
    keys = sort_keys(df, spec.get("sort"))
    return (reordered(df, keys) if keys else df), {}


def _operations(df: DataFrame, spec: dict, scope: Scope) -> list[tuple[str, str | None, str]]:
    """(operation, field, output name), each output once."""
    ops = constant(spec.get("ops"), scope) or ["count"]
    fields, given = constant(spec.get("fields"), scope) or [], spec.get("as") or []
    out: dict[str, tuple[str, str | None, str]] = {}
    for i, op in enumerate(ops):
        field = name_of(fields[i]) if i < len(fields) and fields[i] else None
        name = aggregates.named(op, field, given[i] if i < len(given) else None)
        out.setdefault(unescaped(name), (op, field, unescaped(name)))
    return list(out.values())


def _aggregated(df: DataFrame, operations: list, scope: Scope) -> list[tuple[str, Column]]:
    compiler = Compiler(df, scope)
    column = lambda f: compiler.column(f) if f in df.columns else None
    return [(name, aggregates.of(op, column(field) if field else None)) for op, field, name in operations]


def aggregate(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Groups in the order in which they first appear; null keys are a group."""
    if spec.get("cross") or spec.get("drop") is False:
        raise ValueError("aggregate with cross or without drop is not supported")
    keys = [k for k in names(spec.get("groupby"), scope) if k in df.columns]
    found = [(n, c) for n, c in _aggregated(df, _operations(df, spec, scope), scope) if n not in keys]
    out = df.groupBy(*[quoted(k) for k in keys]).agg(F.min(ORDER).alias(ORDER), *[c.alias(n) for n, c in found])
    if not keys:
        out = out.withColumn(ORDER, F.coalesce(F.col(ORDER), F.lit(0)))
    return out.select(ORDER, *[quoted(k) for k in keys], *[quoted(n) for n, _ in found]), {}


def joinaggregate(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Each row with its group's aggregates, as a join with the grouped table.

    A join leaves hot groups split over tasks, where a window would gather each in one.
    Null keys equal each other. Without keys the one row of totals is sent to all.
    """
    keys = [k for k in names(spec.get("groupby"), scope) if k in df.columns]
    found = _aggregated(df, _operations(df, spec, scope), scope)
    new = [n for n, _ in found]
    if not keys:
        totals = df.agg(*[c.alias(n) for n, c in found])
        return df.drop(*new).crossJoin(F.broadcast(totals)), {}
    groups = df.groupBy(*[quoted(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(*[c.alias(f"_agg{i}") for i, (_, c) in enumerate(found)])
    on = [quoted(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    out = df.join(groups, on, "inner")
    out = with_columns(out, {n: F.col(f"_agg{i}") for i, n in enumerate(new)})
    return out.drop(*[f"_key{i}" for i in range(len(keys))], *[f"_agg{i}" for i in range(len(new))]), {}


_RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def window(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Window functions; without a sort rows stand in input order.

    Frames count peer groups unless ``ignorePeers``. Spark has no such frames: from the
    start to the current group they are a range frame, and other bounds a range frame over
    the groups' dense rank. Equal keys are peers; row_number alone falls back on the input
    order to decide between them.
    """
    groupby = [quoted(k) for k in names(spec.get("groupby"), scope) if k in df.columns]
    keys = sort_keys(df, spec.get("sort"))
    compiler = Compiler(df, scope)
    by = keys or [F.col(ORDER).asc()]
    base = Window.partitionBy(*groupby).orderBy(*by)
    frame = constant(spec.get("frame"), scope) or [None, 0]
    low = Window.unboundedPreceding if frame[0] is None else -int(abs(frame[0]))
    high = Window.unboundedFollowing if frame[1] is None else int(frame[1])
    whole = frame[0] is None and frame[1] is None
    ops, fields, params, given = (spec.get(k) or [] for k in ("ops", "fields", "params", "as"))
    new: dict[str, Column] = {}
    source = df
    if whole:
        framed = Window.partitionBy(*groupby)
    elif spec.get("ignorePeers"):
        framed = Window.partitionBy(*groupby).orderBy(*by, F.col(ORDER)).rowsBetween(low, high)
    elif frame[0] is None and frame[1] == 0:
        framed = base.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        source = df.withColumn("_peers", F.dense_rank().over(base))
        framed = Window.partitionBy(*groupby).orderBy("_peers").rangeBetween(low, high)
    stable = Window.partitionBy(*groupby).orderBy(*by, F.col(ORDER))
    for i, op in enumerate(ops):
        field = name_of(fields[i]) if i < len(fields) and fields[i] else None
        name = unescaped(aggregates.named(op, field, given[i] if i < len(given) else None))
        x = compiler.column(field) if field and field in df.columns else None
        param = params[i] if i < len(params) and params[i] is not None else None
        if op == "row_number":
            new[name] = F.row_number().over(stable)
        elif op in _RANKS:
            new[name] = _RANKS[op]().over(base)
        elif op in ("first_value", "last_value"):
            new[name] = (F.first if op == "first_value" else F.last)(x.col if x else F.lit(None)).over(framed)
        elif op == "nth_value":
            new[name] = F.nth_value(x.col, int(param or 1)).over(framed)
        elif op == "ntile":
            new[name] = F.ntile(int(param or 1)).over(stable)
        elif op in ("lag", "lead"):
            new[name] = (F.lag if op == "lag" else F.lead)(x.col, int(param or 1)).over(stable)
        elif op in ("prev_value", "next_value"):
            near = stable.rowsBetween(Window.unboundedPreceding, 0) if op == "prev_value" else stable.rowsBetween(0, Window.unboundedFollowing)
            new[name] = (F.last if op == "prev_value" else F.first)(x.col, ignorenulls=True).over(near)
        elif op in ("min", "max") and x is not None:
            new[name] = (F.min if op == "min" else F.max)(number(x)).over(framed)
        elif op == "sum" and x is None:
            new[name] = F.lit(0.0)
        elif op in ("distinct", "stderr"):
            raise ValueError(f"{op} is not supported in windows")
        else:
            new[name] = aggregates.of(op, x, framed=True).over(framed)
    out = with_columns(source, new)
    return (out.drop("_peers") if source is not df else out), {}


def bin_(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """The bin of a number: start and end columns, and the bins chosen as a signal.

    Below the first bin the start is -inf, from the last bin's end on +inf; a value equal
    to that end counts to the last bin.
    """
    get = lambda k, default=None: default if constant(spec.get(k), scope) is None else constant(spec.get(k), scope)
    low, high = get("extent", [0.0, 0.0])
    bins = solve(low, high, get("maxbins", 20), get("base", 10), get("step"), get("steps"), get("span"), get("minstep", 0), get("divide", [5, 2]), get("nice", True))
    if (anchor := get("anchor")) is not None:
        bins = bins.through(anchor)
    start, stop, step, count = bins.start, bins.stop, bins.step, len(bins)
    field = name_of(constant(spec["field"], scope))
    x = number(Compiler(df, scope).column(field))
    index = F.floor((x - start) / F.lit(float(step)) + 1e-14)
    inf = F.lit(math.inf)
    value = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x == start + count * step, F.lit(start + (count - 1) * step))
    value = value.when(index < 0, -inf).when(index >= count, inf).otherwise(index * step + start)
    given = spec.get("as") or ["bin0", "bin1"]
    first, second = unescaped(given[0]), unescaped(given[1]) if len(given) > 1 else "bin1"
    df = with_columns(df, {first: value})
    df = with_columns(df, {second: quoted(first) + F.lit(float(step))})
    signal = {"fields": [field], "fname": f"bin_{field}", "start": float(start), "step": float(step), "stop": float(stop)}
    return df, ({spec["signal"]: signal} if spec.get("signal") else {})


def timeunit(df: DataFrame, spec: dict, scope: Scope) -> Result:
    units = constant(spec.get("units"), scope)
    if not units or any(spec.get(k) is not None for k in ("step", "extent", "maxbins", "signal")):
        raise ValueError("timeunit needs units, and supports no step, extent, maxbins or signal")
    compiler = Compiler(df, scope)
    instant = compiler.instant(compiler.column(name_of(constant(spec["field"], scope))))
    zone = "UTC" if spec.get("timezone") == "utc" else scope.zone
    start, end = times.unit_start(instant, list(units), zone, scope.session)
    given = spec.get("as") or ["unit0", "unit1"]
    return with_columns(df, {unescaped(given[0]): start, unescaped(given[1] if len(given) > 1 else "unit1"): end}), {}


def stack(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Running totals in each group: positive and negative values apart, or centred or normalised."""
    groupby = [quoted(k) for k in names(spec.get("groupby"), scope) if k in df.columns]
    offset = constant(spec.get("offset"), scope) or "zero"
    x = F.coalesce(number(Compiler(df, scope).column(name_of(constant(spec["field"], scope)))), F.lit(0.0))
    by = [*sort_keys(df, spec.get("sort")), F.col(ORDER).asc()]
    given = spec.get("as") or ["y0", "y1"]
    first, second = unescaped(given[0]), unescaped(given[1] if len(given) > 1 else "y1")
    df = bare = df.withColumn("_value", x if offset == "zero" else F.abs(x))
    part = [*groupby, F.col("_value") < 0] if offset == "zero" else groupby
    to = F.sum("_value").over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_to", to)
    start, end = F.col("_to") - F.col("_value"), F.col("_to")
    if offset == "normalize":
        df = df.withColumn("_total", F.sum("_value").over(Window.partitionBy(*groupby)))
        share = lambda c: F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(F.try_divide(c, F.col("_total")))
        start, end = share(start), share(end)
    elif offset == "center":
        df = df.withColumn("_total", F.sum("_value").over(Window.partitionBy(*groupby)))
        most = bare.groupBy(*groupby).agg(F.sum("_value").alias("_total")).agg(F.max("_total").alias("_most"))
        df = df.crossJoin(F.broadcast(most))  # one row
        shift = (F.col("_most") - F.col("_total")) / 2
        start, end = start + shift, end + shift
    elif offset != "zero":
        raise ValueError(f"unknown stack offset {offset!r}")
    return df.withColumns({first: start, second: end}).drop(*[c for c in ("_value", "_to", "_total", "_most") if c not in (first, second)]), {}


def impute(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Missing combinations of key and group, and nulls, get a value; added rows come last, by group, then key."""
    if spec.get("method", "value") != "value" or spec.get("keyvals"):
        raise ValueError("impute is supported with method value and without keyvals")
    field, key = name_of(spec["field"]), name_of(spec["key"])
    groupby = [k for k in names(spec.get("groupby"), scope) if k in df.columns]
    value = constant(spec.get("value", 0), scope)
    dtype = df.schema[field].dataType if field in df.columns else T.DoubleType()
    fill = F.lit(value).cast(dtype)
    if not groupby:
        return with_columns(df, {field: F.coalesce(quoted(field), fill) if field in df.columns else fill}), {}
    keys = df.where(quoted(key).isNotNull()).groupBy(quoted(key).alias("_k")).agg(F.min(ORDER).alias("_ko"))
    groups = df.groupBy(*[quoted(g).alias(f"_g{i}") for i, g in enumerate(groupby)]).agg(F.min(ORDER).alias("_go"))
    grid = groups.crossJoin(keys)  # the result: every group with every key
    on = [quoted(key).eqNullSafe(F.col("_k")), *[quoted(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groupby)]]
    out = grid.join(df, on, "left")
    rank = F.struct(F.col(ORDER).isNull().alias("added"), F.when(F.col(ORDER).isNull(), F.col("_go")).alias("g"), F.when(F.col(ORDER).isNull(), F.col("_ko")).alias("k"), F.col(ORDER).alias("o"))
    columns = []
    for c in df.columns:
        if c == ORDER:
            continue
        if c == key:
            columns.append(F.col("_k").alias(c))
        elif c in groupby:
            columns.append(F.col(f"_g{groupby.index(c)}").alias(c))
        elif c == field:
            columns.append(F.coalesce(quoted(c), fill).alias(c))
        else:
            columns.append(quoted(c))
    return out.select(rank.alias("_rank"), *columns).orderBy("_rank").withColumn(ORDER, F.monotonically_increasing_id()).drop("_rank"), {}


def pivot(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """A column for each distinct value, sorted; one query finds the values.

    Null becomes the column ``null`` and sorts first, the empty string a blank.
    """
    field, value = name_of(constant(spec["field"], scope)), name_of(constant(spec["value"], scope))
    groupby = [k for k in names(spec.get("groupby"), scope) if k in df.columns]
    op, limit = constant(spec.get("op"), scope) or "sum", constant(spec.get("limit"), scope)
    compiler = Compiler(df, scope)
    label = string(compiler.column(field))
    shown = F.when(label.isNull(), "null").when(label == "", " ").otherwise(label)
    sort = F.when(label.isNull(), "!!!null").otherwise(shown)
    most = int(limit) if limit else int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000")) + 1
    found = df.select(sort.alias("s"), shown.alias("v")).distinct().orderBy("s").limit(most).collect()
    if not found:
        raise ValueError("pivot of no rows")
    if not limit and len(found) == most:
        raise ValueError(f"pivot would make {most} columns or more; give it a limit")
    x = compiler.column(value)
    dtype = x.dtype
    columns = []
    for row in found:
        here = shown.eqNullSafe(F.lit(row["v"]))
        if op == "count":
            c = F.count(F.when(here, F.lit(1)))
        elif op == "valid":
            c = F.sum(F.when(here, x.col.isNotNull().cast("long")).otherwise(0))
        elif op == "missing":
            c = F.sum(F.when(here, x.col.isNull().cast("long")).otherwise(0))
        else:
            c = aggregates.of(op, Typed(F.when(here, x.col), x.kind, dtype))
            if op == "sum":
                c = F.coalesce(c, F.lit(0.0))
        columns.append(c.alias(row["v"]))
    out = df.groupBy(*[quoted(k) for k in groupby]).agg(F.min(ORDER).alias(ORDER), *columns)
    return out.select(ORDER, *[quoted(k) for k in groupby], *[quoted(r["v"]) for r in found]), {}


def fold(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Each row once for each field, with the field's name and value."""
    fields = [name_of(f) for f in constant(spec.get("fields"), scope) or []]
    if not fields:
        return df, {}
    given = spec.get("as") or ["key", "value"]
    key, value = unescaped(given[0]), unescaped(given[1] if len(given) > 1 else "value")
    compiler = Compiler(df, scope)
    columns = [Typed(quoted(f), kind_of(df.schema[f].dataType), df.schema[f].dataType) if f in df.columns else compiler.column(f) for f in fields]
    same = {c.dtype for c in columns if c.kind != "null"}
    if len(same) > 1:
        columns = unified(columns)
    elif same:
        columns = [c if c.kind != "null" else Typed(F.lit(None).cast(next(iter(same))), "null") for c in columns]
    items = F.array(*[F.struct(F.lit(f).alias("k"), c.col.alias("v"), F.lit(i).alias("i")) for i, (f, c) in enumerate(zip(fields, columns, strict=True))])
    out = df.withColumn("_item", F.explode(items))
    out = out.withColumns({key: F.col("_item.k"), value: F.col("_item.v"), ORDER: F.col(ORDER) * len(fields) + F.col("_item.i")})
    return out.drop("_item"), {}


def identifier(df: DataFrame, spec: dict, scope: Scope) -> Result:
    return numbered(df, unescaped(spec["as"])), {}


def sequence(df: DataFrame, spec: dict, scope: Scope) -> Result:
    """Numbers from start to before stop; the input rows are ignored."""
    start, stop = float(constant(spec["start"], scope)), float(constant(spec["stop"], scope))
    step = constant(spec.get("step"), scope)
    step = (1.0 if stop >= start else -1.0) if step is None else float(step)
    n = max(0, math.ceil((stop - start) / step - 1e-9)) if step else 0
    rows = df.sparkSession.range(n)
    return rows.select(F.col("id").alias(ORDER), (F.lit(start) + F.col("id") * step).alias(unescaped(spec.get("as") or "data"))), {}


TRANSFORMS = {
    "filter": filter_, "formula": formula, "project": project, "extent": extent, "collect": collect, "aggregate": aggregate, "joinaggregate": joinaggregate, "window": window,
    "bin": bin_, "timeunit": timeunit, "stack": stack, "impute": impute, "pivot": pivot, "fold": fold, "identifier": identifier, "sequence": sequence,
}


#: Transforms of single rows: they leave the order alone and come before it, so that filters reach the scan.
_BY_ROW = ("filter", "formula", "project", "extent", "bin", "timeunit")


def run(df: DataFrame, transforms: list[dict], scope: Scope) -> Result:
    """A pipeline of transforms; their output signals are visible to those after.

    The order column is added where a transform first needs it: ids of rows that have been
    filtered ascend like those of all rows, and a scan below them takes the filters.
    """
    signals: dict = {}
    for spec in transforms:
        kind = spec["type"]
        if kind not in TRANSFORMS:
            raise ValueError(f"transform {kind!r} is not supported")
        own = Scope(ChainMap(signals, scope.signals), scope.rows, scope.zone, scope.input_zone, scope.session)
        with exact_names(df.sparkSession):
            df, more = TRANSFORMS[kind](df if kind in _BY_ROW else ordered(df), spec, own)
        signals |= more
    return df, signals
