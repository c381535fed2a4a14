"""Queries over the test tables, each a chart specification, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.runtime import Runtime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _scaled(c: Column, digits: int) -> Column:
    """A double rounded as SQL does it in doubles: scaled, rounded and scaled back, which from 2^53 / 10^digits on shows in its last digits."""
    scaled = c * 10.0**digits
    return F.when(F.abs(scaled) < math.inf, F.round(scaled) / 10.0**digits).otherwise(c)


def _rounded(df: DataFrame, columns: list[str], digits: int, scaled: str = "") -> DataFrame:
    """The named columns, doubles rounded: sums differ in their last digits with the order of addition."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    as_sql = {c: _scaled if c in scaled.split() else F.round for c in columns}
    return df.select(*[(as_sql[c](F.col(f"`{c}`"), digits) if isinstance(kinds[c], T.DoubleType) else F.col(f"`{c}`")).alias(c) for c in columns])


def _add(name: str, spec: dict, columns: str, sql: str, digits: int = 4, zone: str = "UTC", dataset: str = "out", scaled: str = "") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        runtime = Runtime(spark, local_tz=zone, default_input_tz="UTC", base=sf_dir)
        (df,), _ = runtime.pre_transform_datasets(spec, [dataset], in_order=False)
        return _rounded(df, columns.split(), digits, scaled)

    QUERIES[name] = query
    ORACLES[name] = sql


def _one(table: str, *transforms: dict, **more) -> dict:
    return {"data": [{"name": "out", "url": f"{table}.parquet", "transform": list(transforms)}], **more}


def _formulas(**expressions: str) -> list[dict]:
    return [{"type": "formula", "expr": e, "as": n} for n, e in expressions.items()]


# bin, extent, aggregate, collect: the histogram
_add(
    "histogram",
    _one(
        "lineitem", {"type": "extent", "field": "l_extendedprice", "signal": "ext"}, {"type": "bin", "field": "l_extendedprice", "extent": {"signal": "ext"}, "as": ["b0", "b1"]},
        {"type": "aggregate", "groupby": ["b0", "b1"], "ops": ["count"], "as": ["n"]}, {"type": "collect", "sort": {"field": "b0"}},
    ),
    "b0 b1 n",
    """WITH e AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), l AS (SELECT hi - lo AS w, lo, hi FROM e),
    s0 AS (SELECT *, power(10, floor(log10(w) + 0.5) - 2) AS a FROM l), s1 AS (SELECT *, CASE WHEN ceil(w / a) > 20 THEN a * 10 ELSE a END AS b FROM s0),
    s2 AS (SELECT *, CASE WHEN w / (b / 5) <= 20 THEN b / 5 ELSE b END AS c FROM s1), s3 AS (SELECT *, CASE WHEN w / (c / 2) <= 20 THEN c / 2 ELSE c END AS s FROM s2),
    q AS (SELECT floor(lo / s) * s AS a0, ceil(hi / s) * s AS a1, s AS st FROM s3),
    v AS (SELECT CASE WHEN l_extendedprice = a1 THEN a1 - st ELSE a0 + st * floor((l_extendedprice - a0) / st + 1e-14) END AS b0, st FROM lineitem, q)
    SELECT round(b0, 4) AS b0, round(b0 + st, 4) AS b1, count(*) AS n FROM v GROUP BY 1, 2""",
)
_add(
    "bin_fixed_step", _one("lineitem", {"type": "bin", "field": "l_quantity", "extent": [10, 40], "step": 5, "as": ["b0", "b1"]}, {"type": "aggregate", "groupby": ["b0", "b1"], "ops": ["count", "sum"], "fields": [None, "l_quantity"], "as": ["n", "q"]}),
    "b0 b1 n q",
    """WITH v AS (SELECT l_quantity q, CASE WHEN l_quantity = 40 THEN 35 WHEN l_quantity < 10 THEN '-infinity'::double WHEN l_quantity > 40 THEN 'infinity'::double ELSE 10 + 5 * floor((l_quantity - 10) / 5) END AS b0 FROM lineitem)
    SELECT b0::double AS b0, b0 + 5.0 AS b1, count(*) AS n, round(sum(q), 4) AS q FROM v GROUP BY 1, 2""",
)
_add("filter_rows", _one("lineitem", {"type": "filter", "expr": "datum.l_quantity < 5 && datum.l_returnflag === 'R' || datum.l_discount >= 0.1"}), "l_orderkey l_linenumber l_quantity l_discount",
     "SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_discount, 4) AS l_discount FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R' OR l_discount >= 0.1")
_add("formula_arithmetic", _one("orders", *_formulas(a="datum.o_totalprice * 2 - datum.o_custkey / 4", b="datum.o_orderkey % 7", c="(datum.o_orderkey + 1) / 0", d="-datum.o_custkey + +'3.5'")), "o_orderkey a b c d",
     "SELECT o_orderkey, round(o_totalprice * 2 - o_custkey / 4.0, 4) AS a, (o_orderkey % 7)::double AS b, 'infinity'::double AS c, round(-o_custkey + 3.5, 4)::double AS d FROM orders", scaled="a")
_add("project_fields", _one("customer", {"type": "project", "fields": ["c_custkey", "c_mktsegment", "no_such_field"]}), "c_custkey c_mktsegment", "SELECT c_custkey, c_mktsegment FROM customer")
_add("extent_signal", {"data": [{"name": "t", "url": "orders.parquet", "transform": [{"type": "extent", "field": "o_totalprice", "signal": "ext"}]}, {"name": "out", "values": [{"k": 1}], "transform": _formulas(lo="ext[0]", hi="ext[1]", s="span(ext)")}]},
     "lo hi s", "SELECT round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, round(max(o_totalprice) - min(o_totalprice), 4) AS s FROM orders")
_add("collect_identifier", _one("orders", {"type": "collect", "sort": {"field": ["o_orderpriority", "o_totalprice", "o_orderkey"], "order": ["descending", "ascending", "ascending"]}}, {"type": "identifier", "as": "id"}), "o_orderkey id",
     "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS id FROM orders")
_OPS = ["count", "valid", "missing", "distinct", "sum", "mean", "min", "max", "variance", "variancep", "stdev", "stdevp", "stderr"]
_add("aggregate_ops", _one("lineitem", {"type": "aggregate", "groupby": ["l_returnflag", "l_linestatus"], "ops": _OPS, "fields": [None] + ["l_quantity"] * 12, "as": _OPS}), "l_returnflag l_linestatus " + " ".join(_OPS),
     """SELECT l_returnflag, l_linestatus, count(*) AS count, count(l_quantity) AS valid, 0::bigint AS missing, count(DISTINCT l_quantity) AS "distinct", round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS min,
     max(l_quantity) AS max, round(var_samp(l_quantity), 4) AS variance, round(var_pop(l_quantity), 4) AS variancep, round(stddev_samp(l_quantity), 4) AS stdev, round(stddev_pop(l_quantity), 4) AS stdevp, round(stddev_samp(l_quantity) / sqrt(count(*)), 4) AS stderr FROM lineitem GROUP BY 1, 2""")  # fmt: skip
_add("aggregate_quartiles", _one("lineitem", {"type": "aggregate", "groupby": ["l_returnflag"], "ops": ["q1", "median", "q3"], "fields": ["l_extendedprice"] * 3}), "l_returnflag q1_l_extendedprice median_l_extendedprice q3_l_extendedprice",
     "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1_l_extendedprice, round(median(l_extendedprice), 4) AS median_l_extendedprice, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3_l_extendedprice FROM lineitem GROUP BY 1")
_add("aggregate_null_keys", _one("events", *_formulas(k="datum.event_type == 'click' ? null : datum.event_type", v="datum.event_type == 'view' ? null : datum.value"), {"type": "aggregate", "groupby": ["k"], "ops": ["count", "distinct", "missing", "sum"], "fields": [None, "v", "v", "v"], "as": ["n", "d", "m", "s"]}), "k n d m s",
     """WITH e AS (SELECT nullif(event_type, 'click') AS k, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events)
     SELECT k, count(*) AS n, count(DISTINCT v) + max((v IS NULL)::int) AS d, sum((v IS NULL)::int)::bigint AS m, round(sum(v), 4) AS s FROM e GROUP BY 1""", 2)  # fmt: skip
ORACLES["aggregate_null_keys"] = ORACLES["aggregate_null_keys"].replace("round(sum(v), 4)", "round(sum(v), 2)")
_add("joinaggregate_share", _one("orders", {"type": "joinaggregate", "groupby": ["o_orderpriority"], "ops": ["max", "count"], "fields": ["o_totalprice", None], "as": ["m", "n"]}, *_formulas(share="datum.o_totalprice / datum.m")), "o_orderkey m n share",
     "SELECT o_orderkey, round(max(o_totalprice) OVER w, 4) AS m, count(*) OVER w AS n, round(o_totalprice / max(o_totalprice) OVER w, 4) AS share FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
_add("joinaggregate_total", _one("part", {"type": "joinaggregate", "ops": ["min", "max"], "fields": ["p_size", "p_size"], "as": ["lo", "hi"]}), "p_partkey lo hi", "SELECT p_partkey, min(p_size) OVER () AS lo, max(p_size) OVER () AS hi FROM part")
_RANK = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist"]
_add("window_ranks", _one("orders", {"type": "formula", "expr": "floor(datum.o_totalprice / 1000)", "as": "k"}, {"type": "window", "groupby": ["o_orderstatus"], "sort": {"field": "k", "order": "descending"}, "ops": _RANK[1:], "as": _RANK[1:]}), "o_orderkey " + " ".join(_RANK[1:]),
     """WITH o AS (SELECT *, floor(o_totalprice / 1000) AS k FROM orders) SELECT o_orderkey, rank() OVER w::int AS rank, dense_rank() OVER w::int AS dense_rank, round(percent_rank() OVER w, 4) AS percent_rank, round(cume_dist() OVER w, 4) AS cume_dist
     FROM o WINDOW w AS (PARTITION BY o_orderstatus ORDER BY k DESC)""".replace("rank() OVER w::int", "(rank() OVER w)::int").replace("dense_(rank() OVER w)::int", "(dense_rank() OVER w)::int"))  # fmt: skip
_add("window_rows_frame", _one("events", {"type": "window", "groupby": ["event_type"], "sort": {"field": "event_id"}, "ignorePeers": True, "frame": [-2, 2], "ops": ["sum", "mean", "min", "max", "count", "first_value", "last_value"], "fields": ["value"] * 4 + [None] + ["value"] * 2, "as": ["s", "m", "lo", "hi", "n", "f", "l"]}), "event_id s m lo hi n f l",
     """SELECT event_id, round(sum(value) OVER w, 4) AS s, round(avg(value) OVER w, 4) AS m, round(min(value) OVER w, 4) AS lo, round(max(value) OVER w, 4) AS hi, count(*) OVER w AS n, round(first_value(value) OVER w, 4) AS f, round(last_value(value) OVER w, 4) AS l
     FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")  # fmt: skip
_add("window_groups_frame", _one("part", {"type": "window", "groupby": ["p_brand"], "sort": {"field": "p_size"}, "frame": [-1, 1], "ops": ["count", "sum"], "fields": [None, "p_size"], "as": ["n", "s"]}), "p_partkey n s",
     "SELECT p_partkey, count(*) OVER w AS n, (sum(p_size) OVER w)::double AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
_add("window_running", _one("orders", {"type": "window", "groupby": ["o_custkey"], "sort": {"field": "o_orderkey"}, "ops": ["sum", "row_number", "lag", "lead"], "fields": ["o_orderkey", None, "o_orderkey", "o_orderkey"], "as": ["run", "rn", "before", "after"]}, *_formulas(before="+datum.before", after="+datum.after")), "o_orderkey run rn before after",
     "SELECT o_orderkey, (sum(o_orderkey) OVER w)::double AS run, (row_number() OVER w)::int AS rn, (lag(o_orderkey) OVER w)::double AS before, (lead(o_orderkey) OVER w)::double AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_add("top_k_per_group", _one("orders", {"type": "window", "groupby": ["o_orderpriority"], "sort": {"field": ["o_totalprice", "o_orderkey"], "order": ["descending", "ascending"]}, "ops": ["row_number"], "as": ["rn"]}, {"type": "filter", "expr": "datum.rn <= 5"}), "o_orderpriority o_orderkey rn",
     "SELECT o_orderpriority, o_orderkey, rn::int AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
_SIGNED = _formulas(v="datum.o_orderkey % 3 == 0 ? -(datum.o_orderkey % 100) : datum.o_orderkey % 100")
_V = "(CASE WHEN o_orderkey % 3 = 0 THEN -(o_orderkey % 100) ELSE o_orderkey % 100 END)::double"
_add("stack_zero", _one("orders", *_SIGNED, {"type": "stack", "field": "v", "groupby": ["o_orderpriority"], "sort": {"field": "o_orderkey"}}), "o_orderkey y0 y1",
     f"WITH o AS (SELECT *, {_V} AS v FROM orders) SELECT o_orderkey, sum(v) OVER w - v AS y0, sum(v) OVER w AS y1 FROM o WINDOW w AS (PARTITION BY o_orderpriority, v < 0 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
_add("stack_normalize", _one("orders", *_SIGNED, {"type": "stack", "field": "v", "groupby": ["o_orderpriority"], "sort": {"field": "o_orderkey", "order": "descending"}, "offset": "normalize"}), "o_orderkey y0 y1",
     f"""WITH o AS (SELECT *, abs({_V}) AS v FROM orders), t AS (SELECT o_orderkey, v, sum(v) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS r, sum(v) OVER (PARTITION BY o_orderpriority) AS s FROM o)
     SELECT o_orderkey, round((r - v) / s, 4) AS y0, round(r / s, 4) AS y1 FROM t""")  # fmt: skip
_add("stack_center", _one("orders", *_SIGNED, {"type": "stack", "field": "v", "groupby": ["o_orderstatus"], "sort": {"field": "o_orderkey"}, "offset": "center"}), "o_orderkey y0 y1",
     f"""WITH o AS (SELECT *, abs({_V}) AS v FROM orders), t AS (SELECT o_orderkey, v, sum(v) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS r, sum(v) OVER (PARTITION BY o_orderstatus) AS s FROM o)
     SELECT o_orderkey, round(r - v + (max(s) OVER () - s) / 2, 4) AS y0, round(r + (max(s) OVER () - s) / 2, 4) AS y1 FROM t""")  # fmt: skip
_add("impute_grid", _one("events", {"type": "aggregate", "groupby": ["user_id", "event_type"], "ops": ["count"], "as": ["n"]}, {"type": "impute", "field": "n", "key": "event_type", "groupby": ["user_id"], "value": 0}), "user_id event_type n",
     "SELECT u.user_id, t.event_type, coalesce(n, 0)::bigint AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.event_type = t.event_type")
_add("pivot_sum", _one("events", {"type": "pivot", "field": "event_type", "value": "value", "groupby": ["user_id"], "op": "sum"}), "user_id click error purchase signup view",
     "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (WHERE event_type = '{t}'), 0), 4) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
_add("pivot_count_limit", _one("orders", {"type": "pivot", "field": "o_orderstatus", "value": "o_totalprice", "groupby": ["o_orderpriority"], "op": "count", "limit": 2}), "o_orderpriority F O",
     "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1")
_add("fold_columns", _one("lineitem", {"type": "fold", "fields": ["l_discount", "l_tax", "absent"]}, {"type": "aggregate", "groupby": ["key"], "ops": ["count", "valid", "sum"], "fields": [None, "value", "value"], "as": ["n", "v", "s"]}), "key n v s",
     "SELECT * FROM (SELECT 'l_discount' AS key, count(*) AS n, count(l_discount) AS v, round(sum(l_discount), 2) AS s FROM lineitem UNION ALL SELECT 'l_tax', count(*), count(l_tax), round(sum(l_tax), 2) FROM lineitem UNION ALL SELECT 'absent', count(*), 0, NULL FROM lineitem)", 2)
_add("sequence_squares", {"data": [{"name": "out", "transform": [{"type": "sequence", "start": 2, "stop": {"signal": "20 * 5"}, "step": 0.5}, *_formulas(sq="pow(datum.data, 2)")]}]}, "data sq", "SELECT 2 + i * 0.5::double AS data, round(power(2 + i * 0.5::double, 2), 4) AS sq FROM range(196) t(i)")
_MS = "epoch_ms({})::double"


def _unit(name: str, table: str, field: str, units: list[str], start: str, end: str, key: str, zone: str = "UTC") -> None:
    spec = _one(table, {"type": "timeunit", "field": field, "units": units}, *_formulas(a="time(datum.unit0)", b="time(datum.unit1)"))
    _add(name, spec, f"{key} a b", f"SELECT {key}, {_MS.format(start)} AS a, {_MS.format(end)} AS b FROM {table}", zone=zone)


_unit("timeunit_yearmonth", "orders", "o_orderdate", ["year", "month"], "date_trunc('month', o_orderdate)::timestamp", "(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::timestamp", "o_orderkey")
_unit("timeunit_yearquarter", "orders", "o_orderdate", ["year", "quarter"], "date_trunc('quarter', o_orderdate)::timestamp", "(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::timestamp", "o_orderkey")
_unit("timeunit_month", "orders", "o_orderdate", ["month"], "make_timestamp(2012, month(o_orderdate), 1, 0, 0, 0)", "(make_timestamp(2012, month(o_orderdate), 1, 0, 0, 0) + INTERVAL 1 MONTH)::timestamp", "o_orderkey")
_unit("timeunit_yearweek", "orders", "o_orderdate", ["year", "week"], "(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY)::timestamp", "(date_trunc('week', o_orderdate + INTERVAL 1 DAY) + INTERVAL 6 DAY)::timestamp", "o_orderkey")
_unit("timeunit_day", "orders", "o_orderdate", ["day"], "(TIMESTAMP '2012-01-01' + to_days(dayofweek(o_orderdate)::int))::timestamp", "(TIMESTAMP '2012-01-02' + to_days(dayofweek(o_orderdate)::int))::timestamp", "o_orderkey")
_unit("timeunit_date_hours", "events", "ts", ["date", "hours"], "(TIMESTAMP '2012-01-01' + to_days(day(ts)::int - 1) + to_hours(hour(ts)))::timestamp", "(TIMESTAMP '2012-01-01' + to_days(day(ts)::int - 1) + to_hours(hour(ts) + 1))::timestamp", "event_id")
_unit("timeunit_dayofyear", "orders", "o_orderdate", ["year", "dayofyear"], "date_trunc('day', o_orderdate)::timestamp", "(date_trunc('day', o_orderdate) + INTERVAL 1 DAY)::timestamp", "o_orderkey")
_unit("timeunit_local_zone", "events", "ts", ["year", "month", "date"], "(date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR)::timestamp", "(date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 29 HOUR)::timestamp", "event_id", "America/New_York")
_add("date_parts", _one("events", *_formulas(y="year(datum.ts)", q="quarter(datum.ts)", mo="month(datum.ts)", d="date(datum.ts)", wd="day(datum.ts)", dy="utcdayofyear(datum.ts)", h="hours(datum.ts)", mi="minutes(datum.ts)", s="seconds(datum.ts)", ms="milliseconds(datum.ts)")), "event_id y q mo d wd dy h mi s ms",
     "SELECT event_id, year(ts)::double AS y, quarter(ts)::double AS q, (month(ts) - 1)::double AS mo, day(ts)::double AS d, dayofweek(ts)::double AS wd, dayofyear(ts)::double AS dy, hour(ts)::double AS h, minute(ts)::double AS mi, second(ts)::double AS s, (millisecond(ts) % 1000)::double AS ms FROM events")
_add("time_format", _one("events", *_formulas(a="utcFormat(datum.ts, '%Y-%m-%d %H:%M:%S.%L')", b="timeFormat(datum.ts, '%b %d, %Y %I:%M %p')", c="timeFormat(datum.ts, '%A %j')")), "event_id a b c",
     "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS a, strftime(ts, '%b %d, %Y %I:%M %p') AS b, strftime(ts, '%A %j') AS c FROM events")
_add("date_building", _one("orders", *_formulas(a="time(datetime(year(datum.o_orderdate), 1, 15, 6, 30))", b="time(timeOffset('month', datum.o_orderdate, 2))", c="time(utc(2020, 0, 31, 1, 2, 3, 4))", d="time(toDate(utcFormat(datum.o_orderdate, '%Y-%m-%d')))")), "o_orderkey a b c d",
     f"SELECT o_orderkey, {_MS.format('make_timestamp(year(o_orderdate), 2, 15, 6, 30, 0)')} AS a, {_MS.format('(o_orderdate + INTERVAL 2 MONTH)::timestamp')} AS b, 1580432523004::double AS c, {_MS.format('date_trunc(''day'', o_orderdate)::timestamp'.replace(chr(39) * 2, chr(39)))} AS d FROM orders")
ORACLES["date_building"] = ORACLES["date_building"].replace("date_trunc(day, o_orderdate)", "date_trunc('day', o_orderdate)")
_add("string_functions", _one("customer", *_formulas(a="datum.c_mktsegment + '-' + datum.c_nationkey", b="length(datum.c_name)", c="datum.c_mktsegment[0]", d="indexof(datum.c_name, '#')", e="toString(datum.c_custkey)", f="format(datum.c_custkey / 2, '')")), "c_custkey a b c d e f",
     """SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS a, length(c_name)::double AS b, left(c_mktsegment, 1) AS c, (instr(c_name, '#') - 1)::double AS d, c_custkey::varchar AS e,
     CASE WHEN c_custkey % 2 = 0 THEN (c_custkey // 2)::varchar ELSE (c_custkey / 2.0)::double::varchar END AS f FROM customer""")  # fmt: skip
_add("logic_and_bits", _one("orders", *_formulas(a="datum.o_orderkey & 6 | 1", b="datum.o_orderkey ^ 5", c="datum.o_orderkey << 2", d="datum.o_orderkey > 100 ? datum.o_orderkey > 1000 ? 'big' : 'mid' : 'low'", e="!(datum.o_orderstatus === 'F') && datum.o_orderkey != '7'", f="if(datum.absent == null, 1, 2)", g="isValid(datum.absent) || 5 === '5'")), "o_orderkey a b c d e f g",
     "SELECT o_orderkey, ((o_orderkey & 6) | 1)::double AS a, xor(o_orderkey, 5)::double AS b, (o_orderkey << 2)::double AS c, CASE WHEN o_orderkey > 1000 THEN 'big' WHEN o_orderkey > 100 THEN 'mid' ELSE 'low' END AS d, (o_orderstatus <> 'F' AND o_orderkey <> 7) AS e, 1::double AS f, false AS g FROM orders")
_add("math_functions", _one("part", *_formulas(a="sqrt(datum.p_size) + exp(1) + log(datum.p_size)", b="floor(-datum.p_retailprice / 7)", c="round(datum.p_retailprice / 7)", d="abs(sin(datum.p_size)) + PI", e="isNaN(0 / 0)", f="isFinite(1 / 0)", g="pow(datum.p_size, 0.5)")), "p_partkey a b c d e f g",
     "SELECT p_partkey, round(sqrt(p_size) + exp(1) + ln(p_size), 4) AS a, floor(-p_retailprice / 7) AS b, floor(p_retailprice / 7 + 0.5) AS c, round(abs(sin(p_size)) + pi(), 4) AS d, true AS e, false AS f, round(power(p_size, 0.5), 4) AS g FROM part")
_add("array_functions", _one("orders", *_formulas(a="[datum.o_orderkey, 5, 7][2]", b="length([1, 2, datum.o_orderkey])", c="span([3, datum.o_orderkey])", d="indexof(['O', 'F'], datum.o_orderstatus)", e="{x: datum.o_orderkey, y: 2}.x")), "o_orderkey a b c d e",
     "SELECT o_orderkey, 7::double AS a, 3::double AS b, (o_orderkey - 3)::double AS c, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END::double AS d, o_orderkey AS e FROM orders")
_STORE = [{"unit": "", "fields": [{"field": "o_totalprice", "channel": "x", "type": "R"}, {"field": "o_orderstatus", "type": "E"}], "values": [[200000, 50000], ["F", "O"]]}, {"unit": "", "fields": [{"field": "o_orderkey", "type": "R-RE"}], "values": [[10, 20]]}]


def _selected(operation: str) -> dict:
    return {"data": [{"name": "brush_store", "values": _STORE}, {"name": "out", "url": "orders.parquet", "transform": [{"type": "filter", "expr": f"vlSelectionTest('brush_store', datum, '{operation}')"}]}]}


_add("selection_union", _selected("union"), "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 200000 AND o_orderstatus IN ('F', 'O') OR o_orderkey >= 10 AND o_orderkey < 20")
_add("selection_intersect", _selected("intersect"), "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 200000 AND o_orderstatus IN ('F', 'O') AND o_orderkey >= 10 AND o_orderkey < 20")
_add("selection_resolve", {"data": [{"name": "brush_store", "values": _STORE[:1]}, {"name": "out", "url": "orders.parquet", "transform": [{"type": "filter", "expr": "datum.o_totalprice >= vlSelectionResolve('brush_store').o_totalprice[0]"}]}]}, "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000")
_add("source_chain_signals", {"signals": [{"name": "least", "value": 10}, {"name": "twice", "update": "least * 2"}], "data": [{"name": "base", "url": "lineitem.parquet", "transform": [{"type": "filter", "expr": "datum.l_quantity > twice"}]}, {"name": "out", "source": "base", "transform": [{"type": "aggregate", "groupby": ["l_linestatus"], "ops": ["count"], "as": ["n"]}]}]},
     "l_linestatus n", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY 1")
_add("data_function", {"data": [{"name": "stats", "url": "orders.parquet", "transform": [{"type": "aggregate", "ops": ["min", "max"], "fields": ["o_orderkey", "o_orderkey"], "as": ["lo", "hi"]}]}, {"name": "out", "url": "orders.parquet", "transform": _formulas(rel="(datum.o_orderkey - data('stats')[0].lo) / (data('stats')[0].hi - data('stats')[0].lo)")}]},
     "o_orderkey rel", "SELECT o_orderkey, round((o_orderkey - (SELECT min(o_orderkey) FROM orders)) / ((SELECT max(o_orderkey) FROM orders) - (SELECT min(o_orderkey) FROM orders))::double, 4) AS rel FROM orders")

_add("math_trigonometry", _one("part", *_formulas(a="acos(datum.p_size / 100)", b="asin(datum.p_size / 100)", c="atan(datum.p_size)", d="ceil(datum.p_retailprice / 7)", e="cos(datum.p_size)", f="tan(datum.p_size / 100)")), "p_partkey a b c d e f",
     "SELECT p_partkey, round(acos(p_size / 100), 4) AS a, round(asin(p_size / 100), 4) AS b, round(atan(p_size), 4) AS c, ceil(p_retailprice / 7) AS d, round(cos(p_size), 4) AS e, round(tan(p_size / 100), 4) AS f FROM part")
_add("constants", _one("region", *_formulas(a="E + 10 * LN2 + 100 * LN10", b="LOG2E + 10 * LOG10E", c="SQRT1_2 + 10 * SQRT2", d="isNaN(NaN)", e="MAX_VALUE > 1e308 && MIN_VALUE < 1e-300")), "r_regionkey a b c d e",
     "SELECT r_regionkey, round(exp(1) + 10 * ln(2) + 100 * ln(10), 4) AS a, round(1 / ln(2) + 10 / ln(10), 4) AS b, round(sqrt(0.5) + 10 * sqrt(2), 4) AS c, true AS d, true AS e FROM region")
_add("conversions", _one("customer", *_formulas(a="toBoolean(datum.c_nationkey)", b="toNumber(toString(datum.c_acctbal))", c="isDate(datum.c_name)", d="datum.c_name.length", e="isDate(toDate('2020-03-01'))")), "c_custkey a b c d e",
     "SELECT c_custkey, c_nationkey <> 0 AS a, c_acctbal AS b, false AS c, length(c_name)::double AS d, true AS e FROM customer")
_add("utc_parts", _one("events", *_formulas(y="utcyear(datum.ts)", q="utcquarter(datum.ts)", mo="utcmonth(datum.ts)", d="utcdate(datum.ts)", wd="utcday(datum.ts)", h="utchours(datum.ts)", mi="utcminutes(datum.ts)", s="utcseconds(datum.ts)", ms="utcmilliseconds(datum.ts)", lh="hours(datum.ts)", ly="dayofyear(datum.ts)")), "event_id y q mo d wd h mi s ms lh ly",
     """SELECT event_id, year(ts)::double AS y, quarter(ts)::double AS q, (month(ts) - 1)::double AS mo, day(ts)::double AS d, dayofweek(ts)::double AS wd, hour(ts)::double AS h, minute(ts)::double AS mi, second(ts)::double AS s, (millisecond(ts) % 1000)::double AS ms,
     hour(ts - INTERVAL 5 HOUR)::double AS lh, dayofyear(ts - INTERVAL 5 HOUR)::double AS ly FROM events""", zone="America/New_York")  # fmt: skip
_add("aggregate_product", _one("lineitem", {"type": "aggregate", "groupby": ["l_orderkey"], "ops": ["product", "average"], "fields": ["l_linenumber", "l_linenumber"], "as": ["p", "m"]}), "l_orderkey p m",
     "SELECT l_orderkey, round(product(l_linenumber), 4) AS p, round(avg(l_linenumber), 4) AS m FROM lineitem GROUP BY 1")
_add("window_values", _one("orders", *_formulas(v="datum.o_orderkey % 3 == 0 ? null : datum.o_orderkey"), {"type": "window", "groupby": ["o_custkey"], "sort": {"field": "o_orderkey"}, "ops": ["ntile", "nth_value", "prev_value", "next_value"], "fields": [None, "o_orderkey", "v", "v"], "params": [3, 2, None, None], "as": ["a", "b", "c", "d"]}), "o_orderkey a b c d",
     """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS v FROM orders)
     SELECT o_orderkey, (ntile(3) OVER w)::int AS a, nth_value(o_orderkey, 2) OVER w AS b, (last_value(v IGNORE NULLS) OVER w)::double AS c, (first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS d FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")  # fmt: skip
_SPREAD = ["average", "variancep", "stdevp", "q1", "q3", "median", "valid", "missing", "product"]
_add("window_spread", _one("orders", *_formulas(n="datum.o_orderkey % 7 + 1", v="datum.o_orderkey * 37 % 1000"), {"type": "window", "groupby": ["o_orderpriority"], "sort": {"field": "o_orderkey"}, "ignorePeers": True, "frame": [-4, 0], "ops": _SPREAD, "fields": ["v"] * (len(_SPREAD) - 1) + ["n"], "as": _SPREAD}), "o_orderkey " + " ".join(_SPREAD),
     """SELECT o_orderkey, round(avg(v) OVER w, 4) AS average, round(var_pop(v) OVER w, 4) AS variancep, round(stddev_pop(v) OVER w, 4) AS stdevp, round(quantile_cont(v, 0.25) OVER w, 4) AS q1, round(quantile_cont(v, 0.75) OVER w, 4) AS q3,
     round(median(v) OVER w, 4) AS median, count(v) OVER w AS valid, 0::bigint AS missing, round(product(o_orderkey % 7 + 1) OVER w, 4) AS product FROM (SELECT *, o_orderkey * 37 % 1000 AS v FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")  # fmt: skip
_add("names_by_case", _one("orders", *_formulas(k="datum.o_orderstatus == 'F' ? 'a' : 'A'"), {"type": "pivot", "field": "k", "value": "o_totalprice", "groupby": ["o_orderpriority"], "op": "count"}, *_formulas(total="datum.a + datum.A")), "o_orderpriority total",
     "SELECT o_orderpriority, count(*)::double AS total FROM orders GROUP BY 1")
_add("signal_time_offset", {"signals": [{"name": "from", "update": "timeOffset('month', utc(1997, 0, 31), 1)"}], "data": [{"name": "out", "url": "orders.parquet", "transform": [{"type": "filter", "expr": "datum.o_orderdate >= from"}]}]}, "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-28'")
_add("signal_of_a_cut_dataset", {"data": [{"name": "a", "url": "orders.parquet", "transform": [{"type": "extent", "field": "o_orderkey", "signal": "ext"}, {"type": "sample", "size": 5}]}, {"name": "out", "url": "orders.parquet", "transform": _formulas(rest="ext[1] - datum.o_orderkey")}]}, "o_orderkey rest",
     "SELECT o_orderkey, ((SELECT max(o_orderkey) FROM orders) - o_orderkey)::double AS rest FROM orders")
_add("inline_dates", {"data": [{"name": "out", "values": [{"k": 1, "d": "2020-01-05", "u": "2020-01-05", "f": "05/2020/01", "y": "1999"}, {"k": 2, "d": None, "u": "no date", "f": "17/2021/12", "y": "2001"}], "format": {"type": "json", "parse": {"d": "date", "u": "utc", "f": "utc:'%d/%Y/%m'", "y": "date:'%Y'"}}, "transform": _formulas(a="time(datum.d)", b="time(datum.u)", c="time(datum.f)", e="year(datum.y)")}]}, "k a b c e",
     f"SELECT * FROM (VALUES (1::bigint, {_MS.format("TIMESTAMP '2020-01-05'")}, {_MS.format("TIMESTAMP '2020-01-05'")}, {_MS.format("TIMESTAMP '2020-01-05'")}, 1999::double), (2, NULL, NULL, {_MS.format("TIMESTAMP '2021-12-17'")}, 2001)) t(k, a, b, c, e)")
_add("inline_late_types", {"data": [{"name": "out", "values": [{"k": i, "v": i} for i in range(1500)] + [{"k": 1500, "v": 0.5}], "transform": _formulas(w="datum.v * 2")}]}, "k v w",
     "SELECT i AS k, i::double AS v, (i * 2)::double AS w FROM range(1500) t(i) UNION ALL SELECT 1500, 0.5, 1")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discrete scale's domain as the planner splits it off."""
    runtime = Runtime(spark, base=sf_dir)
    spec = {
        "data": [{"name": "t", "url": "orders.parquet"}],
        "scales": [{"name": "x", "type": "band", "domain": {"data": "t", "field": "o_orderpriority", "sort": {"op": "mean", "field": "o_totalprice"}}}],
        "marks": [{"type": "rect", "from": {"data": "t"}, "encode": {"update": {"x": {"scale": "x", "field": "o_orderpriority"}}}}],
    }
    plan = runtime.plan(spec, projections=False)
    (df,), _ = runtime.pre_transform_datasets(plan.server, ["t_x_domain_o_orderpriority"], in_order=False)
    return _rounded(df, ["o_orderpriority", "sort_field"], 4)


QUERIES["planner_scale_domain"] = _planned
ORACLES["planner_scale_domain"] = "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS sort_field FROM orders GROUP BY 1"
