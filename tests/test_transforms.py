"""Transforms on small inline data with results worked out by hand."""

import math

import pytest

# The rows of MEDALS, WIDE and ABCD are those of FIXTURES.md, so that results can be held against published ones.
MEDALS = [
    {"country": c, "type": t, "count": n, "is_gold": None if t is None else t == "gold"}
    for c, t, n in [
        ("Germany", "gold", 14), ("Norway", "gold", 14), ("Norway", "silver", 14), ("Canada", "copper", 10), ("Norway", "bronze", 11), ("Germany", "silver", 10),
        ("Germany", "bronze", 7), ("Canada", "gold", 11), ("Canada", "silver", 8), ("Canada", "bronze", 10), ("Canada", None, 5),
    ]
]
WIDE = [{"country": "USA", "gold": 10, "silver": 20}, {"country": "Canada", "gold": 7, "silver": 26}]
ABCD = [dict(zip("abcd", r, strict=True)) for r in [(0, 28, 0, -1), (0, 91, 1, -1), (1, 43, 0, -2), (1, 55, 1, -2), (3, 19, 0, -3), (2, 81, 0, -3), (2, 53, 1, -4)]]


@pytest.fixture
def run(runtime):
    def go(values, *transforms, **spec):
        (df,), _ = runtime.pre_transform_datasets({"data": [{"name": "d", "values": values, "transform": list(transforms)}], **spec}, ["d"])
        return df

    return go


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("fields", [["gold"], ["silver", "gold"], ["silver", "gold", "bogus"], ["gold", "bogus", "silver"]])
def test_fold(run, fields):
    df = run(WIDE, {"type": "fold", "fields": fields})
    assert rows(df) == [(r["country"], r["gold"], r["silver"], f, r.get(f)) for r in WIDE for f in fields]


def test_fold_over_its_own_names(run):
    df = run([{"key": 1, "value": 2}], {"type": "fold", "fields": ["value"]})
    assert df.columns == ["key", "value"] and rows(df) == [("value", 2)]


def test_pivot_with_groups_and_nulls(run):
    df = run(MEDALS, {"type": "pivot", "field": "type", "value": "count", "groupby": ["country"]})
    assert df.columns == ["country", "null", "bronze", "copper", "gold", "silver"]
    assert rows(df) == [("Germany", 0, 7, 0, 14, 10), ("Norway", 0, 11, 0, 14, 14), ("Canada", 5, 10, 10, 11, 8)]


def test_pivot_limit_without_groups(run):
    assert rows(run(MEDALS, {"type": "pivot", "field": "type", "value": "count", "limit": 2, "op": "max"})) == [(5, 11)]
    assert run(MEDALS, {"type": "pivot", "field": "is_gold", "value": "count"}).columns == ["null", "false", "true"]


def test_pivot_blank_and_empty(run):
    assert run([{"c": "", "v": 1}, {"c": "x", "v": 2}], {"type": "pivot", "field": "c", "value": "v"}).columns == [" ", "x"]
    with pytest.raises(ValueError):
        run([{"c": "", "v": 1}], {"type": "filter", "expr": "false"}, {"type": "pivot", "field": "c", "value": "v"})


def test_impute(run):
    assert rows(run([{"b": None}, {"b": 2}], {"type": "impute", "field": "b", "key": "a", "value": 9})) == [(9,), (2,)]
    df = run(ABCD, {"type": "impute", "field": "b", "key": "a", "groupby": ["c"], "value": -1})
    assert rows(df) == [tuple(r.values()) for r in ABCD] + [(3, -1, 1, None)]


def test_impute_with_two_groups(run):
    df = run(ABCD, {"type": "impute", "field": "b", "key": "a", "groupby": ["c", "d"], "value": 0})
    got = rows(df)
    assert len(got) == 4 * len({(r["c"], r["d"]) for r in ABCD}) and got[:7] == [tuple(r.values()) for r in ABCD]


def test_stack(run):
    data = [{"g": "a", "v": 3}, {"g": "a", "v": -2}, {"g": "a", "v": None}, {"g": "b", "v": 4}, {"g": None, "v": 1}, {"g": None, "v": 2}]
    assert [r[2:] for r in rows(run(data, {"type": "stack", "field": "v", "groupby": ["g"]}))] == [(0, 3), (0, -2), (3, 3), (0, 4), (0, 1), (1, 3)]
    norm = [r[2:] for r in rows(run(data, {"type": "stack", "field": "v", "groupby": ["g"], "offset": "normalize"}))]
    assert norm[:2] == [(0, 0.6), (0.6, 1.0)] and norm[3] == (0, 1)
    centre = [r[2:] for r in rows(run(data, {"type": "stack", "field": "v", "groupby": ["g"], "offset": "center"}))]
    assert centre[3] == (0.5, 4.5)
    assert rows(run([{"v": 0}], {"type": "stack", "field": "v", "offset": "normalize"})) == [(0, 0, 0)]


def test_window_frames_and_peers(run):
    data = [{"k": k, "v": v} for k, v in [(1, 1), (1, 2), (2, 4), (3, 8)]]
    t = {"type": "window", "sort": {"field": "k"}, "ops": ["sum"], "fields": ["v"], "as": ["s"]}
    assert [r[2] for r in rows(run(data, t))] == [3, 3, 7, 15]
    assert [r[2] for r in rows(run(data, t | {"ignorePeers": True}))] == [1, 3, 7, 15]
    assert [r[2] for r in rows(run(data, t | {"frame": [-1, 0]}))] == [3, 3, 7, 12]
    assert [r[2] for r in rows(run(data, t | {"frame": [None, None]}))] == [15] * 4
    ranks = {"type": "window", "sort": {"field": "k"}, "ops": ["rank", "dense_rank", "row_number"]}
    assert [r[2:] for r in rows(run(data, ranks))] == [(1, 1, 1), (1, 1, 2), (3, 2, 3), (4, 3, 4)]


def test_aggregate_order_missing_columns_and_nulls(run):
    df = run(MEDALS, {"type": "aggregate", "groupby": ["country"], "ops": ["count", "sum", "distinct", "sum", "max"], "fields": [None, "count", "type", "absent", "absent"]})
    assert df.columns == ["country", "count", "sum_count", "distinct_type", "sum_absent", "max_absent"]
    assert rows(df) == [("Germany", 3, 31, 3, 0, None), ("Norway", 3, 39, 3, 0, None), ("Canada", 5, 44, 5, 0, None)]
    assert rows(run(MEDALS, {"type": "aggregate"})) == [(11,)]
    with pytest.raises(ValueError):
        run(MEDALS, {"type": "aggregate", "cross": True})


def test_joinaggregate_keeps_null_groups(run):
    assert [r[-1] for r in rows(run(MEDALS, {"type": "joinaggregate", "groupby": ["type"], "ops": ["count"], "as": ["n"]}))][-1] == 1


def test_collect_puts_nulls_first(run):
    df = run(MEDALS, {"type": "collect", "sort": {"field": ["type", "count"], "order": ["ascending", "descending"]}}, {"type": "identifier", "as": "i"})
    assert [(r[1], r[4]) for r in rows(df)][:3] == [(None, 1), ("bronze", 2), ("bronze", 3)]


def test_bin_edges(run):
    t = {"type": "bin", "field": "v", "extent": [0, 10], "step": 5, "signal": "b"}
    got = rows(run([{"v": x} for x in (-1, 0, 4.9, 5, 10, 11, None)], t, {"type": "formula", "expr": "b.step", "as": "s"}))
    assert [r[1] for r in got] == [-math.inf, 0, 0, 5, 5, math.inf, None] and got[1][2:] == (5, 5)


def test_bin_solver():
    from chartloom.operators.binning import Bins, solve

    assert solve(0, 10) == Bins(0, 10, 0.5)
    assert solve(0, 10, maxbins=5) == Bins(0, 10, 2)
    assert solve(1, 1, maxbins=10).step > 0
    assert solve(0, 100, maxbins=10, steps=[5, 20, 50]).step == 20 and solve(0, 1000, maxbins=10, steps=[5, 20, 50]).step == 50
    assert solve(0.3, 9.7, step=2, nice=False) == Bins(0.3, 9.7, 2)
    assert solve(3, 17, maxbins=10) == Bins(2, 18, 2) and solve(0.12, 0.57, maxbins=10).step == 0.05
    assert solve(0, 10, step=5).through(7) == Bins(2, 12, 5) and len(solve(0, 10, step=5)) == 2
    with pytest.raises(ValueError):
        solve(2, 1)


def test_sequence(run):
    assert rows(run([], {"type": "sequence", "start": 100, "stop": 10, "step": {"signal": "-4*5"}})) == [(100,), (80,), (60,), (40,), (20,)]
    assert rows(run([], {"type": "sequence", "start": 1, "stop": 3, "step": -1})) == []


def test_escaped_and_odd_names(run):
    data = [{"a.b": 1, "Beak Length (mm)": 2, "A": 3, "a": 4}]
    df = run(data, {"type": "formula", "expr": "datum['a.b'] + datum['Beak Length (mm)']", "as": "s"}, {"type": "project", "fields": ["a\\.b", "s"]})
    assert df.columns == ["a.b", "s"] and rows(df) == [(1, 3)]


def test_empty_input(run):
    for t in ({"type": "aggregate", "groupby": ["x"]}, {"type": "identifier", "as": "i"}, {"type": "stack", "field": "x"}, {"type": "filter", "expr": "datum.x > 1"}):
        assert rows(run([{"x": 1}], {"type": "filter", "expr": "false"}, t)) == []


@pytest.mark.parametrize(
    ("zone", "units", "text", "start"),
    [
        ("UTC", ["year", "month"], "2023-06-20 10:30:00", "2023-06-01 00:00:00"), ("UTC", ["day"], "2023-06-20 10:30:00", "2012-01-03 00:00:00"),
        ("America/New_York", ["year", "month", "date"], "2023-06-20T02:00:00Z", "2023-06-19 04:00:00"), ("UTC", ["hours", "minutes"], "2023-06-20 10:30:59", "2012-01-01 10:30:00"),
        ("UTC", ["quarter"], "2023-06-20 10:30:59", "2012-04-01 00:00:00"), ("UTC", ["year", "month", "date", "hours", "minutes", "seconds"], "2023-06-20 10:30:59.750", "2023-06-20 10:30:59"),
        ("UTC", ["milliseconds"], "2023-06-20 10:30:59.750", "2012-01-01 00:00:00.750000"), ("UTC", ["year", "week"], "2023-06-20 10:30:59", "2023-06-18 00:00:00"),
    ],
)
def test_timeunit(runtime, zone, units, text, start):
    spec = {"data": [{"name": "d", "values": [{"t": text}], "transform": [{"type": "formula", "expr": "toDate(datum.t)", "as": "t"}, {"type": "timeunit", "field": "t", "units": units}]}]}
    (df,), _ = runtime.pre_transform_datasets(spec, ["d"], local_tz=zone, default_input_tz="UTC")
    assert str(df.first()["unit0"]) == start


def test_names_that_differ_in_case(run):
    values = [{"k": 1, "f": "a", "v": 1}, {"k": 1, "f": "A", "v": 2}, {"k": 2, "f": "A", "v": 4}]
    got = run(values, {"type": "pivot", "field": "f", "value": "v", "groupby": ["k"]})
    assert got.columns == ["k", "A", "a"] and rows(got) == [(1, 2, 1), (2, 4, 0)]
    got = run([{"x": 1}], {"type": "formula", "expr": "datum.x + 1", "as": "X"}, {"type": "formula", "expr": "datum.X * 10", "as": "y"})
    assert got.columns == ["x", "X", "y"] and rows(got) == [(1, 2, 20)]


def test_median_in_sorted_windows(run):
    values = [{"i": i, "v": v} for i, v in enumerate([5, 1, 3, 9])]
    got = rows(run(values, {"type": "window", "sort": {"field": "i"}, "ops": ["median", "q1"], "fields": ["v", "v"], "as": ["m", "q"]}))
    assert [r[2] for r in got] == [5, 3, 3, 4]


def test_types_of_late_inline_values(run):
    values = [{"v": i} for i in range(1100)] + [{"v": 0.5}, {"v": None, "w": "late"}]
    got = run(values, {"type": "aggregate", "ops": ["sum", "valid"], "fields": ["v", "w"], "as": ["s", "n"]})
    assert rows(got) == [(sum(range(1100)) + 0.5, 1)]
