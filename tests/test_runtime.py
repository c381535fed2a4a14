"""The public interface: pre-transformation, extraction, plans, sessions, readers."""

import json

import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest

from chartloom import Runtime, get_column_usage, get_inline_column_usage

VALUES = [{"a": i, "b": i % 3, "c": f"t{i}"} for i in range(30)]
SPEC = {
    "signals": [{"name": "least", "value": 10, "on": [{"events": "click", "update": "20"}]}],
    "data": [
        {"name": "src", "url": "table://src"},
        {"name": "counts", "source": "src", "transform": [{"type": "aggregate", "groupby": ["b"], "ops": ["count"], "as": ["n"]}]},
        {"name": "chosen", "source": "src", "transform": [{"type": "formula", "expr": "datum.a * 2", "as": "d"}, {"type": "filter", "expr": "datum.a >= least"}]},
        {"name": "odd", "source": "src", "transform": [{"type": "filter", "expr": "datum.a < 3"}, {"type": "sample", "size": 2}]},
    ],
    "scales": [{"name": "x", "type": "band", "domain": {"data": "src", "field": "c"}}],
    "marks": [{"type": "rect", "from": {"data": n}, "encode": {"update": {"x": {"field": f}}}} for n, f in (("counts", "n"), ("chosen", "d"), ("odd", "a"))],
}


@pytest.fixture
def tables(spark):
    return {"src": spark.createDataFrame(VALUES)}


def by_name(spec):
    return {d["name"]: d for d in spec["data"]}


def test_datasets_limits_and_errors(runtime, tables):
    (df,), warnings = runtime.pre_transform_datasets(SPEC, ["counts"], inline_datasets=tables)
    assert [tuple(r) for r in df.collect()] == [(0, 10), (1, 10), (2, 10)] and not warnings
    (rows,), warnings = runtime.pre_transform_values(SPEC, ["counts"], inline_datasets=tables, row_limit=2)
    assert rows == [{"b": 0, "n": 10}, {"b": 1, "n": 10}] and warnings[0]["type"] == "RowLimitExceeded"
    assert not runtime.pre_transform_values(SPEC, ["counts"], inline_datasets=tables, row_limit=3)[1]
    for name in ("nope", "odd"):
        with pytest.raises(ValueError):
            runtime.pre_transform_datasets(SPEC, [name], inline_datasets=tables)


def test_spec_keeps_interaction(runtime, tables):
    spec, warnings = runtime.pre_transform_spec(SPEC, inline_datasets=tables)
    data = by_name(spec)
    assert data["counts"]["values"] == [{"n": 10}] * 3
    assert [t["type"] for t in data["chosen"]["transform"]] == ["filter"] and len(data["chosen"]["values"]) == 30 and data["chosen"]["values"][1]["d"] == 2
    assert [t["type"] for t in data["odd"]["transform"]] == ["sample"] and [v["a"] for v in data["odd"]["values"]] == [0, 1, 2]
    assert "src" not in data and len(data["src_x_domain_c"]["values"]) == 30
    assert {w["type"] for w in warnings} == {"Unsupported"}
    json.dumps(spec)


def test_spec_with_interaction_given_up(runtime, tables):
    spec, warnings = runtime.pre_transform_spec(SPEC, inline_datasets=tables, preserve_interactivity=False)
    assert len(by_name(spec)["chosen"]["values"]) == 20 and "transform" not in by_name(spec)["chosen"]
    assert "BrokenInteractivity" in {w["type"] for w in warnings}


def test_extract(runtime, tables):
    spec, out, _ = runtime.pre_transform_extract(SPEC, inline_datasets=tables)
    assert {n for n, _, _ in out} == {"chosen", "src_x_domain_c"} and "values" not in by_name(spec)["chosen"] and len(by_name(spec)["counts"]["values"]) == 3
    assert all(isinstance(t, pa.Table) and t.num_rows == 30 for _, _, t in out)


def test_plan_and_usage(runtime):
    plan = runtime.build_pre_transform_spec_plan(SPEC)
    assert {"namespace": "data", "name": "counts", "scope": []} in plan["comm_plan"]["server_to_client"]
    assert get_column_usage(SPEC)["src"] is None  # of a transform that is not known all columns may be used
    known = SPEC | {"data": SPEC["data"][:3], "marks": SPEC["marks"][:2]}
    assert get_column_usage(known) == {"src": ["a", "b", "c"], "counts": ["n"], "chosen": ["d"]}
    assert get_inline_column_usage(known) == {"src": ["a", "b", "c"]}
    with pytest.raises(ValueError):
        runtime.plan(SPEC, keep_signals=["nope"])


def test_chart_state(runtime, tables):
    state = runtime.new_chart_state(SPEC, inline_datasets=tables)
    assert len(by_name(state.get_client_spec())["chosen"]["values"]) == 20
    out = state.update([{"namespace": "signal", "name": "least", "scope": [], "value": 28}])
    assert [o["name"] for o in out] == ["chosen"] and [r["a"] for r in out[0]["value"]] == [28, 29]
    assert state.get_comm_plan()["server_to_client"] == [{"namespace": "data", "name": "chosen", "scope": []}]


def test_facets_are_lifted(runtime, tables):
    spec = {
        "data": [{"name": "src", "url": "table://src"}],
        "marks": [{"type": "group", "from": {"facet": {"name": "part", "data": "src", "groupby": ["b"]}},
                   "data": [{"name": "sums", "source": "part", "transform": [{"type": "aggregate", "groupby": ["c"], "ops": ["sum"], "fields": ["a"], "as": ["s"]}]}],
                   "marks": [{"type": "rect", "from": {"data": "sums"}, "encode": {"update": {"x": {"field": "s"}}}}]}],
    }
    out, _ = runtime.pre_transform_spec(spec, inline_datasets=tables)
    lifted = by_name(out)["src_facet_sums_0"]
    assert set(lifted["values"][0]) == {"b", "c", "s"} and out["marks"][0]["from"]["facet"]["data"] == "src_facet_sums_0"


def test_scoped_signals_and_outputs(runtime):
    spec = {
        "signals": [{"name": "k", "value": 2}],
        "data": [{"name": "d", "values": [{"x": 1}, {"x": 5}], "transform": [{"type": "extent", "field": "x", "signal": "ext"}]}],
        "marks": [{"type": "group", "signals": [{"name": "k", "update": "ext[1] * 10"}], "data": [{"name": "e", "source": "d", "transform": [{"type": "formula", "expr": "datum.x + k", "as": "y"}]}]}],
    }
    (rows,), _ = runtime.pre_transform_values(spec, [("e", [0])])
    assert [r["y"] for r in rows] == [51, 55]


def test_readers(spark, tmp_path):
    pd.DataFrame({"year": ["2001", "2002"], "v": [1, 2], "w": ["true", "x"]}).to_csv(tmp_path / "t.csv", index=False)
    pd.DataFrame({"a": [1, 2]}).to_csv(tmp_path / "t.tsv", index=False, sep="\t")
    (tmp_path / "t.json").write_text(json.dumps([{"z": 1, "b": None}, {"z": 2.5, "b": "q"}]))
    pyarrow.feather.write_feather(pa.table({"a": [1, 2], "s": ["x", None]}), tmp_path / "t.arrow", compression="uncompressed")
    runtime = Runtime(spark, base=str(tmp_path))

    def read(url, form=None, *transforms):
        (df,), _ = runtime.pre_transform_datasets({"data": [{"name": "d", "url": url, "format": form or {}, "transform": list(transforms)}]}, ["d"])
        return df

    assert read("t.csv").dtypes == [("year", "string"), ("v", "string"), ("w", "string")]
    typed = read("t.csv", {"parse": {"year": "date:'%Y'", "v": "number", "w": "boolean"}})
    assert [(str(r.year), r.v, r.w) for r in typed.collect()] == [("2001-01-01 00:00:00", 1.0, True), ("2002-01-01 00:00:00", 2.0, None)]
    assert [r.a for r in read("t.tsv").collect()] == ["1", "2"]
    assert read("t.json").columns == ["z", "b"] and [tuple(r) for r in read("t.json#x").collect()] == [(1.0, None), (2.5, "q")]
    assert [tuple(r) for r in read("t.arrow").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        read("t.unknown")


def test_inputs_and_resolver(spark):
    runtime = Runtime(spark, resolver=lambda name: [{"x": 1}] if name == "lazy" else None)
    spec = lambda name: {"data": [{"name": "d", "url": f"table://{name}"}]}
    assert runtime.pre_transform_values(spec("lazy"), ["d"])[0] == [[{"x": 1}]]
    for data in (pd.DataFrame({"x": [1]}), pa.table({"x": [1]}), {"x": [1]}, [{"x": 1}], spark.range(1, 2).toDF("x")):
        assert runtime.pre_transform_values(spec("t"), ["d"], inline_datasets={"t": data})[0] == [[{"x": 1}]]
    with pytest.raises(ValueError):
        runtime.pre_transform_values(spec("gone"), ["d"])


def test_formats_of_results(runtime, tables):
    for kind in ("pandas", "pyarrow", "arrow-ipc", "arrow-ipc-base64", "spark"):
        assert runtime.pre_transform_datasets(SPEC, ["counts"], inline_datasets=tables, dataset_format=kind)[0][0] is not None


def test_local_times_are_sent_without_zone(spark):
    runtime = Runtime(spark, local_tz="America/New_York", default_input_tz="UTC")
    spec = {
        "data": [{"name": "d", "values": [{"t": "2023-06-20 02:00:00"}], "format": {"parse": {"t": "date"}}}], "scales": [{"name": "x", "type": "time", "domain": {"data": "d", "field": "t"}}],
        "marks": [{"type": "rect", "from": {"data": "d"}, "encode": {"update": {"x": {"scale": "x", "field": "t"}}}}],
    }
    out, _ = runtime.pre_transform_spec(spec)
    assert out["data"][0]["values"] == [{"t": "2023-06-19T22:00:00.000"}] and out["data"][0]["format"]["parse"] == {"t": "date"}


def test_filters_and_columns_reach_the_scan(spark):
    runtime = Runtime(spark, base="/root/testdata/sf0.001")
    spec = {"data": [{"name": "d", "url": "lineitem.parquet", "transform": [{"type": "filter", "expr": "datum.l_quantity < 5 && datum.l_returnflag == 'R'"}, {"type": "aggregate", "groupby": ["l_linestatus"], "ops": ["sum"], "fields": ["l_tax"]}]}]}
    (df,), _ = runtime.pre_transform_datasets(spec, ["d"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,5.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string,l_linestatus:string>" in plan


def test_selection_of_local_times(spark):
    runtime = Runtime(spark, local_tz="America/New_York", default_input_tz="UTC")
    store = [{"unit": "", "fields": [{"field": "t", "type": "R"}], "values": [["2023-06-20 00:00:00", "2023-06-20 12:00:00"]]}]
    spec = {"data": [{"name": "s", "values": store}, {"name": "d", "values": [{"t": f"2023-06-20 {h:02d}:00:00"} for h in (3, 4, 16, 17)], "format": {"parse": {"t": "date"}}, "transform": [{"type": "filter", "expr": "vlSelectionTest('s', datum)"}]}]}
    (df,), _ = runtime.pre_transform_datasets(spec, ["d"])
    assert [r.t.hour for r in df.collect()] == [4, 16]


def test_signal_of_a_dataset_that_is_cut(runtime):
    """The signal's transform can be evaluated, a later one cannot."""
    spec = {
        "data": [
            {"name": "a", "values": [{"v": 3}, {"v": 8}], "transform": [{"type": "extent", "field": "v", "signal": "ext"}, {"type": "sample", "size": 1}]},
            {"name": "b", "values": [{"u": 1}], "transform": [{"type": "formula", "expr": "ext[1] - ext[0]", "as": "w"}]},
        ],
        "marks": [{"type": "rect", "from": {"data": "b"}, "encode": {"update": {"x": {"field": "w"}}}}],
    }
    (rows,), _ = runtime.pre_transform_values(spec, ["b"])
    assert rows == [{"u": 1, "w": 5}]
    out, _ = runtime.pre_transform_spec(spec)[:2]
    assert by_name(out)["b"]["values"] == [{"u": 1, "w": 5}] or by_name(out)["b"]["values"] == [{"w": 5}]


def test_times_on_the_driver_are_those_of_columns(spark):
    """Signals and columns give one text for each directive and one instant for each offset."""
    runtime = Runtime(spark, local_tz="America/New_York")
    formats = ["%e %q %Q", "%-d/%m/%y %_H:%M:%S.%L", "%U %W %V %w %u %G %g %j", "%Z %s %f", "%a %A %b %B %p %I", "%c|%x|%X|%%"]
    instants = ["2021-01-03T04:05:06.789Z", "2020-02-29T23:59:59Z", "2023-12-31T12:00:00Z", "2021-11-07T05:30:00Z"]
    offsets = [(u, n) for u in ("year", "quarter", "month", "week", "day", "hours", "minutes", "milliseconds") for n in (1, -3)]
    texts = [f"timeFormat(toDate(T), '{f}')" for f in formats] + [f"time(timeOffset('{u}', toDate(T), {n}))" for u, n in offsets]
    signals = [{"name": f"s{i}x{j}", "update": e.replace("toDate(T)", f"toDate('{t}')")} for i, t in enumerate(instants) for j, e in enumerate(texts)]
    formulas = [{"type": "formula", "expr": e.replace("toDate(T)", "toDate(datum.t)"), "as": f"c{j}"} for j, e in enumerate(texts)]
    made = [{"type": "formula", "expr": f"s{i}x{j}", "as": f"s{i}x{j}"} for i in range(len(instants)) for j in range(len(texts))]
    spec = {"signals": signals, "data": [{"name": "d", "values": [{"t": t} for t in instants], "transform": [*formulas, *made]}]}
    (rows,), _ = runtime.pre_transform_values(spec, ["d"])
    for i, r in enumerate(rows):
        for j, e in enumerate(texts):
            assert r[f"c{j}"] == r[f"s{i}x{j}"], (instants[i], e)
