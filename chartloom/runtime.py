"""The public interface: evaluate a chart specification's datasets, or all of it that can be."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import times
from chartloom.functions.compile import quoted
from chartloom.plans import spec as S
from chartloom.plans.graph import Graph
from chartloom.plans.rewrite import Usage, lift_facets, local_times, push_projections, split_domains, strip_encodings
from chartloom.plans.support import Analysis, dependencies, sources_of, transform_expressions
from chartloom.sources import readers, sinks


def _key(variable) -> tuple[str, S.Path]:
    """A variable: a name, or (name, scope)."""
    if isinstance(variable, str):
        return variable, ()
    name, path = variable
    return name, tuple(path)


def _warning(kind: str, message: str, datasets=()) -> dict:
    return {"type": kind, "message": message, "datasets": [list(map(_listed, d)) if isinstance(d, tuple) else d for d in datasets]}


def _listed(x):
    return list(x) if isinstance(x, tuple) else x


def limited(df: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows, and whether rows were cut: one row more is fetched to tell."""
    if limit is None:
        return df, False
    more = len(df.select(F.lit(1)).limit(limit + 1).take(limit + 1)) > limit
    return (df.limit(limit) if more else df), more


@dataclass
class Plan:
    """A specification cut in two: what is evaluated here, and what stays for the chart.

    ``served``: datasets sent, with the number of their transforms evaluated here.
    """

    client: dict
    server: dict
    served: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)
    local: dict = field(default_factory=dict)


@dataclass
class Runtime:
    """Evaluates specifications on a Spark session.

    ``base`` is where relative URLs lie; ``resolver`` maps the names of datasets that are
    not given to frames (or None); up to ``cached`` graphs of unchanged specifications
    keep their frames.
    """

    spark: SparkSession
    local_tz: str = "UTC"
    default_input_tz: str | None = None
    base: str | None = None
    resolver: object = None
    cached: int = 16

    def __post_init__(self) -> None:
        self._graphs: dict = {}

    # zones and caches

    def get_local_tz(self) -> str:
        return self.local_tz

    def set_local_tz(self, zone: str) -> None:
        self.local_tz = zone

    def clear_cache(self) -> None:
        self._graphs.clear()

    reset = clear_cache

    def graph(self, spec: dict, tables: dict | None = None, local_tz: str | None = None, default_input_tz: str | None = None, values: dict | None = None) -> Graph:
        """The graph of a specification; an equal one on the same inputs is used again."""
        key = repr((spec, sorted((k, id(v)) for k, v in (tables or {}).items()), local_tz or self.local_tz, default_input_tz or self.default_input_tz, values))
        if key not in self._graphs:
            while len(self._graphs) >= self.cached:
                self._graphs.pop(next(iter(self._graphs)))
            graph = Graph(self.spark, spec, tables, local_tz or self.local_tz, default_input_tz or self.default_input_tz, self.base, self.resolver, values)
            self._graphs[key] = (graph, tables)  # holds the inputs, so that their ids stay theirs
        return self._graphs[key][0]

    # pre-transformation

    def pre_transform_datasets(self, spec: dict, datasets: list, local_tz: str | None = None, default_input_tz: str | None = None, row_limit: int | None = None, inline_datasets: dict | None = None, dataset_format: str = "spark", in_order: bool = True) -> tuple[list, list[dict]]:
        """(the named datasets, warnings); frames are lazy unless a limit or a format asks for rows.

        Without ``in_order`` the last sort is left out.
        """
        keys = [_key(d) for d in datasets]
        known, analysis = S.datasets(spec), Analysis(spec, fixed=False)
        for key in keys:
            if key not in known:
                raise ValueError(f"no dataset {key[0]!r} in scope {list(key[1])}")
            if analysis.prefix(*key) != len(known[key].get("transform") or []):
                raise ValueError(f"dataset {key[0]!r} has parts that are not supported")
        graph = self.graph(copy.deepcopy(spec), inline_datasets, local_tz, default_input_tz)
        out, cut = [], []
        for key in keys:
            df, more = limited(graph.result(*key, in_order=in_order), row_limit)
            cut += [key] * more
            out.append(sinks.converted(df, dataset_format))
        return out, [_warning("RowLimitExceeded", f"cut to {row_limit} rows", cut)] if cut else []

    def pre_transform_values(self, spec: dict, variables: list, **options) -> tuple[list, list[dict]]:
        """As ``pre_transform_datasets``, with rows as JSON values."""
        return self.pre_transform_datasets(spec, variables, dataset_format="json", **options)

    def plan(self, spec: dict, preserve_interactivity: bool = True, keep_signals=(), keep_datasets=(), strip_description: bool = True, strip_tooltips: bool = False, projections: bool = True) -> Plan:
        """Rewrites a specification and decides what is evaluated here."""
        spec = copy.deepcopy(spec)
        keep = {_key(k) for k in keep_datasets}
        for key in keep:
            if key not in S.datasets(spec):
                raise ValueError(f"no dataset {key[0]!r} in scope {list(key[1])}")
        for key in map(_key, keep_signals):
            if key not in S.signals(spec) and key not in S.produced(spec):
                raise ValueError(f"no signal {key[0]!r} in scope {list(key[1])}")
        lift_facets(spec)
        split_domains(spec)
        if strip_description:
            strip_encodings(spec, strip_tooltips)
        if projections:
            push_projections(spec, keep)
        plan = Plan(copy.deepcopy(spec), spec)
        analysis = Analysis(spec, fixed=preserve_interactivity)
        data = S.datasets(spec)
        wanted = self._wanted(spec, analysis, keep)
        moving = [] if preserve_interactivity else self._moving(spec, analysis)
        if moving:
            plan.warnings.append(_warning("BrokenInteractivity", "datasets depend on signals that interaction changes", moving))
        left = []
        for key, d in data.items():
            prefix, transforms = analysis.prefix(*key), d.get("transform") or []
            if prefix is None or key not in wanted and prefix == len(transforms):
                if prefix is None and not d["name"].endswith("_store"):
                    left.append(key)
            else:
                plan.served[key] = prefix
                if prefix < len(transforms):
                    left.append(key)
        if left:
            plan.warnings.append(_warning("Unsupported", "datasets are left, wholly or in part, to the chart", left))
        plan.local = local_times(spec)
        return plan

    @staticmethod
    def _moving(spec: dict, analysis: Analysis) -> list:
        fixed = Analysis(spec, fixed=True)
        return [key for key in analysis.data if (analysis.prefix(*key) or 0) > (fixed.prefix(*key) or 0) and fixed.prefix(*key) != analysis.prefix(*key)]

    @staticmethod
    def _wanted(spec: dict, analysis: Analysis, keep: set) -> set:
        """Datasets that the chart still reads: in marks, scales, signals, or transforms and sources that stay with it."""
        wanted = set(keep)
        data = analysis.data
        add = lambda name, path: wanted.add(key) if isinstance(name, str) and (key := S.lookup(data, name, path)) else None
        for path, group in S.groups(spec):
            for mark in group.get("marks") or []:
                source = mark.get("from") or {}
                add(source.get("data"), path)
                add((source.get("facet") or {}).get("data"), path)
                if mark.get("type") != "group":
                    for name in dependencies(S.strings(mark))[1]:
                        add(name, path)
            rest = {k: v for k, v in group.items() if k not in ("data", "marks")}
            for scale in group.get("scales") or []:
                for part in (scale.get("domain"), scale.get("range")):
                    for ref in [part, *(part.get("fields") or [])] if isinstance(part, dict) else []:
                        if isinstance(ref, dict):
                            add(ref.get("data"), path)
            for name in dependencies(s for s in S.strings(rest) if "(" in s)[1]:
                add(name, path)
        for key, d in data.items():
            prefix, transforms = analysis.prefix(*key), d.get("transform") or []
            if prefix is None:
                for s in sources_of(d):
                    add(s, key[1] if s != d["name"] else key[1][:-1])
            for t in transforms[prefix or 0 :]:
                add(t.get("from"), key[1])
                for name in dependencies(transform_expressions(t))[1]:
                    add(name, key[1])
        return wanted

    def _served(self, plan: Plan, graph: Graph, row_limit: int | None) -> tuple[list, list]:
        """([(key, frame, transforms left)], keys cut): what is evaluated of the plan."""
        out, cut = [], []
        for key, prefix in plan.served.items():
            d = S.datasets(plan.server)[key]
            df, more = limited(graph.result(*key, prefix if prefix < len(d.get("transform") or []) else None), row_limit)
            cut += [key] * more
            out.append((key, self._zoneless(df, plan.local.get(key, set()), graph), (d.get("transform") or [])[prefix:]))
        return out, cut

    def _zoneless(self, df: DataFrame, fields: set, graph: Graph) -> DataFrame:
        """Fields that local time scales show, as wall-clock text without a zone."""
        new = {}
        for f in df.schema.fields:
            if f.name in fields and isinstance(f.dataType, T.TimestampType):
                new[f.name] = F.date_format(times.wall(quoted(f.name), graph.zone, graph.session), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        return df.withColumns(new) if new else df

    @staticmethod
    def _stub(plan: Plan, key, transforms: list, values, parse: dict | None = None) -> None:
        """The chart's copy of a dataset: evaluated rows and the transforms that are left."""
        group = S.group_at(plan.client, key[1])
        for i, d in enumerate(group["data"]):
            if d["name"] == key[0]:
                group["data"][i] = {"name": key[0], **values, **({"format": {"type": "json", "parse": parse}} if parse else {}), **({"transform": transforms} if transforms else {})}

    def _finish(self, plan: Plan, graph: Graph, done: set) -> None:
        """Removes datasets that are evaluated and no longer read, and fixes signals that transforms put out."""
        analysis = Analysis(plan.server, fixed=False)
        for key, d in S.datasets(plan.server).items():
            if key not in plan.served and analysis.prefix(*key) == len(d.get("transform") or []) and key not in done and Analysis(plan.server).prefix(*key) is not None:
                group = S.group_at(plan.client, key[1])
                group["data"] = [x for x in group["data"] if x["name"] != key[0]]
        kept = {t.get("signal") for d in S.datasets(plan.client).values() for t in d.get("transform") or []}
        for (name, path), owner in S.produced(plan.server).items():
            if name not in kept and owner in {*plan.served, *graph.data}:
                fixed = Analysis(plan.server).signal_ok(name, path)
                if fixed:
                    group = S.group_at(plan.client, path)
                    group["signals"] = [s for s in group.get("signals") or [] if s["name"] != name] + [{"name": name, "value": sinks.json_value(graph.signal(name, path))}]

    def pre_transform_spec(self, spec: dict, local_tz: str | None = None, default_input_tz: str | None = None, row_limit: int | None = None, preserve_interactivity: bool = True, inline_datasets: dict | None = None, keep_signals=(), keep_datasets=(), **options) -> tuple[dict, list[dict]]:
        """(specification with evaluated datasets inline, warnings)."""
        plan = self.plan(spec, preserve_interactivity, keep_signals, keep_datasets, **options)
        graph = self.graph(plan.server, inline_datasets, local_tz, default_input_tz)
        served, cut = self._served(plan, graph, row_limit)
        for key, df, rest in served:
            parse = {f: "date" for f in plan.local.get(key, ()) if f in df.columns}
            self._stub(plan, key, rest, {"values": sinks.rows(df)}, parse)
        self._finish(plan, graph, {k for k, _, _ in served})
        if cut:
            plan.warnings.append(_warning("RowLimitExceeded", f"cut to {row_limit} rows", cut))
        return plan.client, plan.warnings

    def pre_transform_extract(self, spec: dict, local_tz: str | None = None, default_input_tz: str | None = None, preserve_interactivity: bool = True, extract_threshold: int = 20, extracted_format: str = "pyarrow", inline_datasets: dict | None = None, keep_signals=(), keep_datasets=()) -> tuple[dict, list, list[dict]]:
        """(specification, [(name, scope, table)], warnings): datasets of ``extract_threshold`` rows or more stand outside."""
        plan = self.plan(spec, preserve_interactivity, keep_signals, keep_datasets)
        graph = self.graph(plan.server, inline_datasets, local_tz, default_input_tz)
        served, _ = self._served(plan, graph, None)
        out = []
        for key, df, rest in served:
            small, more = limited(df, max(extract_threshold - 1, 0))
            if more:
                out.append((key[0], list(key[1]), sinks.converted(df, extracted_format)))
                self._stub(plan, key, rest, {})
            else:
                self._stub(plan, key, rest, {"values": sinks.rows(small)})
        self._finish(plan, graph, {k for k, _, _ in served})
        return plan.client, out, plan.warnings

    def build_pre_transform_spec_plan(self, spec: dict, preserve_interactivity: bool = True, keep_signals=(), keep_datasets=()) -> dict:
        """The plan as plain values: client and server specifications, what goes which way, warnings."""
        plan = self.plan(spec, preserve_interactivity, keep_signals, keep_datasets)
        analysis = Analysis(plan.server, fixed=False)
        needs = [key for key in S.signals(plan.server) if analysis.moves(S.signals(plan.server)[key])]
        return {
            "client_spec": plan.client, "server_spec": plan.server, "warnings": plan.warnings,
            "comm_plan": {"server_to_client": [{"namespace": "data", "name": n, "scope": list(p)} for n, p in plan.served], "client_to_server": [{"namespace": "signal", "name": n, "scope": list(p)} for n, p in needs]},
        }

    def new_chart_state(self, spec: dict, local_tz: str | None = None, default_input_tz: str | None = None, row_limit: int | None = None, inline_datasets: dict | None = None):
        from chartloom.streaming.chart_state import ChartState

        return ChartState(self, spec, local_tz, default_input_tz, row_limit, inline_datasets)


def get_column_usage(spec: dict) -> dict[str, list[str] | None]:
    """For each dataset of the chart's root the columns that it uses; None where all may be."""
    usage = Usage(copy.deepcopy(spec))
    return {name: None if used is None else sorted(used) for (name, path), used in usage.used.items() if not path}


def get_inline_column_usage(spec: dict) -> dict[str, list[str] | None]:
    """As ``get_column_usage``, for the registered datasets that the chart reads by URL: columns of the input."""
    from chartloom.plans.rewrite import through

    usage, out = Usage(copy.deepcopy(spec)), {}
    for key, d in usage.data.items():
        if isinstance(d.get("url"), str) and (m := readers.INLINE.fullmatch(d["url"])):
            used = through(usage.used[key], d.get("transform") or [])
            known = out.get(m[1], [])
            out[m[1]] = None if used is None or known is None else sorted({*known, *used})
    return out


def trimmed(tables: dict, spec: dict) -> dict:
    """Registered frames with only the columns that the chart uses."""
    usage, out = get_inline_column_usage(spec), {}
    for name, df in tables.items():
        used = usage.get(name)
        out[name] = df.select(*[quoted(c) for c in df.columns if c in used]) if used and isinstance(df, DataFrame) else df
    return out
