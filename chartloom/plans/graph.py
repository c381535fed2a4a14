"""Evaluation of a specification's datasets and signals: lazy frames, each made once."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from chartloom.functions import times
from chartloom.functions.compile import Scope
from chartloom.functions.host import Host
from chartloom.operators.frame import plain
from chartloom.operators.transforms import run
from chartloom.plans import spec as S
from chartloom.sources import readers, sinks

#: Rows that ``data(...)`` in an expression may hold: they become a literal of the plan.
MOST_ROWS = 100_000


class _Signals(Mapping):
    """Signals as seen from a scope, evaluated when asked for."""

    def __init__(self, graph: Graph, path: S.Path):
        self.graph, self.path = graph, path

    def __contains__(self, name) -> bool:
        return self.graph.knows_signal(name, self.path)

    def __getitem__(self, name):
        if name not in self:
            raise KeyError(name)
        return self.graph.signal(name, self.path)

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0


class Graph:
    """The datasets and signals of one specification.

    ``values`` overrides signals and datasets by (name, path): what interaction has set.
    """

    def __init__(self, spark: SparkSession, spec: dict, tables: dict | None = None, zone: str = "UTC", input_zone: str | None = None, base: str | None = None, resolver=None, values: dict | None = None):
        self.spark, self.spec, self.zone, self.input_zone, self.base, self.resolver = spark, spec, zone, input_zone, base, resolver
        self.session = times.session_zone(spark)
        self.tables = {k: readers.from_any(spark, v) for k, v in (tables or {}).items()}
        self.data, self.signals, self.made = S.datasets(spec), S.signals(spec), S.produced(spec)
        self.values = values or {}
        self._frames: dict = {}
        self._found: dict = {}

    def scope(self, path: S.Path) -> Scope:
        return Scope(_Signals(self, path), lambda name: self.rows(name, path), self.zone, self.input_zone, self.session)

    def knows_signal(self, name: str, path: S.Path) -> bool:
        return S.lookup(self.signals, name, path) is not None or S.lookup(self.made, name, path) is not None or (name, ()) in self.values

    def signal(self, name: str, path: S.Path = ()):
        key = S.lookup(self.signals, name, path)
        made = S.lookup(self.made, name, path)
        if made is not None and (key is None or len(made[1]) >= len(key[1])):
            owner = self.made[made]
            transforms = self.data[owner].get("transform") or []
            upto = 1 + next(i for i, t in enumerate(transforms) if t.get("signal") == name)  # those after it may not be supported
            at = (*owner, None) if (*owner, None) in self._frames else (*owner, upto)
            self.frame(*at)
            return self._found[(*at, "signals")].get(name)
        key = key or (name, ())
        if key in self.values:
            return self.values[key]
        if key not in self._found:
            s = self.signals[key]
            text = s.get("init") if "init" in s else None if "value" in s else s.get("update")
            self._found[key] = Host(self.scope(key[1])).value(text) if text is not None else s.get("value")
        return self._found[key]

    def rows(self, name: str, path: S.Path = ()) -> list[dict]:
        """A dataset's rows on the driver, for expressions that read it whole."""
        key = S.lookup(self.data, name, path)
        if key is None:
            if (name, ()) in self.values:
                return self.values[name, ()]
            raise ValueError(f"no dataset {name!r}")
        if key in self.values:
            return self.values[key]
        d = self.data[key]
        if isinstance(d.get("values"), list) and not d.get("transform"):
            return d["values"]
        if not {"values", "url", "source"} & set(d) and not d.get("transform"):
            return []
        found = sinks.rows(plain(self.frame(*key)).limit(MOST_ROWS + 1))
        if len(found) > MOST_ROWS:
            raise ValueError(f"dataset {name!r} is too large for an expression ({MOST_ROWS} rows at most)")
        return found

    def frame(self, name: str, path: S.Path = (), upto: int | None = None) -> DataFrame:
        """A dataset after its transforms (the first ``upto`` of them), with its order if that is not the scan's."""
        key = S.lookup(self.data, name, path)
        if key is None:
            raise ValueError(f"no dataset {name!r} in scope {list(path)}")
        at = (*key, upto)
        if at not in self._frames:
            d = self.data[key]
            transforms = (d.get("transform") or [])[:upto]
            df, found = run(self.source(d, key), transforms, self.scope(key[1]))
            self._frames[at] = df
            self._found[(*at, "signals")] = found
        return self._frames[at]

    def source(self, d: dict, key) -> DataFrame:
        scope = self.scope(key[1])
        form = d.get("format") or {}
        parse = form.get("parse") if isinstance(form.get("parse"), dict) else {}
        if key in self.values:
            return readers.dated(readers.from_values(self.spark, self.values[key]), parse, scope)
        if d.get("source"):
            parents = d["source"] if isinstance(d["source"], list) else [d["source"]]
            if len(parents) > 1:
                raise ValueError("a dataset of several sources is not supported")
            above = key[1] if parents[0] != d["name"] else key[1][:-1]
            return self.frame(parents[0], above)
        if "url" in d:
            url = d["url"] if isinstance(d["url"], str) else Host(scope).value(d["url"]["signal"])
            if self.resolver is not None and (m := readers.INLINE.fullmatch(url)) and m[1] not in self.tables:
                if (df := self.resolver(m[1])) is not None:
                    return readers.dated(readers.from_any(self.spark, df), parse, scope)
            return readers.read_url(self.spark, url, form, scope, self.tables, self.base)
        values = d.get("values")
        if isinstance(values, str):
            values = json.loads(values)
        if isinstance(values, dict):
            values = [values]
        return readers.dated(readers.from_values(self.spark, values or []), parse, scope)

    def result(self, name: str, path: S.Path = (), upto: int | None = None, in_order: bool = True) -> DataFrame:
        """A dataset as it is handed out: in order unless that does not matter, without hidden columns."""
        return plain(self.frame(name, path, upto), in_order)
