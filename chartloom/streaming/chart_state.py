"""Interactive sessions: updates of signals and selections recompute only what depends on them."""

from __future__ import annotations

import copy
import threading

from chartloom.plans import spec as S
from chartloom.plans.support import Analysis, dependencies, sources_of, transform_expressions
from chartloom.sources import sinks


class ChartState:
    """A chart whose datasets follow its signals.

    The specification is evaluated once with its first values; ``update`` takes new values
    of signals and stores and returns the datasets that they change. Each update builds a
    new graph over the changed values; untouched frames are plans over the same inputs.
    """

    def __init__(self, runtime, spec: dict, local_tz=None, default_input_tz=None, row_limit=None, inline_datasets=None):
        self._runtime, self._zone, self._input_zone = runtime, local_tz, default_input_tz
        self._tables, self._limit, self._spec = inline_datasets, row_limit, copy.deepcopy(spec)
        self._values: dict = {}
        self._lock = threading.Lock()
        self._plan = runtime.plan(spec, preserve_interactivity=True, projections=False)
        self._server = self._plan.server
        self._analysis = Analysis(self._server, fixed=False, given={n for n, _ in S.datasets(self._server) if n.endswith("_store")})
        self._client, self._warnings = runtime.pre_transform_spec(spec, local_tz, default_input_tz, row_limit, preserve_interactivity=False, inline_datasets=inline_datasets)

    def get_server_spec(self) -> dict:
        return copy.deepcopy(self._server)

    def get_client_spec(self) -> dict:
        return copy.deepcopy(self._client)

    get_transformed_spec = get_client_spec

    def get_warnings(self) -> list[dict]:
        return list(self._warnings)

    def get_comm_plan(self) -> dict:
        """Variables that the chart reports, and datasets that follow them."""
        watched = [k for k, s in S.signals(self._server).items() if self._analysis.moves(s)]
        stores = [k for k in S.datasets(self._server) if k[0].endswith("_store")]
        follow = self._following({("signal", *k) for k in watched} | {("data", *k) for k in stores})
        out = lambda kind, keys: [{"namespace": kind, "name": n, "scope": list(p)} for n, p in sorted(keys)]
        return {"client_to_server": [*out("signal", watched), *out("data", stores)], "server_to_client": out("data", follow)}

    def _following(self, changed: set) -> list:
        """Evaluated datasets that depend on changed variables, through signals, sources and expressions."""
        data, signals, made = S.datasets(self._server), S.signals(self._server), S.produced(self._server)
        grew = True
        while grew:
            grew = False
            for key, s in signals.items():
                texts = [s[k] for k in ("init", "update") if isinstance(s.get(k), str)]
                if ("signal", *key) not in changed and self._touched(texts, key[1], changed, data, signals, made):
                    changed.add(("signal", *key))
                    grew = True
            for key, d in data.items():
                if ("data", *key) in changed:
                    continue
                texts = [x for t in d.get("transform") or [] for x in transform_expressions(t)]
                if isinstance(d.get("url"), dict):
                    texts.append(d["url"]["signal"])
                parents = [S.lookup(data, s, key[1] if s != d["name"] else key[1][:-1]) for s in sources_of(d)]
                if any(p and ("data", *p) in changed for p in parents) or self._touched(texts, key[1], changed, data, signals, made):
                    changed.add(("data", *key))
                    changed |= {("signal", *m) for m, owner in made.items() if owner == key}
                    grew = True
        return [k for k in data if ("data", *k) in changed and not k[0].endswith("_store") and self._analysis.prefix(*k) is not None]

    @staticmethod
    def _touched(texts, path, changed, data, signals, made) -> bool:
        names, tables = dependencies(texts)
        found = [("signal", *k) for n in names for k in (S.lookup(signals, n, path), S.lookup(made, n, path)) if k]
        found += [("data", *k) for n in tables if (k := S.lookup(data, n, path))]
        return any(f in changed for f in found)

    def update(self, updates: list[dict]) -> list[dict]:
        """New values ``{namespace, name, scope, value}`` in; the datasets that they change out, by name."""
        with self._lock:
            changed = set()
            for u in updates:
                key = (u["name"], tuple(u.get("scope") or ()))
                self._values[key] = u["value"]
                changed.add((u.get("namespace", "signal"), *key))
            graph = self._runtime.graph(self._server, self._tables, self._zone, self._input_zone, dict(self._values))
            wanted = self._runtime._wanted(self._server, self._analysis, set())
            out = []
            for key in sorted(self._following(changed)):
                if key in wanted:
                    df = graph.result(*key, self._analysis.prefix(*key))
                    df = df if self._limit is None else df.limit(self._limit)
                    out.append({"namespace": "data", "name": key[0], "scope": list(key[1]), "value": sinks.rows(df)})
            return out
