"""Chart specifications as nested scopes of datasets, signals, scales and marks."""

from __future__ import annotations

from collections.abc import Iterator

Path = tuple[int, ...]


def groups(spec: dict, path: Path = ()) -> Iterator[tuple[Path, dict]]:
    """(path, group) of the chart and its group marks, outer ones first; a path counts group marks."""
    yield path, spec
    for i, mark in enumerate(m for m in spec.get("marks") or [] if m.get("type") == "group"):
        yield from groups(mark, (*path, i))


def group_at(spec: dict, path: Path) -> dict:
    for i in path:
        spec = [m for m in spec.get("marks") or [] if m.get("type") == "group"][i]
    return spec


def datasets(spec: dict) -> dict[tuple[str, Path], dict]:
    """All datasets by name and scope; those that facets make are not among them."""
    return {(d["name"], path): d for path, group in groups(spec) for d in group.get("data") or []}


def facets(spec: dict) -> dict[tuple[str, Path], dict]:
    """Datasets that facets make, by name and the scope of the group they are for."""
    return {(f["name"], path): f for path, group in groups(spec) if (f := (group.get("from") or {}).get("facet"))}


def signals(spec: dict) -> dict[tuple[str, Path], dict]:
    return {(s["name"], path): s for path, group in groups(spec) for s in group.get("signals") or []}


def produced(spec: dict) -> dict[tuple[str, Path], tuple[str, Path]]:
    """Signals that transforms put out, with the dataset of each."""
    return {(t["signal"], path): (name, path) for (name, path), d in datasets(spec).items() for t in d.get("transform") or [] if isinstance(t.get("signal"), str)}


def lookup(known, name: str, path: Path) -> tuple[str, Path] | None:
    """The variable that ``name`` means at a path: the innermost of its and the enclosing scopes."""
    for n in range(len(path), -1, -1):
        if (name, path[:n]) in known:
            return name, path[:n]
    return None


def strings(x) -> Iterator[str]:
    """All strings in a value."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for v in x.values():
            yield from strings(v)
    elif isinstance(x, list):
        for v in x:
            yield from strings(v)


def expressions(x, keys=("signal", "expr", "update", "init", "test", "filter")) -> Iterator[str]:
    """Expression texts found in a value under the keys that hold them."""
    if isinstance(x, dict):
        for k, v in x.items():
            if k in keys and isinstance(v, str):
                yield v
            else:
                yield from expressions(v, keys)
    elif isinstance(x, list):
        for v in x:
            yield from expressions(v, keys)
