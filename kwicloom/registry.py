"""The algorithms by name, with their arguments' schemas and the conditions under which they apply."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

KINDS = ("selecting", "sorting", "ranking", "partitioning", "clustering", "labelling", "annotation")
TYPES: dict[str, tuple[type, ...]] = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list, tuple), "object": (dict,)}


@dataclass(frozen=True)
class Algorithm:
    name: str
    kind: str
    fn: Callable[..., Any]
    args: dict[str, dict[str, Any]]
    scope: str = "line"
    applies: Callable[[Any], bool] = lambda view: True
    enrich: dict[str, Callable[[Any], dict[str, Any]]] = field(default_factory=dict)
    status: str = "stable"

    @property
    def module(self) -> str:
        return self.fn.__module__


ALGORITHMS: dict[str, Algorithm] = {}


def algorithm(name: str, kind: str, *, scope: str = "line", applies: Callable[[Any], bool] | None = None, enrich: dict | None = None, status: str = "stable", **args: dict[str, Any]):
    """Register a function ``fn(view, **arguments)``. Argument schemas are JSON Schema fragments; ``required`` inside marks the needed ones."""

    def wrap(fn: Callable[..., Any]) -> Callable[..., Any]:
        ALGORITHMS[name] = Algorithm(name, kind, fn, args, scope, applies or (lambda view: True), enrich or {}, status)
        return fn

    return wrap


def check(value: Any, schema: dict[str, Any], where: str) -> None:
    """A small part of JSON Schema: type, enum, bounds, array items."""
    kinds = schema.get("type")
    if kinds:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        ok = any(isinstance(value, TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds if k in TYPES)
        if not ok:
            raise ValueError(f"{where}: {value!r} is not of type {' or '.join(kinds)}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{where}: {value!r} is not one of {schema['enum']}")
    for bound, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b)):
        if bound in schema and isinstance(value, (int, float)) and bad(value, schema[bound]):
            raise ValueError(f"{where}: {value!r} breaks {bound} {schema[bound]}")
    if isinstance(value, (list, tuple)) and "items" in schema:
        for x in value:
            check(x, schema["items"], where)


def schema_for(name: str, view: Any = None) -> dict[str, Any]:
    """The JSON schema of an algorithm's arguments, with what depends on the data filled in if a view is given."""
    a = ALGORITHMS[name]
    properties = {k: {x: y for x, y in s.items() if x != "required"} for k, s in a.args.items()}
    if view is not None:
        for key, fill in a.enrich.items():
            properties[key] |= fill(view)
    return {"type": "object", "properties": properties, "required": [k for k, s in a.args.items() if s.get("required")]}


def arguments(name: str, given: dict[str, Any], view: Any = None) -> dict[str, Any]:
    """Defaults filled in, nulls left out, checked."""
    if name not in ALGORITHMS:
        raise ValueError(f"no algorithm {name!r}")
    schema = schema_for(name)
    out = {k: s["default"] for k, s in schema["properties"].items() if s.get("default") is not None} | given
    out = {k: v for k, v in out.items() if v is not None}
    for k in schema["required"]:
        if k not in out:
            raise ValueError(f"{name}: {k} is needed")
    for k, v in out.items():
        if k not in schema["properties"]:
            raise ValueError(f"{name}: no argument {k}")
        check(v, schema["properties"][k], f"{name}: {k}")
    return out


def execute(view: Any, name: str, given: dict[str, Any]) -> Any:
    args = arguments(name, given, view)
    try:
        return ALGORITHMS[name].fn(view, **args)
    except Exception as e:
        raise RuntimeError(f"{name} failed: {e}") from e


def digest(*algos: Any) -> str:
    return hashlib.md5(json.dumps(algos, sort_keys=True, default=str).encode()).hexdigest()


def available(view: Any) -> list[Algorithm]:
    """Algorithms that apply to a view, without annotations, by kind, module and name."""
    found = [a for a in ALGORITHMS.values() if a.kind != "annotation" and a.applies(view)]
    return sorted(found, key=lambda a: (KINDS.index(a.kind), a.module, a.name))


def token_attributes(view: Any) -> dict[str, Any]:
    return {"enum": [c for c in view.tokens.columns if c not in ("line_id", "id_in_line", "offset") and not c.startswith("_")]}


def numeric_token_attributes(view: Any) -> dict[str, Any]:
    return {"enum": [f.name for f in view.tokens.schema if isinstance(f.dataType, T.NumericType) and f.name not in ("line_id", "id_in_line", "offset")]}


def metadata_attributes(view: Any) -> dict[str, Any]:
    return {"enum": [c for c in view.metadata.columns if c != "line_id" and not c.startswith("_")]}


def vector_columns(view: Any) -> list[str]:
    return [f.name for f in view.metadata.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
