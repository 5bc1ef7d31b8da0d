"""Tools with argument schemas from their signatures."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable

_KINDS = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object", type(None): "null"}
_TYPES = {"integer": int, "number": (int, float), "string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _schema(kind) -> dict:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind in _KINDS:
        return {"type": _KINDS[kind]}
    if origin in (list, dict):
        inner = args[-1] if args else None
        return {"type": _KINDS[origin]} | ({"items" if origin is list else "additionalProperties": _schema(inner)} if inner else {})
    if args and type(None) in args:  # optional
        return {"anyOf": [_schema(a) for a in args]}
    return {}


def signature_schema(f: Callable) -> dict:
    """JSON Schema of a function's arguments."""
    hints = typing.get_type_hints(f)
    parameters = inspect.signature(f).parameters
    if any(p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in parameters.values()):
        raise TypeError(f"{f.__name__}: a tool names all its arguments")
    needed = [n for n, p in parameters.items() if p.default is p.empty]
    return {"type": "object", "properties": {n: _schema(hints.get(n)) for n in parameters}, "required": needed, "additionalProperties": False}


def check(value, schema: dict, at: str = "$") -> None:
    """Raise ValueError where a JSON value does not fit: type, enum, properties, required, items, anyOf."""
    if "anyOf" in schema:
        for option in schema["anyOf"]:
            try:
                return check(value, option, at)
            except ValueError:
                continue
        raise ValueError(f"{at}: {value!r} fits no alternative")
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        raise ValueError(f"{at}: {value!r} is no {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{at}: {value!r} is not one of {schema['enum']!r}")
    if isinstance(value, dict):
        known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
        for n in schema.get("required", ()):
            if n not in value:
                raise ValueError(f"{at}: {n!r} is missing")
        for n, v in value.items():
            if n not in known and extra is False:
                raise ValueError(f"{at}: {n!r} is unknown")
            check(v, known.get(n, extra if isinstance(extra, dict) else {}), f"{at}.{n}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            check(v, schema["items"], f"{at}[{i}]")


class Tool:
    """A named function. One with side effects is never run in place: an agent stages it with ``act``."""

    def __init__(self, f: Callable, name: str | None = None, side_effect: bool = False):
        self.f, self.name, self.side_effect, self.__doc__ = f, name or f.__name__, side_effect, f.__doc__
        self.schema = signature_schema(f)

    def __call__(self, **args):
        if self.side_effect:
            raise TypeError(f"{self.name!r} has side effects: stage it with act()")
        return self.execute(args)

    def execute(self, args: dict):
        """Check the arguments and run, side effects or not: for the executor of staged intents."""
        check(args, self.schema)
        return self.f(**args)


class Registry(dict):
    """Tools by name; a second one of a name is an error. It can stand for ``Config.tools``."""

    def tool(self, f: Callable | None = None, *, name: str | None = None, side_effect: bool = False):
        def add(f: Callable) -> Tool:
            made = Tool(f, name, side_effect)
            if made.name in self:
                raise ValueError(f"there is a tool {made.name!r} already")
            self[made.name] = made
            return made

        return add if f is None else add(f)
