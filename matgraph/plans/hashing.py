"""Recipe hashes: what a step is, as bytes.

Every piece goes in with a type tag and its length, so different recipes can't
run together into equal bytes. Arguments are bound to the signature first, so
``f(1)`` and ``f(x=1)`` are one recipe, and mappings and sets are put in order.
Decorator lines are not part of the source: where a step runs doesn't change what
it makes. Only the function's own source counts; a change in a helper is declared
by the step's ``version``.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import textwrap
from pathlib import PurePath
from typing import Any


def _tagged(tag: str, *parts: bytes) -> bytes:
    body = b"".join(len(p).to_bytes(8, "big") + p for p in parts)
    return tag.encode() + len(parts).to_bytes(8, "big") + body


def encode(value: Any) -> bytes:
    """A value as canonical bytes. Steps count by kind, hash and name."""
    from matgraph.plans.nodes import is_node

    if is_node(value):
        return _tagged("N", type(value).__name__.encode(), value.hash, getattr(value, "name", "").encode())
    if value is None or isinstance(value, (bool, int, float, complex)):
        return _tagged(type(value).__name__, repr(value).encode())
    if isinstance(value, str):
        return _tagged("str", value.encode("utf-8", "surrogatepass"))
    if isinstance(value, (bytes, bytearray)):
        return _tagged("bytes", bytes(value))
    if isinstance(value, PurePath):
        return _tagged("path", str(value).encode())
    if isinstance(value, (list, tuple)):
        return _tagged(type(value).__name__, *map(encode, value))
    if isinstance(value, (set, frozenset)):
        return _tagged("set", *sorted(map(encode, value)))
    if isinstance(value, dict):
        return _tagged("dict", *(x for pair in sorted((encode(k), encode(v)) for k, v in value.items()) for x in pair))
    if inspect.isfunction(value):
        return _tagged("function", value.__qualname__.encode(), source_of(value).encode())
    if type(value).__module__.startswith("pyspark.sql") and type(value).__name__ in ("DataFrame", "Column"):
        raise TypeError("a DataFrame has no lasting identity; pass the step that makes it")
    from pyspark import cloudpickle

    return _tagged("pickle", cloudpickle.dumps(value))


def source_of(func: Any) -> str:
    """A function's source from its ``def`` on, or its name where there is no source."""
    try:
        source = textwrap.dedent(inspect.getsource(func))
    except (OSError, TypeError):
        return f"{getattr(func, '__module__', '')}.{getattr(func, '__qualname__', repr(func))}"
    try:
        top = ast.parse(source).body[0]
    except SyntaxError:
        return source
    if isinstance(top, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return "\n".join(source.splitlines()[top.lineno - 1 :])
    return source


def compute_hash(func: Any, name: str, args: tuple = (), kwargs: dict | None = None, version: Any = None) -> bytes:
    """The 32-byte address of a call of ``func`` as the step ``name``."""
    kwargs = kwargs or {}
    try:
        bound = inspect.signature(func).bind(*args, **kwargs)
        bound.apply_defaults()
        given: Any = dict(bound.arguments)
    except (TypeError, ValueError):
        given = [list(args), kwargs]
    recipe = _tagged("step-1", getattr(func, "__name__", "").encode(), source_of(func).encode(), name.encode(), encode(version), encode(given))
    return hashlib.blake2b(recipe, digest_size=32).digest()
