"""Nodes of a build graph and the decorators that make them from functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import wraps
from typing import Any, Generic, TypeVar

from matgraph.plans.hashing import compute_hash

DEFAULT_POOL = "default"
Result = TypeVar("Result")

#: Where the running body writes; bound around each body.
bound_output: ContextVar[Any] = ContextVar("matgraph_output")


def output() -> Any:
    """The path that the running body writes its files to. Bodies that return a
    DataFrame don't need it."""
    try:
        return bound_output.get()
    except LookupError:
        raise RuntimeError("output() has a value only while a step's body runs") from None


class _Output:
    """The older spelling of :func:`output`: ``OUTPUT.get()``."""

    def get(self) -> Any:
        return output()

    def __reduce__(self) -> str:
        return "OUTPUT"


OUTPUT = _Output()


@dataclass(frozen=True)
class Derivation:
    """A cached step. ``builder`` takes the realized dependencies in order and returns a
    DataFrame, or writes to :func:`output` and returns None."""

    name: str
    hash: bytes
    dependencies: list = field(default_factory=list)
    builder: Callable[[list], Any] = None
    pool: str = DEFAULT_POOL
    slots: int = 1
    isolate: bool = False

    def __post_init__(self):
        if not self.name or "/" in self.name or self.name in (".", ".."):
            raise ValueError(f"a step's name is a bare file name, not {self.name!r}")
        if self.slots < 1:
            raise ValueError(f"step {self.name} takes {self.slots} slots; one is the least")


@dataclass(frozen=True)
class Expression(Generic[Result]):
    """An uncached step: evaluated in every run, once for each run."""

    hash: bytes
    dependencies: list = field(default_factory=list)
    builder: Callable[[list], Result] = None


Realizable = Derivation | Expression
FileLike = Derivation | Expression


def is_node(value: Any) -> bool:
    return isinstance(value, (Derivation, Expression))


def key_of(node: Realizable) -> tuple:
    """Identity within a run. The name counts, so equal contents under two names are two
    entries."""
    return (type(node).__name__, node.hash, getattr(node, "name", ""))


def label_of(node: Realizable) -> str:
    """What a node is published and reported as."""
    if isinstance(node, Derivation):
        return f"{node.hash.hex()}-{node.name}"
    return f"expr-{node.hash.hex()}"


@dataclass(frozen=True)
class _Slot:
    """Stands for the dependency of that number."""

    number: int


def _refuse_nested(value: Any) -> None:
    if isinstance(value, dict):
        value = [*value, *value.values()]
    if isinstance(value, (list, tuple, set, frozenset)):
        for x in value:
            if is_node(x):
                raise TypeError("a step inside a container isn't found as a dependency; pass Gather(...) or separate arguments")
            _refuse_nested(x)


def _captured(func: Callable, args: tuple, kwargs: dict) -> tuple[list, Callable[[list], Any]]:
    """(dependencies, a function of their values that makes the call)."""
    found: list = []

    def kept(value: Any) -> Any:
        if is_node(value):
            found.append(value)
            return _Slot(len(found) - 1)
        _refuse_nested(value)
        return value

    held, named = [kept(a) for a in args], {k: kept(v) for k, v in kwargs.items()}

    @wraps(func)
    def call(values: list) -> Any:
        fill = lambda x: values[x.number] if isinstance(x, _Slot) else x
        return func(*map(fill, held), **{k: fill(v) for k, v in named.items()})

    return found, call


def derivation(name: str | Callable[..., str], *, pool: str = DEFAULT_POOL, slots: int = 1, isolate: bool = False, version: Any = None) -> Callable:
    """Decorator: a call gives a cached step. ``name`` may be computed from the call's
    arguments. ``pool``, ``slots`` and ``isolate`` say how it runs and aren't part of its
    address; ``version`` is, for changes that the source doesn't show."""

    def decorate(func: Callable) -> Callable[..., Derivation]:
        @wraps(func)
        def declared(*args, **kwargs) -> Derivation:
            own = name(*args, **kwargs) if callable(name) else name
            found, call = _captured(func, args, kwargs)
            return Derivation(own, compute_hash(func, own, args, kwargs, version), found, call, pool, slots, isolate)

        return declared

    return decorate


def expression(*, version: Any = None) -> Callable:
    """Decorator: a call gives an uncached step."""

    def decorate(func: Callable) -> Callable[..., Expression]:
        @wraps(func)
        def declared(*args, **kwargs) -> Expression:
            found, call = _captured(func, args, kwargs)
            return Expression(compute_hash(func, "expr", args, kwargs, version), found, call)

        return declared

    return decorate


def whereabouts(builder: Any) -> str:
    """File and line of a body, for messages."""
    func = inspect.unwrap(builder)
    code = getattr(func, "__code__", None)
    return f"{code.co_filename}:{code.co_firstlineno}" if code else repr(builder)
