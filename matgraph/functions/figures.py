"""The figures of builds and runs, each defined once: as formulas over the fields of a
build state that are worked out on numbers of the driver or on columns.

An unknown (None, null) makes a formula unknown, but for ``either``; so does a division
by nothing.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

#: The statuses, in the order of every report.
STATUSES = ("done", "cached", "running", "waiting", "pending", "failed", "blocked")
ACTIVE = ("running", "waiting")
#: The numbers of a progress message, in the order in which they are read.
NUMBERS = ("DONE", "TOTAL")

_VALUES: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b if b else None,
    "most": min,
    "least": max,
    "some": lambda a: a or None,
}


class Formula:
    def __init__(self, op: str, *of: Any):
        self.op = op
        self.of = of if op in ("field", "number") else tuple(x if isinstance(x, Formula) else Formula("number", x) for x in of)

    def __add__(self, x: Any) -> Formula:
        return Formula("+", self, x)

    def __sub__(self, x: Any) -> Formula:
        return Formula("-", self, x)

    def __mul__(self, x: Any) -> Formula:
        return Formula("*", self, x)

    def __truediv__(self, x: Any) -> Formula:
        return Formula("/", self, x)

    def value(self, given: Mapping[str, Any]) -> Any:
        """On the fields of a mapping."""
        if self.op in ("field", "number"):
            return given[self.of[0]] if self.op == "field" else self.of[0]
        found = [f.value(given) for f in self.of]
        if self.op == "either":
            return next((x for x in found if x is not None), None)
        return None if None in found else _VALUES[self.op](*found)

    def column(self, **given: Any) -> Any:
        """On columns of those names, or the ones given."""
        from pyspark.sql import functions as F

        if self.op == "field":
            return given[self.of[0]] if self.of[0] in given else F.col(self.of[0])
        if self.op == "number":
            return F.lit(self.of[0])
        found = [f.column(**given) for f in self.of]
        if self.op in ("most", "least"):  # Spark's own skip nulls
            return F.when(found[0].isNotNull() & found[1].isNotNull(), {"most": F.least, "least": F.greatest}[self.op](*found))
        ops = {"either": F.coalesce, "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "some": lambda a: F.nullif(a, F.lit(0.0))}
        return ops[self.op](*found) if self.op in ops else _VALUES[self.op](*found)


def field(name: str) -> Formula:
    return Formula("field", name)


def either(a: Formula, b: Formula) -> Formula:
    return Formula("either", a, b)


#: Of a build; ``now`` is given.
ELAPSED = either(field("finished_at"), field("now")) - field("started_at")
FRACTION = Formula("least", Formula("most", field("done") / field("total"), 1.0), 0.0)
ETA = Formula("some", ELAPSED) / FRACTION - ELAPSED
#: Of a run, over the counts of its statuses, the mean seconds of builds that are done, now
#: and its start. As if each build left took that mean, so many at a time as hold slots now.
_HELD = field("running") + field("waiting")
RUN_ELAPSED = field("now") - field("run_started")
RUN_ETA = field("mean_s") * Formula("some", _HELD + field("pending")) / Formula("least", _HELD, 1)


class Clock(NamedTuple):
    """How spans of ``least`` seconds and more are told: by two units, the second of two digits."""

    least: int
    unit: int
    sign: str
    then: int
    end: str


#: 4:05 and 2h15m; an unknown span is --.
CLOCKS = (Clock(3600, 3600, "h", 60, "m"), Clock(0, 60, ":", 1, ""))
UNKNOWN = "--"


def told(seconds: float | None) -> str:
    if seconds is None:
        return UNKNOWN
    c = next(c for c in CLOCKS if int(seconds) >= c.least)
    return f"{int(seconds) // c.unit}{c.sign}{int(seconds) % c.unit // c.then:02d}{c.end}"


def told_column(seconds: Any) -> Any:
    from pyspark.sql import functions as F

    s = seconds.cast("long")
    out = F.when(s.isNull(), UNKNOWN)
    for c in CLOCKS:
        out = out.when(s >= c.least, F.format_string(f"%d{c.sign}%02d{c.end}", F.floor(s / c.unit), F.floor(s % c.unit / c.then)))
    return out


def rounded_column(value: Any, digits: int) -> Any:
    """As Python rounds a float: the nearest number of so many digits to the binary value itself,
    and to the even one if that lies between two. The product with the power of ten is taken
    as a sum of two floats, which is exact, so that ties are told from what only looks like one."""
    from pyspark.sql import functions as F

    power = float(10**digits)

    def of(x: Any) -> Any:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the digits
        p = x * power
        rest = (high * power - p) + (x - high) * power
        n = F.floor(p).cast("double")
        over = (p - n - 0.5) + rest
        whole = F.when((over > 0) | ((over == 0) & (n % 2 != 0)), n + 1).otherwise(n)
        # Floats that large have no digits to round; a zero keeps its sign.
        return F.when(~(F.abs(x) < float(1 << 49) / power), x).when(whole == 0, x * 0.0).otherwise(whole / power)

    # The value is worked out once, and named by the lambda.
    return F.element_at(F.transform(F.array(value.cast("double")), of), 1)


class Told(NamedTuple):
    """A field of a build in the status document: rounded to so many digits; left out if it
    is unknown, or given as null."""

    name: str
    of: Formula
    digits: int | None = None
    always: bool = False


#: The fields and lists of the status document.
BUILD_FIELDS = (
    *(Told(name, field(name), always=True) for name in ("name", "label", "pool", "slots", "status")),
    Told("elapsed_s", ELAPSED, 1, always=True),
    Told("fraction", FRACTION, 4),
    Told("eta_s", ETA, 1),
    Told("text", field("text")),
    Told("error", field("error")),
)
#: Name, statuses, and whether builds are told whole or by name.
LISTS = (("running", ACTIVE, True), ("pending", ("pending",), False), ("failed", ("failed",), True), ("blocked", ("blocked",), False))

#: The parts of a line of the log. A part with an unknown field is left out.
LOG_LINE = ("{padded} {name}  pool={pool}", " x{many}", " elapsed={spent}", "  error={last}")


def filled(part: str, field_of: Callable[[str], Any], joined: Callable[[list], Any], literal: Callable[[str], Any] = str) -> Any:
    """A part of a line, with its fields."""
    pieces: list = []
    for text, name, _, _ in string.Formatter().parse(part):
        pieces += ([literal(text)] if text else []) + ([field_of(name)] if name else [])
    return joined(pieces)
