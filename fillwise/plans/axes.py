"""Axes: what turns a value into the index of a bin.

Indices run from 0 to ``n - 1``; -1 is underflow and ``n`` overflow.  An index is a plain column expression of
comparisons and arithmetic, so that it stays within generated code.  A null gives a null index, which no histogram
counts.  NaN is above everything and goes to overflow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """Base of all axes.  Values outside an axis without the flow bin in question are dropped."""

    name: str = ""
    underflow: bool = True
    overflow: bool = True

    @property
    def n(self) -> int:
        raise NotImplementedError

    @property
    def extent(self) -> int:
        return self.n + self.underflow + self.overflow

    @property
    def first(self) -> int:
        return -1 if self.underflow else 0

    @property
    def last(self) -> int:
        return self.n if self.overflow else self.n - 1

    def index(self, x: Column) -> Column:
        raise NotImplementedError

    def inside(self, index: Column) -> Column:
        """Whether an index has a bin here."""
        return index.between(self.first, self.last)

    def edges(self) -> list[float]:
        """Edges of the bins in range; discrete axes have theirs half a unit below."""
        return [i - 0.5 for i in range(self.n + 1)]

    @property
    def continuous(self) -> bool:
        return False

    def describe(self) -> dict:
        out = {"kind": type(self).__name__, **{k: list(v) if isinstance(v, tuple) else v for k, v in vars(self).items()}}
        return out


@dataclass(frozen=True)
class Regular(Axis):
    bins: int = 1
    lo: float = 0.0
    hi: float = 1.0
    circular: bool = False

    def __post_init__(self) -> None:
        if self.bins < 1 or not self.lo < self.hi:
            raise ValueError("a regular axis has one bin at least and lo < hi")
        if self.circular:
            object.__setattr__(self, "underflow", False)

    @property
    def n(self) -> int:
        return self.bins

    @property
    def continuous(self) -> bool:
        return True

    def index(self, x: Column) -> Column:
        x = x.cast("double")
        z = (x - F.lit(float(self.lo))) / F.lit(float(self.hi) - float(self.lo))
        if self.circular:
            z = z - F.floor(z)
            finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
            return F.when(x.isNull(), None).when(finite, F.least(F.floor(z * self.bins), F.lit(self.bins - 1))).otherwise(self.bins).cast("int")
        inner = F.least(F.floor(z * self.bins), F.lit(self.bins - 1))
        return F.when(x.isNull(), None).when(z < 1, F.when(z >= 0, inner).otherwise(-1)).otherwise(self.bins).cast("int")

    def edges(self) -> list[float]:
        return [self.lo + (self.hi - self.lo) * i / self.bins for i in range(self.bins + 1)]


@dataclass(frozen=True)
class Variable(Axis):
    at: tuple[float, ...] = (0.0, 1.0)

    def __post_init__(self) -> None:
        object.__setattr__(self, "at", tuple(float(e) for e in self.at))
        if len(self.at) < 2 or any(a >= b for a, b in zip(self.at, self.at[1:])):
            raise ValueError("edges rise strictly, two at least")

    @property
    def n(self) -> int:
        return len(self.at) - 1

    @property
    def continuous(self) -> bool:
        return True

    def index(self, x: Column) -> Column:
        x = x.cast("double")

        def search(lo: int, hi: int) -> Column:  # number of edges <= x, between lo and hi
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x >= self.at[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

        return F.when(x.isNull(), None).otherwise(search(0, len(self.at)) - 1).cast("int")

    def edges(self) -> list[float]:
        return list(self.at)


@dataclass(frozen=True)
class Integer(Axis):
    lo: int = 0
    hi: int = 1

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def index(self, x: Column) -> Column:
        x = F.floor(x)
        return F.when(x.isNull(), None).when(x < self.lo, -1).when(x >= self.hi, self.n).otherwise(x - self.lo).cast("int")

    def edges(self) -> list[float]:
        return [self.lo + i - 0.5 for i in range(self.n + 1)]


@dataclass(frozen=True)
class _Category(Axis):
    categories: tuple = ()
    underflow: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "categories", tuple(self.categories))
        object.__setattr__(self, "underflow", False)
        if len(set(self.categories)) != len(self.categories):
            raise ValueError("categories are distinct")

    @property
    def n(self) -> int:
        return len(self.categories)

    def index(self, x: Column) -> Column:
        out = F.when(x.isNull(), None)
        for i, c in enumerate(self.categories):
            out = out.when(x == F.lit(c), i)
        return out.otherwise(self.n).cast("int")


@dataclass(frozen=True)
class IntCategory(_Category):
    """Listed integers; others go to overflow."""


@dataclass(frozen=True)
class StrCategory(_Category):
    """Listed strings; others go to overflow."""


@dataclass(frozen=True)
class Boolean(Axis):
    underflow: bool = False
    overflow: bool = False

    @property
    def n(self) -> int:
        return 2

    def index(self, x: Column) -> Column:
        return x.cast("boolean").cast("int")


def growable(*_args, **_options) -> Axis:
    """Axes whose bins follow the data are refused: the bins must be known before the pass."""
    raise ValueError("growable axes are not supported")


def named(axes: Sequence[Axis], prefix: str = "axis") -> list[Axis]:
    """The axes, each with a name, all names distinct."""
    out = [a if a.name else replace(a, name=f"{prefix}_{i}") for i, a in enumerate(axes)]
    names = [a.name for a in out]
    if len(set(names)) != len(names):
        raise ValueError(f"axis names are distinct: {names}")
    return out


def widths_and_centres(axis: Axis, x: Column) -> tuple[Column, Column, Column]:
    """(whether the value is in range, width of its bin, centre of its bin) of a continuous axis."""
    i = axis.index(x)
    inside = (i >= 0) & (i < axis.n)
    if isinstance(axis, Regular):
        width = F.lit((axis.hi - axis.lo) / axis.bins)
        centre = F.lit(axis.lo) + (i + 0.5) * width
        return inside, width, centre
    edges = F.array(*(F.lit(e) for e in axis.edges()))
    low, high = F.get(edges, F.greatest(i, F.lit(0))), F.get(edges, F.greatest(i, F.lit(0)) + 1)
    return inside, high - low, (high + low) / 2


def from_description(d: dict) -> Axis:
    d = dict(d)
    kind = {c.__name__: c for c in (Regular, Variable, Integer, IntCategory, StrCategory, Boolean)}[d.pop("kind")]
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def collapse(edges: Sequence[float], name: str, underflow: bool = True, overflow: bool = True) -> Axis:
    """A variable axis, or a regular one if its edges are evenly spaced (second differences below 1e-9 of the range)."""
    bends = [abs(c - 2 * b + a) for a, b, c in zip(edges, edges[1:], edges[2:])]
    if not bends or max(bends) < 1e-9 * abs(edges[-1] - edges[0]):
        return Regular(name, underflow, overflow, len(edges) - 1, edges[0], edges[-1])
    return Variable(name, underflow, overflow, tuple(edges))


def total_bins(axes: Sequence[Axis], flow: bool = True) -> int:
    return math.prod(a.extent if flow else a.n for a in axes)
