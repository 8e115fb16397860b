"""Operators by name, with categories, documented parameters and their snapping."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pixelquilt.plans.raster import Raster


@dataclass(frozen=True)
class Param:
    """A parameter; kind is float, int or bool.  help says what it does."""

    name: str
    default: float
    low: float = 0.0
    high: float = 1.0
    step: float = 0.0
    kind: str = "float"
    help: str = ""

    def value(self, given: object) -> float:
        """A given value: snapped to the steps from ``low``, half away from zero, and then clamped."""
        if isinstance(given, bool):
            given = float(given)
        if not isinstance(given, (int, float)):
            raise TypeError(f"parameter '{self.name}' takes a number, not {type(given).__name__}")
        if self.kind == "bool":
            return float(given != 0)
        v = float(math.trunc(given)) if self.kind == "int" else float(given)
        if self.step > 0:
            n = (v - self.low) / self.step
            v = self.low + math.copysign(math.floor(abs(n) + 0.5), n) * self.step
        return min(max(v, self.low), self.high)


@dataclass(frozen=True)
class Operator:
    name: str
    category: str
    inputs: int
    params: tuple[Param, ...]
    build: Callable

    def __call__(self, *rasters: Raster, **given: float):
        if len(rasters) != self.inputs:
            raise TypeError(f"'{self.name}' takes {self.inputs} image(s), not {len(rasters)}")
        return self.build(*rasters, **self.values(**given))

    def _known(self, given: dict) -> dict[str, Param]:
        known = {p.name: p for p in self.params}
        if odd := sorted(set(given) - set(known)):
            raise TypeError(f"'{self.name}' has no parameter '{odd[0]}'")
        return known

    def values(self, **given: float) -> dict[str, float]:
        """All parameters' values; only those that are given are snapped."""
        return {n: p.value(given[n]) if n in given else p.default for n, p in self._known(given).items()}

    def with_defaults(self, **defaults: float) -> Operator:
        """The operator with other defaults, such as an image suggests: clamped but not snapped.  They
        hold where no value is given."""
        self._known(defaults)
        return replace(self, params=tuple(replace(p, default=min(max(float(defaults[p.name]), p.low), p.high)) if p.name in defaults else p for p in self.params))


_REGISTRY: dict[str, Operator] = {}
#: A second physical plan of an operator, with the same parameters: what the first is compared with.
_SECOND: dict[str, Callable] = {}


def operator(name: str, category: str, *params: Param, inputs: int = 1) -> Callable:
    """Register a function (raster..., **params) under a name; a second one of that name is an error."""

    def add(build: Callable) -> Operator:
        if name in _REGISTRY:
            raise ValueError(f"operator '{name}' is registered twice")
        _REGISTRY[name] = Operator(name, category, inputs, params, build)
        return _REGISTRY[name]

    return add


def second_plan(name: str) -> Callable:
    """Register another way to the same result; an operator has one at most."""

    def add(build: Callable) -> Callable:
        if name in _SECOND:
            raise ValueError(f"operator '{name}' has a second plan already")
        _SECOND[name] = build
        return build

    return add


def has_second_plan(name: str) -> bool:
    _load()
    return name in _SECOND


def get_second(name: str) -> Operator:
    """The operator with its second plan."""
    first = get(name)
    if name not in _SECOND:
        raise ValueError(f"'{name}' has no second plan")
    return replace(first, build=_SECOND[name])


def get(name: str) -> Operator:
    _load()
    if name not in _REGISTRY:
        raise KeyError(f"unknown operator '{name}'")
    return _REGISTRY[name]


def names(category: str | None = None) -> list[str]:
    _load()
    return sorted(n for n, o in _REGISTRY.items() if category in (None, o.category))


def run(raster: Raster, *steps: tuple[str, dict] | str):
    """A chain of one-image operators."""
    for s in steps:
        name, given = (s, {}) if isinstance(s, str) else s
        raster = get(name)(raster, **given)
    return raster


def _load() -> None:
    from pixelquilt.operators import demosaic, edges, filters, point, second, threshold  # noqa: F401
