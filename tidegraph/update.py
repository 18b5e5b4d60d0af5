"""One commit for many results: each is repaired from the graphs before and after, then all change at once or none does."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidegraph.errors import InvalidArgument, StaleResult
from tidegraph.profiler import stage


class Later(dict):
    """Figures that cost work of their own: a value that is a function is worked out when it is first asked for by its name."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if callable(value):
            value = value()
            self[key] = value
        return value

    def get(self, key, default=None):
        return self[key] if key in self else default

    def values(self):
        return [self[k] for k in self]

    def items(self):
        return [(k, self[k]) for k in self]


@dataclass(frozen=True)
class Stats:
    """What an update of one result did. ``batch``: the container's summary."""

    affected: int = 0
    iterations: int = 0
    frontier_visits: int = 0
    fallback_used: bool = False
    converged: bool = True
    invalidated: int = 0
    batch: Any = None
    more: dict = field(default_factory=dict)


class Result:
    """Values that belong to one version of a container. ``repaired`` returns a new result and its stats; it must not change ``self``."""

    name = "result"

    def __init__(self, container, options: dict | None = None):
        self.container, self.graph_version, self.options = container, container.version, dict(options or {})

    def require_fresh(self, container=None) -> None:
        if container is not None and container is not self.container:
            raise InvalidArgument("the result belongs to another container")
        if self.graph_version != self.container.version:
            raise StaleResult(f"the result is of version {self.graph_version}, the container at {self.container.version}")

    def repaired(self, done) -> tuple[dict, Stats]:
        raise NotImplementedError

    def adopt(self, values: dict, version: int) -> None:
        for k, v in values.items():
            setattr(self, k, v)
        self.graph_version = version

    def clone(self):
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out.options = dict(self.options)
        return out

    def set_options(self, **options) -> None:
        unknown = set(options) - set(self.options)
        if unknown:
            raise InvalidArgument(f"unknown options {sorted(unknown)}")
        self.options.update(options)


def update(container, batch, *results: Result) -> list[Stats]:
    """Apply ``batch`` once and bring all ``results`` up to date. If anything fails, neither the container nor a result has changed."""
    if not results:
        raise InvalidArgument("no result to update")
    if len({id(r) for r in results}) < len(results):
        raise InvalidArgument("a result is named twice")
    for r in results:
        r.require_fresh(container)
    with stage(f"{type(container).__name__.lower()}.commit"):
        done = container.commit(batch)
    repaired = []
    for r in results:
        with stage(f"{r.name}.update"):
            repaired.append(r.repaired(done))
    container.adopt(done)
    for r, (values, _) in zip(results, repaired):
        r.adopt(values, container.version)
    return [stats for _, stats in repaired]


def toward(batches, container, *results: Result) -> list[list[Stats]]:
    """``update`` for each of several batches in turn."""
    return [update(container, b, *results) for b in batches]


def stats_frame(spark, stats: list[Stats]) -> DataFrame:
    """One row for each stats record."""
    rows = [(i, s.affected, s.iterations, s.frontier_visits, s.fallback_used, s.converged, s.invalidated) for i, s in enumerate(stats)]
    return spark.createDataFrame(rows, "batch long, affected long, iterations long, frontier_visits long, fallback_used boolean, converged boolean, invalidated long")
