"""The choice of a strategy from what is known: points, queries, axes, and the kind of search."""

from __future__ import annotations

from dataclasses import dataclass

BRUTE_PAIRS = 2_000_000
BRUTE_POINTS = 100_000
FEW_AXES = 4
CELLS_FROM = 4_000


@dataclass(frozen=True)
class Plan:
    kind: str
    strategy: str
    why: str

    def __str__(self) -> str:
        return f"{self.kind}: {self.strategy} ({self.why})"


def choose(kind: str, n: int, q: int, dims: int, strategy: str | None = None) -> Plan:
    allowed = {"knn": ("brute", "block", "cells"), "radius": ("brute", "block", "grid"), "box": ("brute", "block", "grid")}[kind]
    if strategy:
        if strategy not in allowed:
            raise ValueError(f"{kind} has no strategy {strategy!r}; it has {', '.join(allowed)}")
        return Plan(kind, strategy, "asked for")
    if n * q <= BRUTE_PAIRS and n <= BRUTE_POINTS:
        return Plan(kind, "brute", f"{n * q} pairs; the {n} points are broadcast")
    if kind in ("box", "radius") and dims <= FEW_AXES:
        return Plan(kind, "grid", f"{dims} axes: an equi-join on 3^{dims} cells")
    if kind == "knn" and dims <= FEW_AXES and n >= CELLS_FROM:
        return Plan(kind, "cells", f"{n} points on {dims} axes: boxes prune")
    return Plan(kind, "block", f"{dims} axes, {n} points: blocks of both sides")
