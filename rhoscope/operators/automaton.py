"""Modes of a hybrid system and the guarded transitions between them.

Automata are small; paths are found once, when a formula is compiled, not per row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from rhoscope.errors import EmptyConstraints


@dataclass(frozen=True)
class Guard:
    """Constraints (predicates) under which a transition may be taken."""

    constraints: tuple[Any, ...]

    @staticmethod
    def of(item: Any) -> Guard:
        if isinstance(item, Guard):
            return item
        return Guard(tuple(item)) if isinstance(item, (list, tuple, set, frozenset)) else Guard((item,))

    def __iter__(self):
        return iter(self.constraints)

    def distances(self, robustness) -> list:
        """``robustness`` of every constraint."""
        return [robustness(c) for c in self.constraints]


@dataclass(frozen=True)
class Path:
    """Number of transitions of a shortest path, and the guard of its first."""

    hops: int
    next_guard: Guard


@dataclass(frozen=True)
class Automaton:
    """Edges (from, to, guard). Parallel edges are kept; of equally short paths the first in edge order is taken."""

    edges: tuple[tuple[Hashable, Hashable, Guard], ...]

    def __init__(self, edges: Iterable | Mapping):
        pairs = ((a, b, g) for (a, b), g in edges.items()) if isinstance(edges, Mapping) else edges
        object.__setattr__(self, "edges", tuple((a, b, Guard.of(g)) for a, b, g in pairs))

    @staticmethod
    def from_rows(rows: Iterable, start: str, end: str, guard) -> Automaton:
        """From collected rows of a (small) edge table; ``guard(row)`` gives the constraints."""
        return Automaton((r[start], r[end], guard(r)) for r in rows)

    @staticmethod
    def from_df(edges, start: str, end: str, guard, most: int = 10_000) -> Automaton:
        """From a DataFrame of edges, in its order; ``guard(row)`` gives the constraints of an edge.

        An automaton is part of the plan, so a table of more than ``most`` edges is refused, as are edges without
        both labels or without a constraint.
        """
        rows = edges.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"there are more than {most} edges")
        for r in rows:
            if r[start] is None or r[end] is None:
                raise ValueError(f"edge {r.asDict()} has a label that is NULL")
            if not Guard.of(guard(r)).constraints:
                raise EmptyConstraints(f"edge {r.asDict()} has no constraint")
        return Automaton.from_rows(rows, start, end, guard)

    @property
    def labels(self) -> tuple[Hashable, ...]:
        return tuple(dict.fromkeys(x for a, b, _ in self.edges for x in (a, b)))

    def paths_from(self, start: Hashable) -> dict[Hashable, Path]:
        """Shortest paths to every other label that can be reached."""
        leaving: dict[Hashable, list[tuple[Hashable, Guard]]] = {}
        for a, b, g in self.edges:
            leaving.setdefault(a, []).append((b, g))
        found: dict[Hashable, Path] = {}
        line = deque([(start, 0, None)])
        while line:
            at, hops, first = line.popleft()
            for to, guard in leaving.get(at, ()):
                if to != start and to not in found:
                    found[to] = Path(hops + 1, first or guard)
                    line.append((to, hops + 1, first or guard))
        return found

    def shortest_path(self, start: Hashable, end: Hashable) -> Path | None:
        """None if ``end`` can't be reached, or is ``start``."""
        return None if start == end else self.paths_from(start).get(end)
