"""Letter transducers with weights, given as tables of arcs, and their composition."""

from __future__ import annotations

from collections.abc import Iterable

#: (state, symbol read, symbol written, names of weights, next state)
Arc = tuple[str, str, str, tuple[str, ...], str]


class Transducer:
    """Reads a symbol and writes one with each arc; a path's weight is the sum of what its arcs' weights are worth.

    An arc is left out where a state reads a symbol that it doesn't know; paths end in a final state or count for nothing.
    """

    def __init__(self, start: str, finals: Iterable[str], arcs: Iterable[Arc]):
        self.start, self.finals = start, frozenset(finals)
        self.arcs: dict[tuple[str, str], list[tuple[str, tuple[str, ...], str]]] = {}
        for state, read, written, weights, to in arcs:
            self.arcs.setdefault((state, read), []).append((written, weights, to))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads. Only states that can be reached are made."""
        start = f"{self.start} {other.start}"
        arcs, todo, ends, seen = [], [(self.start, other.start)], set(), {(self.start, other.start)}
        reads = sorted({read for _, read in self.arcs})
        while todo:
            a, b = todo.pop()
            if a in self.finals and b in other.finals:
                ends.add(f"{a} {b}")
            for read in reads:
                for middle, w1, to1 in self.arcs.get((a, read), ()):
                    for written, w2, to2 in other.arcs.get((b, middle), ()):
                        arcs.append((f"{a} {b}", read, written, w1 + w2, f"{to1} {to2}"))
                        if (to1, to2) not in seen:
                            seen.add((to1, to2))
                            todo.append((to1, to2))
        return Transducer(start, ends, arcs)

    def paths(self, symbols: Iterable[str]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
        """(symbols written, names of weights) of all paths from the start to a final state."""
        alive: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [(self.start, (), ())]
        for x in symbols:
            alive = [(to, out + (written,), names + w) for state, out, names in alive for written, w, to in self.arcs.get((state, x), ())]
        return [(out, names) for state, out, names in alive if state in self.finals]
