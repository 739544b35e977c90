"""Maximum flow on small networks and controlled rounding of two-way tables."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from fractions import Fraction
from math import ceil, floor


class Network:
    """Dinic's algorithm; nodes are any hashable values."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # [head, residual capacity]; arc i and i ^ 1 are reverse
        self.out: dict = {}

    def arc(self, tail, head, capacity: int) -> int:
        for node, other, room in ((tail, head, capacity), (head, tail, 0)):
            self.out.setdefault(node, []).append(len(self.arcs))
            self.arcs.append([other, room])
        return len(self.arcs) - 2

    def _levels(self, source, sink) -> dict | None:
        level, queue = {source: 0}, deque([source])
        while queue:
            node = queue.popleft()
            for i in self.out.get(node, ()):
                head, room = self.arcs[i]
                if room > 0 and head not in level:
                    level[head] = level[node] + 1
                    queue.append(head)
        return level if sink in level else None

    def push(self, source, sink) -> int:
        """Send all that fits from source to sink; returns the amount."""
        total = 0
        while level := self._levels(source, sink):
            progress = {node: 0 for node in level}
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    amount = min(self.arcs[i][1] for i in path)
                    for i in path:
                        self.arcs[i][1] -= amount
                        self.arcs[i ^ 1][1] += amount
                    total += amount
                    node, path = source, []
                    continue
                arcs = self.out[node]
                while progress[node] < len(arcs):
                    head, room = self.arcs[arcs[progress[node]]]
                    if room > 0 and level.get(head) == level[node] + 1:
                        break
                    progress[node] += 1
                if progress[node] < len(arcs):
                    path.append(arcs[progress[node]])
                    node = self.arcs[path[-1]][0]
                elif path:
                    node = self.arcs[path.pop() ^ 1][0]
                    progress[node] += 1
                else:
                    break
        return total

    def flow(self, i: int) -> int:
        return self.arcs[i ^ 1][1]


def controlled_rounding(table: dict[tuple, Fraction]) -> dict[tuple, int]:
    """Integer table in which every cell, row sum, column sum and the total is the
    fractional one rounded up or down. Such a table always exists."""
    rows: dict = {}
    columns: dict = {}
    for (r, c), x in table.items():
        rows[r] = rows.get(r, Fraction(0)) + x
        columns[c] = columns.get(c, Fraction(0)) + x
    net, excess, arcs = Network(), {}, {}

    def bounded(tail, head, x: Fraction) -> int:
        """An arc with bounds floor(x) and ceil(x): the lower bound is sent at once."""
        low = floor(x)
        excess[head] = excess.get(head, 0) + low
        excess[tail] = excess.get(tail, 0) - low
        return net.arc(tail, head, ceil(x) - low)

    for r, x in rows.items():
        bounded("from", ("row", r), x)
    for c, x in columns.items():
        bounded(("column", c), "to", x)
    for (r, c), x in table.items():
        arcs[r, c] = bounded(("row", r), ("column", c), x)
    bounded("to", "from", sum(table.values(), Fraction(0)))
    for node, amount in excess.items():
        if amount > 0:
            net.arc("super", node, amount)
        elif amount < 0:
            net.arc(node, "sub", -amount)
    net.push("super", "sub")
    return {cell: floor(x) + net.flow(arcs[cell]) for cell, x in table.items()}


def fill(shares: dict, low: dict, high: dict, total: int) -> dict[tuple, Fraction]:
    """Fractional amounts proportional to ``shares`` within [low, high], summing to
    ``total`` or as near to it as the bounds allow. Exact: the common factor lies between two
    of its breakpoints, which are found by bisection."""
    shares = {k: Fraction(s) for k, s in shares.items()}

    def at(factor: Fraction) -> dict:
        return {k: min(max(factor * s, Fraction(low[k])), Fraction(high[k])) for k, s in shares.items()}

    points = sorted({Fraction(b[k]) / s for k, s in shares.items() if s for b in (low, high)} | {Fraction(0)})
    i = bisect_left(points, True, key=lambda point: sum(at(point).values()) >= total)
    if i == len(points):
        return at(points[-1])
    below, point = points[max(0, i - 1)], points[i]
    a, b = sum(at(below).values()), sum(at(point).values())
    if b <= total or a >= total or a == b:
        return at(below if a >= total else point)
    return at(below + (point - below) * (total - a) / (b - a))
