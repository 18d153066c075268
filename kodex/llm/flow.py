"""Minimum-cost flow on a small graph."""

from __future__ import annotations

import heapq


class Flow:
    """Successive shortest paths with potentials; integer capacities, costs of 0 or more."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        """Add an arc; its number, whose flow is left[number + 1]."""
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: object, sink: object) -> int:
        """Send as much as possible at the least cost; the amount sent."""
        sent, level = 0, dict.fromkeys(self.out, 0)
        while True:
            best, by, queue, tie = {source: 0}, {}, [(0, 0, source)], 0
            while queue:
                d, _, x = heapq.heappop(queue)
                if d > best[x]:
                    continue
                for e in self.out.get(x, []):
                    y = self.to[e]
                    if self.left[e] and (n := d + self.cost[e] + level[x] - level[y]) < best.get(y, float("inf")):
                        best[y], by[y], tie = n, e, tie + 1
                        heapq.heappush(queue, (n, tie, y))
            if sink not in best:
                return sent
            far = max(best.values())
            level = {x: v + best.get(x, far) for x, v in level.items()}
            path, x = [], sink
            while x != source:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            amount = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= amount
                self.left[e ^ 1] += amount
            sent += amount
