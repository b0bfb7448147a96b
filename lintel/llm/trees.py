"""A small decision tree: Gini splits on numeric features, grown on a small table held in memory."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Tree:
    """Nodes as (feature, threshold, left, right, label); feature -1 marks a leaf. Values <= threshold go left."""

    nodes: list[tuple[int, float, int, int, int]]

    def decide(self, x: list[float]) -> int:
        at = 0
        while True:
            feature, threshold, left, right, label = self.nodes[at]
            if feature < 0:
                return label
            at = left if x[feature] <= threshold else right


def impurity(ones: int, n: int) -> float:
    return 2 * ones * (n - ones) / n if n else 0.0


def grow(rows: list[list[float]], labels: list[int], depth: int, leaf: int) -> Tree:
    """Greedy growth; ties go to the earlier feature and the smaller threshold; leaves hold the majority, ones on a tie."""
    nodes: list[tuple[int, float, int, int, int]] = []

    def build(members: list[int], left_depth: int) -> int:
        at, n, ones = len(nodes), len(members), sum(labels[i] for i in members)
        nodes.append((-1, 0.0, 0, 0, int(2 * ones >= n)))
        if not left_depth or ones in (0, n):
            return at
        best = (impurity(ones, n) - 1e-12, -1, 0.0)
        for f in range(len(rows[0])):
            order = sorted(members, key=lambda i: rows[i][f])
            seen = 0
            for k in range(1, n):
                seen += labels[order[k - 1]]
                low, high = rows[order[k - 1]][f], rows[order[k]][f]
                if low < high and leaf <= k <= n - leaf:
                    cost = impurity(seen, k) + impurity(ones - seen, n - k)
                    if cost < best[0]:
                        best = (cost, f, (low + high) / 2)
        _, f, threshold = best
        if f >= 0:
            left = build([i for i in members if rows[i][f] <= threshold], left_depth - 1)
            right = build([i for i in members if rows[i][f] > threshold], left_depth - 1)
            nodes[at] = (f, threshold, left, right, nodes[at][4])
        return at

    build(list(range(len(rows))), depth)
    return Tree(nodes)
