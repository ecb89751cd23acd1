"""Fitted Spark ML trees as conditions and as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"^(\s*)(?:(If|Else) \(feature ([0-9]+) (<=|>) ([-0-9.Ee]+)\)|Predict: ([-0-9.Ee]+))")


@dataclass
class Node:
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0


def tree_of(model) -> Node:
    """The tree that a fitted DecisionTree model prints."""
    lines = [m for m in map(_LINE.match, model.toDebugString.splitlines()) if m]

    def read(k: int) -> tuple[Node, int]:
        m = lines[k]
        if m[6] is not None:
            return Node(value=float(m[6])), k + 1
        low, k = read(k + 1)
        high, k = read(k + 1)  # lines[k] is the Else of the same split
        return Node(int(m[3]), float(m[5]), low, high), k

    return read(0)[0]


def tree_column(node: Node, feature: Callable[[int], Column]) -> Column:
    if node.low is None or node.high is None:
        return F.lit(node.value)
    return F.when(feature(node.feature) <= node.threshold, tree_column(node.low, feature)).otherwise(tree_column(node.high, feature))


Rule = tuple[tuple[int, bool, float], ...]


def rules_of(node: Node, path: Rule = ()) -> set[Rule]:
    """The conditions (feature, greater?, threshold) from the root to every node below it; of two bounds of a kind the tighter."""
    out = {path} if path else set()
    if node.low is not None and node.high is not None:
        for child, greater in ((node.low, False), (node.high, True)):
            own = {(f, g): v for f, g, v in path}
            key = (node.feature, greater)
            own[key] = (max if greater else min)(own.get(key, node.threshold), node.threshold)
            out |= rules_of(child, tuple(sorted((f, g, v) for (f, g), v in own.items())))
    return out
