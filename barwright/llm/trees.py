"""Spark ML decision trees as plain values: (feature, threshold, left, right) for a split, a number for a leaf."""

from __future__ import annotations

import re

_IF = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def parse_trees(description: str) -> list:
    """The trees in a model's `toDebugString`, all of them splits on continuous features."""
    lines = [x for x in description.splitlines()[1:] if x.strip()]
    at, trees = 0, []

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if leaf := _LEAF.match(line):
            return float(leaf[1])
        split = _IF.match(line)
        left = node()
        at += 1  # the Else line
        return int(split[1]), float(split[2]), left, node()

    while at < len(lines):
        if lines[at].lstrip().startswith("Tree "):
            at += 1
            continue
        trees.append(node())
    return trees


def decide(tree, x) -> float:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if x[feature] <= threshold else right
    return tree


def paths(tree, so_far: tuple = ()) -> list[tuple]:
    """Every path from the root to a node below it, as a conjunction of (feature, threshold, at most?)."""
    if not isinstance(tree, tuple):
        return []
    feature, threshold, left, right = tree
    out = []
    for below, at_most in ((left, True), (right, False)):
        rule = (*so_far, (feature, threshold, at_most))
        out += [rule, *paths(below, rule)]
    return out
