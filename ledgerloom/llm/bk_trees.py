"""BK-trees over 64-bit fingerprints, many at once: children keyed by their distance to the parent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 65  # possible distances of two 64-bit words
# Pairs of (query, node) that a search looks at together, and links held before they are contracted.
FRONTIER = 1 << 18
LINKS = 1 << 21


@dataclass(frozen=True)
class BkTrees:
    """Trees over ``points``. Point k hangs below its parent at ``distance``; roots have none.

    ``edge`` holds parent * WIDTH + distance of every child in ascending order, ``child`` the child.
    ``links`` are the pairs within the radius that growing met.
    """

    points: np.ndarray
    root_of: np.ndarray
    edge: np.ndarray
    child: np.ndarray
    links: tuple[np.ndarray, np.ndarray]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grow_trees(points: np.ndarray, tree: np.ndarray, radius: int) -> BkTrees:
    """One tree for each number in ``tree`` (0, 1, ... in ascending order); its first point is the root.

    All points go down together, a level at a time: of those that reach a node at one distance where it
    has no child yet, the first becomes the child and the others go on below it.
    """
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    at = roots[tree]
    waiting = np.flatnonzero(at != np.arange(len(points)))
    edges, children, ends, starts = [], [], [], []
    while len(waiting):
        distance = _apart(points[waiting], points[at[waiting]])
        near = distance <= radius
        ends.append(waiting[near])
        starts.append(at[waiting[near]])
        key, first, group = np.unique(at[waiting] * WIDTH + distance, return_index=True,
                                      return_inverse=True)
        edges.append(key)
        children.append(waiting[first])
        at[waiting] = waiting[first][group]
        waiting = np.delete(waiting, first)
    edge = np.concatenate([np.zeros(0, np.int64), *edges])
    child = np.concatenate([np.zeros(0, np.int64), *children])
    order = np.argsort(edge, kind="stable")
    none = np.zeros(0, np.int64)
    return BkTrees(points, roots, edge[order], child[order],
                   (np.concatenate([none, *ends]), np.concatenate([none, *starts])))


def _steps(trees: BkTrees, queries: np.ndarray, tree: np.ndarray, radius: int):
    """(query, node) pairs within the radius, in pieces.

    From a node at distance d only edges of d - radius to d + radius are followed. What hangs by an
    edge within the radius is linked to the node; where the query is linked to the node too, nothing
    new can come from there, and those edges are passed by.
    """
    step = max(1, FRONTIER // 8)
    waiting = [(a, min(a + step, len(queries))) for a in range(0, len(queries), step)]
    for first, last in waiting:
        query = np.arange(first, last)
        stack = [(query, trees.root_of[tree[query]])]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            distance = _apart(queries[query], trees.points[node])
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.where(hit, radius + 1, np.maximum(distance - radius, 0))
            high = np.minimum(distance + radius, WIDTH - 1)
            begin = np.searchsorted(trees.edge, node * WIDTH + low)
            many = np.maximum(np.searchsorted(trees.edge, node * WIDTH + high, "right") - begin, 0)
            total = int(many.sum())
            if total:
                offset = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                stack.append((np.repeat(query, many), trees.child[offset + np.arange(total)]))


def least_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. n-1 is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if (label == before).all():
            return label


def linked_labels(trees: BkTrees, queries: np.ndarray, tree: np.ndarray, radius: int,
                  own: bool) -> np.ndarray:
    """Labels of all points, then of all queries, connected by links within the radius.

    ``own`` says that the queries are the points themselves.
    """
    n = len(trees.points)
    total = n if own else n + len(queries)
    label = least_labels(total, *trees.links)
    left, right, held = [], [], 0

    def contracted():
        return least_labels(total, np.concatenate([np.arange(total), *left]),
                            np.concatenate([label, *right]))

    for query, node in _steps(trees, queries, tree, radius):
        query = query if own else query + n
        new = label[query] != label[node]
        left.append(query[new])
        right.append(node[new])
        held += int(new.sum())
        if held > LINKS:
            label = contracted()
            left, right, held = [], [], 0
    return contracted()
