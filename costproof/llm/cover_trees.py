"""Cover trees over whole-number vectors and the dual-tree search for largest inner products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A child covers what lies within its parent's radius over BASE; nodes of LEAF points are not split.
BASE = 1.3
LEAF = 64
GROUP = 16
# Points of leaves that meet a query group in one product.
TOGETHER = 512
# A net with more children than points over this is given up: its members are as far apart as they can be.
SPLIT = 8
NONE = -np.inf
EXACT = float(1 << 52)


@dataclass
class Tree:
    """Points in tree order; a node is a range of them around a center, its children follow one another."""

    points: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child_lo: np.ndarray
    child_hi: np.ndarray
    center: np.ndarray
    radius: np.ndarray

    def leaf(self, node: int) -> bool:
        return self.child_lo[node] == self.child_hi[node]


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    top = max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
    return values.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    apart = points - center
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def build(points: np.ndarray, rows: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> Tree:
    """A cover tree: children's centers are further apart than the radius they cover, the first one is the parent's."""
    real = points.astype(np.float64)
    order = np.arange(len(real))
    spans, children, centers, radii = [(0, len(real))], [], [0], []
    node = 0
    while node < len(spans):
        lo, hi = spans[node]
        mine = order[lo:hi]
        far = _distances(real[mine], real[centers[node]])
        radius = far.max(initial=0.0)
        radii.append(radius)
        first = len(spans)
        if hi - lo > LEAF and radius > 0:
            net = _net(real, mine, far, radius / BASE)
            if net is not None:
                at = lo
                for center, members in net:
                    order[at : at + len(members)] = members
                    spans.append((at, at + len(members)))
                    centers.append(center)
                    at += len(members)
        children.append((first, len(spans)))
        node += 1
    lo, hi = np.array(spans).T
    child_lo, child_hi = np.array(children).T
    return Tree(
        points[order], rows[order], ids[order], unnamed[order], lo, hi, child_lo, child_hi,
        points[np.array(centers)] if len(points) else points, np.array(radii) * (1 + 1e-9),
    )


def _net(real: np.ndarray, members: np.ndarray, far: np.ndarray, reach: float) -> list[tuple[int, np.ndarray]] | None:
    """Centers, each with what lies within ``reach`` of it and of no earlier one; None where most are alone."""
    net, center = [], members[far.argmin()]
    left, most = members, max(2, len(members) // SPLIT)
    while len(left):
        near = _distances(real[left], real[center])
        inside = near <= reach
        net.append((int(center), left[inside]))
        if len(net) > most:
            return None
        left, near = left[~inside], near[~inside]
        if len(left):
            center = left[near.argmax()]
    return net if len(net) > 1 else None


def restricted(tree: Tree, wanted: np.ndarray) -> Tree:
    """The tree of the points marked ``wanted`` only: empty nodes go, radii shrink to what is left."""
    before = np.concatenate([[0], np.cumsum(wanted)])
    spans, children, centers, radii, source = [(0, int(before[-1]))], [], [], [], [0]
    points = tree.points[wanted]
    real = points.astype(np.float64)
    node = 0
    while node < len(spans):
        lo, hi = spans[node]
        old = source[node]
        centers.append(tree.center[old])
        radii.append(_distances(real[lo:hi], tree.center[old].astype(np.float64)).max(initial=0.0))
        first = len(spans)
        if hi - lo > GROUP:
            for child in range(tree.child_lo[old], tree.child_hi[old]):
                a, b = int(before[tree.lo[child]]), int(before[tree.hi[child]])
                if a < b:
                    spans.append((a, b))
                    source.append(child)
        children.append((first, len(spans)))
        node += 1
    lo, hi = np.array(spans).T
    child_lo, child_hi = np.array(children).T
    return Tree(
        points, tree.rows[wanted], tree.ids[wanted], tree.unnamed[wanted], lo, hi, child_lo, child_hi,
        np.array(centers), np.array(radii) * (1 + 1e-9),
    )


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; doubles do where no sum can leave their whole numbers."""
    a, b = left.astype(np.float64), right.astype(np.float64)
    most = lambda v: np.einsum("ij,ij->i", v, v).max(initial=0.0)
    if most(a) * most(b) < EXACT * EXACT:
        return (a @ b.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T  # sums wrap, the result does not


class Found:
    """The ``k`` best candidates of each query so far; ``least[q]`` is the score that a candidate must reach."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.least = np.full(queries, NONE) if least is None else least.astype(np.float64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * queries

    def add(self, queries: Tree, lo: int, hi: int, tree: Tree, at: np.ndarray) -> None:
        scores = products(queries.points[lo:hi], tree.points[at])
        other = queries.rows[lo:hi, None] != tree.rows[at]
        reach = other & (scores >= self.least[lo:hi, None])
        for i in np.flatnonzero(reach.any(axis=1)):
            hit = np.flatnonzero(reach[i])
            new = (scores[i, hit], tree.ids[at[hit]], tree.unnamed[at[hit]], tree.rows[at[hit]])
            merged = [np.concatenate(pair) for pair in zip(self.best[lo + i], new)]
            first = np.lexsort((merged[3], merged[1], merged[2], -merged[0]))[: self.k]
            self.best[lo + i] = tuple(m[first] for m in merged)
            if len(first) == self.k:
                self.least[lo + i] = max(self.least[lo + i], float(self.best[lo + i][0][-1]))


def search(queries: Tree, tree: Tree, found: Found) -> None:
    """Offer ``found`` every point of ``tree`` that can be among the best of a query, walking both trees at once.

    A pair of nodes goes when center product, radii and center lengths bound all its products below the
    worst k-th score of the query node; equal bounds stay, as ties go by id.
    """
    if not len(queries.points) or not len(tree.points):
        return
    centers = tree.center.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", centers, centers))
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        q, nodes = stack.pop()
        lo, hi = queries.lo[q], queries.hi[q]
        middle = queries.center[q].astype(np.float64)
        length, reach = np.sqrt(middle @ middle), queries.radius[q]
        while len(nodes):
            bound = centers[nodes] @ middle + reach * lengths[nodes] + tree.radius[nodes] * (length + reach)
            bound += 1 + 1e-9 * (lengths[nodes] + tree.radius[nodes]) * (length + reach)
            keep = bound >= found.least[lo:hi].min()
            nodes = nodes[keep][np.argsort(-bound[keep], kind="stable")]
            ends = tree.child_lo[nodes] == tree.child_hi[nodes]
            below = [np.arange(tree.child_lo[n], tree.child_hi[n]) for n in nodes[~ends]]
            if not queries.leaf(q):
                nodes = np.concatenate([nodes[ends], *below]) if len(nodes) else nodes
                if len(nodes):
                    stack += [(c, nodes) for c in range(queries.child_lo[q], queries.child_hi[q])]
                break
            waiting, size = [], 0
            for n, most in zip(nodes[ends], np.sort(bound[keep])[::-1][ends]):
                if most < found.least[lo:hi].min():
                    break  # the others' bounds are lower still
                waiting.append(np.arange(tree.lo[n], tree.hi[n]))
                size += len(waiting[-1])
                if size >= TOGETHER:
                    found.add(queries, lo, hi, tree, np.concatenate(waiting))
                    waiting, size = [], 0
            if waiting:
                found.add(queries, lo, hi, tree, np.concatenate(waiting))
            nodes = np.concatenate(below) if below else nodes[:0]
