"""Generation of expressions: legal tokens, exact-size reachability, enumeration, sampling, partition masses.

A partial expression is a prefix of tokens; holes are what it still needs. No neural policy: sampling is uniform over legal tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np

from ..functions.elementwise import COMMUTATIVE
from .expression import RAW, Action, Node, actions


class Grammar:
    def __init__(self, max_nodes: int = 15, max_depth: int = 6, leaves: tuple[str, ...] = RAW):
        self.max_nodes, self.max_depth, self.leaves = max_nodes, max_depth, leaves
        self.actions = actions(leaves)

    def holes(self, tokens: tuple[Action, ...]) -> list[int]:
        """Depths of the open operands, the next one last."""
        stack = [0]
        for a in tokens:
            d = stack.pop()
            stack += [d + 1] * a.arity
        return stack

    def legal(self, tokens: tuple[Action, ...], nodes: int | None = None) -> list[Action]:
        """Actions that can come next so that the expression can still end: exactly with `nodes` nodes, or within the limits."""
        holes = self.holes(tokens)
        if not holes:
            return []
        out = []
        for a in self.actions:
            after = [*holes[:-1], *[holes[-1] + 1] * a.arity]
            if holes[-1] + (a.arity > 0) > self.max_depth:
                continue
            used = len(tokens) + 1
            if nodes is None:
                ok = used + len(after) <= self.max_nodes
            else:
                ok = self.reachable(tuple(after), nodes - used)
            if ok:
                out.append(a)
        return out

    def sizes(self, depth: int) -> frozenset[int]:
        """Sizes that an operand at this depth can have, up to max_nodes."""
        return _sizes(self.max_depth - depth, self.max_nodes)

    def reachable(self, holes: tuple[int, ...], nodes: int) -> bool:
        """Whether the holes can be filled with exactly so many nodes."""
        sums = {0}
        for d in holes:
            sums = {s + n for s in sums for n in self.sizes(d) if s + n <= nodes}
        return nodes in sums

    # partial trees: None is a hole; a filled place is an action and its children

    def open_slots(self, tree) -> list[tuple[int, ...]]:
        """Paths of the holes, one of those that symmetry makes alike: the first."""
        slots: dict[str, tuple[int, ...]] = {}
        for path in sorted(_places(tree, lambda x: x is None)):
            slots.setdefault(_key(_put(tree, path, _MARK)), path)
        return sorted(slots.values())

    def fits(self, tree, path: tuple[int, ...]) -> list[Action]:
        """Actions that can fill a hole within the limits of depth and size."""
        nodes, holes = len(_places(tree, lambda x: x is not None)), len(_places(tree, lambda x: x is None))
        return [a for a in self.actions if not (a.arity and len(path) >= self.max_depth) and nodes + holes + a.arity <= self.max_nodes]

    def transitions(self, tree) -> list[tuple[tuple[int, ...], Action]]:
        """A place and an action for each tree that can come next."""
        out: dict[str, tuple] = {}
        for path in self.open_slots(tree):
            for a in self.fits(tree, path):
                out.setdefault(_key(self.step(tree, path, a)), (path, a))
        return list(out.values())

    def step(self, tree, path: tuple[int, ...], action: Action):
        """The tree with the hole filled, in canonical order."""
        return _sorted(_put(tree, path, (action, (None,) * action.arity)))

    def parents(self, node) -> int:
        """From how many trees one step leads here; the uniform backward probability is 1 over it. node: a tree or an expression.

        A step is taken back at a place whose operands are all holes, or that has none; trees that symmetry makes alike count once.
        """
        return len(self.parent_trees(node))

    def parent_trees(self, node) -> list:
        tree = _sorted(_tree(node))
        ends = _places(tree, lambda x: x is not None and all(c is None for c in x[1]))
        return list({_key(t): t for t in (_sorted(_put(tree, p, None)) for p in ends)}.values())

    def enumerate(self, nodes: int, depth: int = 0) -> Iterator[Node]:
        """Canonical expressions of exactly so many nodes, each once."""
        if nodes == 1:
            for a in self.actions:
                if a.arity == 0:
                    yield Node(a)
            return
        if depth >= self.max_depth:
            return
        for a in self.actions:
            if a.arity == 1:
                for c in self.enumerate(nodes - 1, depth + 1):
                    yield Node(a, (c,))
            elif a.arity == 2:
                for k in range(1, nodes - 1):
                    if a.name in COMMUTATIVE and k > nodes - 1 - k:
                        continue
                    for x in self.enumerate(k, depth + 1):
                        for y in self.enumerate(nodes - 1 - k, depth + 1):
                            if a.name not in COMMUTATIVE or k < nodes - 1 - k or x.json() <= y.json():
                                yield Node(a, (x, y)).canonical()

    def count(self, nodes: int) -> int:
        """How many canonical expressions have so many nodes, without listing them (no depth limit binds below max_depth + 1 nodes)."""
        return _count(nodes, len(self.leaves), self.max_depth)

    def sample(self, nodes: int, seed: int) -> Node:
        """An expression of exactly so many nodes, each legal token equally likely."""
        rng, tokens = np.random.default_rng(seed), ()
        while legal := self.legal(tokens, nodes):
            tokens += (legal[rng.integers(len(legal))],)
        return self.build(tokens)

    def build(self, tokens: tuple[Action, ...]) -> Node:
        rest = list(tokens)

        def take() -> Node:
            a = rest.pop(0)
            return Node(a, tuple(take() for _ in range(a.arity)))

        return take()

    def plan(self, seconds: dict[int, float], budget: float) -> dict[int, bool]:
        """Which sizes to enumerate in full, smallest first, within a budget of seconds; seconds: cost of one expression by size."""
        out, left = {}, budget
        for n in sorted(seconds):
            cost = self.count(n) * seconds[n]
            out[n] = cost <= left
            left -= cost if out[n] else 0
        return out


_MARK = "?"


def _tree(node):
    return (node.action, tuple(_tree(c) for c in node.children)) if isinstance(node, Node) else node


def _key(tree) -> str:
    """Canonical text of a partial tree."""
    if tree is None:
        return "_"
    if tree == _MARK:
        return _MARK
    kids = [_key(c) for c in tree[1]]
    return f"{tree[0].token}({','.join(sorted(kids) if tree[0].name in COMMUTATIVE else kids)})"


def _sorted(tree):
    """Operands of commutative operators in order of their text."""
    if not isinstance(tree, tuple):
        return tree
    kids = tuple(_sorted(c) for c in tree[1])
    return tree[0], tuple(sorted(kids, key=_key)) if tree[0].name in COMMUTATIVE else kids


def _places(tree, wanted, path: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    own = [path] if wanted(tree) else []
    return own + [p for k, c in enumerate(tree[1] if tree else ()) for p in _places(c, wanted, (*path, k))]


def _put(tree, path: tuple[int, ...], value):
    if not path:
        return value
    return tree[0], tuple(_put(c, path[1:], value) if k == path[0] else c for k, c in enumerate(tree[1]))


@cache
def _sizes(levels: int, most: int) -> frozenset[int]:
    if levels <= 0:
        return frozenset({1})
    below = _sizes(levels - 1, most)
    return frozenset({1} | {n + 1 for n in below if n < most} | {a + b + 1 for a in below for b in below if a + b < most})


@cache
def _count(nodes: int, leaves: int, levels: int) -> int:
    if nodes == 1:
        return leaves
    if levels <= 0:
        return 0
    kinds = [a for a in actions(RAW) if a.arity]
    one, two = sum(a.arity == 1 for a in kinds), [a for a in kinds if a.arity == 2]
    swap = sum(a.name in COMMUTATIVE for a in two)
    total = one * _count(nodes - 1, leaves, levels - 1)
    for k in range(1, nodes - 1):
        x, y = _count(k, leaves, levels - 1), _count(nodes - 1 - k, leaves, levels - 1)
        total += (len(two) - swap) * x * y
        if k < nodes - 1 - k:
            total += swap * x * y
        elif k == nodes - 1 - k:
            total += swap * x * (x + 1) // 2
    return total


def schedule(conditions: list[int], cycles: int, seed: int) -> list[int]:
    """Every condition once a cycle, in an order shuffled anew."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(cycles):
        out += [conditions[k] for k in rng.permutation(len(conditions))]
    return out


def synthetic_log_reward(node: Node, field: float = 1.0, operator: float = 1.0, size: float = 0.1) -> float:
    names = {n.action.name for n in node.walk()}
    return field * ("close" in names) + operator * ("ts_mean" in names) - size * node.stats()["nodes"]


def trajectory_balance(log_z: float, forward: list[float], backward: list[float], log_reward: float) -> float:
    return (log_z + math.fsum(forward) - log_reward - math.fsum(backward)) ** 2
