"""Deep-shallow sorting of strings that may share long prefixes.

Multikey quicksort orders the strings to a shallow depth, eight bytes at a time. Groups that still tie there share long
prefixes; each such group is ordered by a blind trie, which looks at branching bytes only and compares a new string
with one leaf to find its place.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Bytes that multikey quicksort looks at beyond the start depth.
SHALLOW = 24
_STEP = 8


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    lo, step = start, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(end, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: int = -1):
        self.depth, self.leaf, self.children = depth, leaf, {}


def _blind_trie(strings: Sequence[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """The group's order and the common prefix of each with its predecessor; the first has ``depth``."""
    # Ends sort before any byte: -1 stands for the end of a string, and equal strings share a leaf's list.
    at = lambda s, d: s[d] if d < len(s) else -1
    twins: dict[int, list[int]] = {}
    root = _Node(depth)
    first = group[0]
    twins[first] = [first]
    root.children[at(strings[first], depth)] = _Node(len(strings[first]), first)
    for i in group[1:]:
        s, node = strings[i], root
        while node.leaf < 0:
            node = node.children.get(at(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node.leaf]
        same = common(s, other, depth)
        if same == len(s) == len(other):
            twins[node.leaf].append(i)
            continue
        twins[i] = [i]
        parent, branch, node = None, None, root
        while node.leaf < 0 and node.depth < same:
            parent, branch = node, at(s, node.depth)
            node = node.children[branch]
        if node.leaf >= 0 or node.depth > same:
            fork = _Node(same)
            fork.children[at(other, same)] = node
            if parent is None:
                root = fork
            else:
                parent.children[branch] = fork
            node = fork
        node.children[at(s, same)] = _Node(len(s), i)
    order: list[int] = []
    shared: list[int] = []
    stack = [(root, depth)]
    while stack:
        node, before = stack.pop()
        if node.leaf >= 0:
            for n, i in enumerate(twins[node.leaf]):
                order.append(i)
                shared.append(len(strings[i]) if n else before)
            continue
        keys = sorted(node.children, reverse=True)
        for k in keys[:-1]:
            stack.append((node.children[k], node.depth))
        stack.append((node.children[keys[-1]], before))
    return order, shared


def deep_shallow_sort(strings: Sequence[bytes], depth: int = 0) -> tuple[list[int], list[int]]:
    """Indexes of the strings in order, and the common prefix of each with the one before (``depth`` for the first).

    All strings must share their first ``depth`` bytes.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), depth, depth)]
    while stack:
        group, at, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            shared.append(before)
            continue
        if at >= depth + SHALLOW:
            made, lengths = _blind_trie(strings, group, at)
            order += made
            shared += [before, *lengths[1:]]
            continue
        pivot = strings[group[len(group) // 2]][at : at + _STEP]
        less, same, more = [], [], []
        for i in group:
            key = strings[i][at : at + _STEP]
            (less if key < pivot else more if key > pivot else same).append(i)
        # Taken from the stack in order; what a part shares with its predecessor is set once that is known.
        parts = [(less, at), (same, at + _STEP), (more, at)]
        for part, d in reversed([p for p in parts if p[0]]):
            stack.append((part, d, -1))
        top = stack.pop()
        stack.append((top[0], top[1], before))
    for n in range(1, len(order)):
        if shared[n] < 0:
            shared[n] = common(strings[order[n - 1]], strings[order[n]], depth)
    return order, shared
