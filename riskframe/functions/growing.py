"""Trees grown in one task over binned cells: sums by node, feature and bin, level by level."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import cloudpickle

# Ship these helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOM = 2**22  # sums of one kind that are held at once; more nodes are taken in parts
JOINT = 256  # bins of several narrow features that are counted as one

# (feature or -1, at, missing_left, gain, a and b of the left side), an array each, of all nodes with the given sums
Choose = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def _packs(widths: Sequence[int]) -> list[list[int]]:
    """Features whose bins are counted jointly, so that a cell is added once for all of them."""
    packs: list[list[int]] = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        for pack in packs:
            if np.prod([widths[i] for i in (*pack, j)]) <= JOINT:
                pack.append(j)
                break
        else:
            packs.append([j])
    return packs


def _add(sums: np.ndarray, slots: np.ndarray, shape: Sequence[int], pack: Sequence[int], key: np.ndarray, x: np.ndarray) -> None:
    """Sums of x by node and bin of every feature of a pack; key counts the joint bins node after node."""
    joint = np.bincount(key, x, len(sums) * int(np.prod(shape))).reshape(len(sums), *shape)
    for i, j in enumerate(pack, 1):
        sums[:, slots[j]:slots[j + 1]] = joint.sum(tuple(a for a in range(1, len(pack) + 1) if a != i))


def grow(bins: np.ndarray, widths: Sequence[int], a: np.ndarray, b: np.ndarray, depth: int, choose: Choose
         ) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A tree over cells with the sums a and b, and the leaf of every cell.

    bins is features x cells, bin 0 is a missing value. Nodes are in order of creation, the children of a node side by
    side (`left` and the next); feature -1 marks a leaf, bins up to `at` go left.
    """
    slots = np.cumsum([0, *widths])
    part = max(1, ROOM // max(int(slots[-1]), JOINT))
    packs = _packs(widths)
    codes = [np.ravel_multi_index([bins[j] for j in pack], [widths[j] for j in pack]) for pack in packs]
    alone = [[j] for j in range(len(widths))]
    node, live = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    start, count = 0, 1
    levels = [[np.array([x.sum()]) for x in (a, b)]]
    splits = []
    for _ in range(depth):
        number = node[live] - start
        found: list[list[np.ndarray]] = []
        for low in range(0, count, part):
            some = min(part, count - low)
            at = slice(None) if some == count else np.flatnonzero((number >= low) & (number < low + some))
            rows, own = live[at], number[at] - low
            mine = [x[rows] for x in (a, b)]
            sums = np.empty((2, some, slots[-1]))
            joint = len(rows) > JOINT * some  # worth the wider sums
            for pack, code in zip(packs, codes) if joint else zip(alone, bins):
                shape = [widths[j] for j in pack]
                key = own * int(np.prod(shape)) + code[rows]
                for i, x in enumerate(mine):
                    _add(sums[i], slots, shape, pack, key, x)
            found.append(choose(*sums))
        feature, at, missing, gain, al, bl = (np.concatenate(x) for x in zip(*found))
        inner = np.flatnonzero(feature >= 0)
        left = np.full(count, -1)
        left[inner] = start + count + 2 * np.arange(len(inner))
        splits.append([feature, at, missing, gain, left])
        if not len(inner):
            break
        levels.append([np.stack([s[inner], whole[inner] - s[inner]], 1).ravel() for s, whole in zip((al, bl), levels[-1])])
        going = feature[number] >= 0
        live, number = live[going], number[going]
        x = bins[feature[number], live]
        goes_left = np.where(x == 0, missing[number], x <= at[number])
        node[live] = left[number] + ~goes_left
        start, count = start + count, 2 * len(inner)
    else:  # the last nodes are leaves
        splits.append([np.full(count, -1), np.zeros(count, np.int64), np.ones(count, bool), np.zeros(count), np.full(count, -1)])
    names = ("feature", "at", "missing_left", "gain", "left")
    out = {n: np.concatenate(x) for n, x in zip(names, zip(*splits))}
    out["a"], out["b"] = (np.concatenate(x) for x in zip(*levels))
    return out, node


def best_of(a: np.ndarray, b: np.ndarray, widths: Sequence[int], gain: Callable, least: float) -> tuple[np.ndarray, ...]:
    """The best split of every node (rows of a and b) by gain(al, bl, a, b); earlier features, missing values on the left
    and lower bins win ties."""
    count, first = len(a), 0
    feature, at, missing = np.full(count, -1), np.zeros(count, np.int64), np.ones(count, bool)
    best, al, bl = np.full(count, least), np.zeros(count), np.zeros(count)
    for j, width in enumerate(widths):
        mine, other = a[:, first:first + width], b[:, first:first + width]
        first += width
        if width < 3:
            continue
        whole, size = mine.sum(1, keepdims=True), other.sum(1, keepdims=True)
        x, y = np.cumsum(mine[:, 1:], 1)[:, :-1], np.cumsum(other[:, 1:], 1)[:, :-1]
        lacking = other[:, 0] > 0
        for missing_left in (True, False) if lacking.any() else (True,):
            u, v = (x + mine[:, :1], y + other[:, :1]) if missing_left else (x, y)
            got = gain(u, v, whole, size)
            if not missing_left:
                got[~lacking] = -np.inf
            i = np.argmax(got, 1)
            top = got[np.arange(count), i]
            better = np.flatnonzero(top > best)
            k = i[better]
            feature[better], at[better], missing[better], best[better] = j, k + 1, missing_left, top[better]
            al[better], bl[better] = u[better, k], v[better, k]
    return feature, at, missing, np.where(feature >= 0, best, 0.0), al, bl
