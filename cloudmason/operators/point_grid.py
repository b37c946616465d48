"""Points on a grid, as whole arrays: neighbouring cells, pairs of points and connected components within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Candidate pairs held in memory at a time.
PAIRS = 1_500_000

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member index of each node's component: hooking and pointer jumping on whole arrays."""
    label = np.arange(n) if label is None else label
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        if not len(u):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
    return label


class Cells:
    """Points sorted by group and grid cell; a cell's number is a wrapping sum, so a neighbour cell's is one addition away."""

    def __init__(self, group: np.ndarray, xyz: np.ndarray, side: float):
        cell = np.floor(xyz / side).astype(np.int64).astype(np.uint64)
        self.number = group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (cell * _STEP).sum(1, dtype=np.uint64)
        self.order = np.argsort(self.number, kind="stable")
        number = self.number[self.order]
        self.start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, int)
        self.count = np.diff(np.r_[self.start, len(number)])
        self.unique = number[self.start]

    def matches(self, offset: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of cells (their positions) that lie at the offset from each other."""
        want = self.unique + (np.array(offset, np.int64).astype(np.uint64) * _STEP).sum(dtype=np.uint64)
        at = np.searchsorted(self.unique, want)
        at[at == len(self.unique)] = 0
        hit = self.unique[at] == want
        return np.flatnonzero(hit), at[hit]


# The 13 cells after a cell, nearest first; with the cell itself they give every pair of neighbouring cells once.
FORWARD = sorted([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)], key=lambda o: sum(map(abs, o)))


def distance2(xyz: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = xyz[u] - xyz[v]
    return np.einsum("ij,ij->i", d, d)


def point_pairs(cells: Cells, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of points of paired cells, as positions in the order; a crowded pair of cells comes in parts."""
    total = int(sizes.sum())
    for at in range(0, total, 4 * PAIRS):
        k = np.arange(at, min(total, at + 4 * PAIRS))
        owner = np.searchsorted(np.cumsum(sizes), k, "right")
        k = k - (np.cumsum(sizes) - sizes)[owner]
        nb = cells.count[b[owner]]
        yield cells.start[a[owner]] + k // nb, cells.start[b[owner]] + k % nb
