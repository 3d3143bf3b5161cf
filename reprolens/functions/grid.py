"""Map grids: unit positions, adjacency and hop distances. Grids are small (units are
the rows of a codebook), so these are numpy tables that plans broadcast."""

from __future__ import annotations

from collections import deque

import numpy as np


def points(xdim: int, ydim: int, topology: str = "hexagonal") -> np.ndarray:
    """Positions of the units, x fastest. Hexagonal rows are sqrt(3)/2 apart and every
    other one, from the first, is shifted by half a unit."""
    y, x = np.divmod(np.arange(xdim * ydim), xdim)
    if topology == "rectangular":
        return np.column_stack([x + 1.0, y + 1.0])
    return np.column_stack([x + 1.0 + 0.5 * (y % 2 == 0), (y + 1.0) * np.sqrt(0.75)])


def distances(xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False) -> np.ndarray:
    """Unit distances: Chebyshev on rectangular grids, Euclidean on hexagonal ones."""
    p = points(xdim, ydim, topology)
    gap = np.abs(p[:, None, :] - p[None, :, :])
    if toroidal:
        span = np.array([xdim, ydim * (1.0 if topology == "rectangular" else np.sqrt(0.75))])
        gap = np.minimum(gap, np.abs(span - gap))
    return gap.max(2) if topology == "rectangular" else np.sqrt((gap**2).sum(2))


def adjacency(xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False) -> np.ndarray:
    """Units within the smallest distance of the grid without wrapping."""
    flat = distances(xdim, ydim, topology)
    edge = flat[flat > 1e-12].min()
    d = distances(xdim, ydim, topology, toroidal)
    return (d > 0) & (d <= edge * (1 + 1e-8))


def hops(xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False) -> np.ndarray:
    """Fewest steps between units; ValueError if the grid is not connected."""
    near = adjacency(xdim, ydim, topology, toroidal)
    n = len(near)
    out = np.full((n, n), -1, np.int64)
    neighbours = [np.flatnonzero(r).tolist() for r in near]
    for start in range(n):
        out[start, start] = 0
        queue = deque([start])
        while queue:
            u = queue.popleft()
            for v in neighbours[u]:
                if out[start, v] < 0:
                    out[start, v] = out[start, u] + 1
                    queue.append(v)
    if (out < 0).any():
        raise ValueError("the map grid is not connected")
    return out


def hop_rows(xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False) -> list[tuple[int, int, int]]:
    """(unit, other, hops) with units numbered from 1."""
    h = hops(xdim, ydim, topology, toroidal)
    return [(i + 1, j + 1, int(h[i, j])) for i in range(len(h)) for j in range(len(h))]


def hexagon(x: float, y: float) -> list[tuple[float, float]]:
    """Corners of the cell around a hexagonal unit."""
    angle = np.pi / 6 + np.arange(6) * np.pi / 3
    r = 1 / np.sqrt(3)
    return [(float(x + r * np.cos(a)), float(y + r * np.sin(a))) for a in angle]
