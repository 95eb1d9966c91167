"""Sums of Jaccard distances over all pairs of sets, a block of sets against another at a time."""

from __future__ import annotations

import numpy as np

#: Rows of a block that are compared at once, items that are, and clusters whose weights are a dense table.
TILE, ITEMS, DENSE = 512, 2048, 32
#: What a shared item costs by lists, against an entry of a product of tables.
LIST_COST = 100


class Block:
    """Distinct sets: how many items each has, and the numbers of them, set by set. ``cells`` has, for each way of clustering,
    arrays of the places of sets, their clusters, the patterns that are in both, and all that are in the cluster."""

    def __init__(self, sizes: np.ndarray, items: np.ndarray, cells: list[tuple[np.ndarray, ...]]):
        self.n, self.sizes, self.items, self.cells = len(sizes), sizes, items, cells
        self.at = np.repeat(np.arange(self.n), sizes)


def _shared(a: Block, b: Block, start: int, stop: int) -> np.ndarray:
    """How many items sets ``start`` to ``stop`` of ``a`` have in common with each of ``b``."""
    mine = (a.at >= start) & (a.at < stop)
    items, at = a.items[mine], a.at[mine] - start
    common = np.intersect1d(items, b.items)
    mine, other = np.isin(items, common), np.isin(b.items, common)
    x, x_at, y, y_at = np.searchsorted(common, items[mine]), at[mine], np.searchsorted(common, b.items[other]), b.at[other]
    shape = (stop - start, b.n)
    per_item = np.bincount(y, minlength=len(common))
    if LIST_COST * per_item[x].sum() < shape[0] * shape[1] * len(common):
        y_at = y_at[np.argsort(y, kind="stable")]
        first = np.cumsum(per_item) - per_item
        many = per_item[x]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        met = np.repeat(x_at, many) * b.n + y_at[np.repeat(first[x], many) + inside]
        return np.bincount(met, minlength=shape[0] * shape[1]).reshape(shape).astype(float)
    out = np.zeros(shape)
    for low in range(0, len(common), ITEMS):
        wide = min(ITEMS, len(common) - low)
        left, right = np.zeros((shape[0], wide), np.float32), np.zeros((wide, shape[1]), np.float32)
        here, there = (x >= low) & (x < low + wide), (y >= low) & (y < low + wide)
        left[x_at[here], x[here] - low] = 1
        right[y[there] - low, y_at[there]] = 1
        out += left @ right
    return out


def _inside(d: np.ndarray, of_a: tuple, of_b: tuple) -> np.ndarray:
    """For each of the cells ``of_a``, the distances to all patterns of its own cluster in ``of_b``, times its count."""
    (at, cluster, count, _), (b_at, b_cluster, b_count, _) = of_a, of_b
    out = np.zeros(len(at))
    common = np.intersect1d(cluster, b_cluster)
    if not len(common):
        return out
    mine, other = np.isin(cluster, common), np.isin(b_cluster, common)
    k, b_k = np.searchsorted(common, cluster[mine]), np.searchsorted(common, b_cluster[other])
    if len(common) <= DENSE:
        weights = np.zeros((d.shape[1], len(common)))
        np.add.at(weights, (b_at[other], b_k), b_count[other])
        sums = d @ weights
    else:
        order = np.argsort(b_k, kind="stable")
        starts = np.searchsorted(b_k[order], np.arange(len(common)))
        sums = np.add.reduceat(d[:, b_at[other][order]] * b_count[other][order], starts, axis=1)
    out[mine] = sums[at[mine], k] * count[mine]
    return out


def block_sums(a: Block, b: Block) -> list[dict[str, float]]:
    """For each way of clustering, sums over the pairs of a pattern of ``a`` and one of ``b``; of one block, over all its pairs.

    d and dd sum the distances and their squares, inside those of pairs in one cluster, intra and inter the distances of
    pairs inside and across, divided by the sizes of their clusters; low and high are the least and the greatest distance.
    """
    out = [dict.fromkeys(("d", "dd", "inside", "intra", "inter"), 0.0) | {"low": np.inf, "high": -np.inf} for _ in a.cells]
    same = a is b
    half = 0.5 if same else 1.0
    for start in range(0, a.n, TILE):
        stop = min(start + TILE, a.n)
        both = _shared(a, b, start, stop)
        either = a.sizes[start:stop, None] + b.sizes - both
        d = np.where(either == 0, 0.0, 1 - both / np.maximum(either, 1))
        own = np.zeros(d.shape, bool)
        if same:
            own[np.arange(stop - start), np.arange(start, stop)] = True
            d[own] = 0.0
        for sums, way_a, way_b in zip(out, a.cells, b.cells, strict=True):
            here = (way_a[0] >= start) & (way_a[0] < stop)
            cells = (way_a[0][here] - start, *(x[here] for x in way_a[1:]))
            count = lambda c, size, by=1: np.bincount(c[0], c[2] / by, size)
            m_a, m_b = count(cells, stop - start), count(way_b, b.n)
            sums["d"] += half * float(m_a @ d @ m_b)
            sums["dd"] += half * float(m_a @ (d * d) @ m_b)
            inside, size = _inside(d, cells, way_b), cells[3]
            sums["inside"] += half * float(inside.sum())
            sums["intra"] += half * float((inside / size).sum())
            across = float(count(cells, stop - start, size) @ d @ count(way_b, b.n, way_b[3]))
            sums["inter"] += half * (across - float((inside / size / size).sum()))
            # Patterns of one set are a pair, at 0, if there are two of them.
            pairs = np.outer(m_a > 0, m_b > 0) & (~own | (m_a > 1)[:, None])
            if pairs.any():
                sums["low"], sums["high"] = min(sums["low"], float(d[pairs].min())), max(sums["high"], float(d[pairs].max()))
    return out
