"""k-means and product codes over numpy rows: what inverted lists and quantisation fit on a bounded sample."""

from __future__ import annotations

import numpy as np


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row; the first of equal ones."""
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centres, begun at evenly spaced distinct rows."""
    centres = np.unique(x[:: max(1, len(x) // k)][:k], axis=0)
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def codebooks(x: np.ndarray, parts: int, centroids: int = 256) -> list[np.ndarray]:
    """A k-means for each of `parts` equal runs of dimensions; the last run takes what is left."""
    return [kmeans(own, centroids) for own in runs(x, parts)]


def runs(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, s * width : (s + 1) * width if s + 1 < parts else None] for s in range(parts)]


def encode(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """uint8 codes, a column a part."""
    return np.stack([nearest(own, b) for own, b in zip(runs(x, len(books)), books)], axis=1).astype("uint8")


def tables(queries: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """For each part, the products of every query with every centroid: what a code adds to a query's score."""
    return [own @ b.T for own, b in zip(runs(queries, len(books)), books)]
