"""Weight tables of the linear image operators, one axis at a time.

Box mean and resize are separable: the image is multiplied along y and along x by a small matrix
that depends on the side lengths only.  Row ``dst`` of a matrix lists how much every source pixel
contributes.  The border rules are

* box mean: reflection about the edge (``d c b a | a b c d | d c b a``)
* resize: reflection about the edge pixel (``d c b | a b c d | c b a``), a Gaussian with
  ``sigma = max(0, (n_in / n_out - 1) / 2)`` cut at four sigma, then linear interpolation at the
  pixel centres ``(i + 0.5) * n_in / n_out - 0.5``
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def reflect_edge(k: np.ndarray, n: int) -> np.ndarray:
    """Source pixel of position ``k`` with the edge pixel repeated."""
    m = np.mod(k, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def reflect_pixel(k: np.ndarray, n: int) -> np.ndarray:
    """Source pixel of position ``k`` without repeating the edge pixel."""
    if n == 1:
        return np.zeros_like(k)
    m = np.mod(k, 2 * n - 2)
    return np.where(m < n, m, 2 * n - 2 - m)


def window_span(window: int) -> tuple[int, int]:
    """Pixels before and after the centre; an even window leans to the left."""
    if window < 1:
        raise ValueError("window must be at least 1")
    return window // 2, window - window // 2 - 1


@lru_cache(maxsize=64)
def box_matrix(n: int, window: int) -> np.ndarray:
    """(n, n) matrix of the box mean."""
    before, after = window_span(window)
    matrix = np.zeros((n, n))
    rows = np.arange(n)
    for shift in range(-before, after + 1):
        np.add.at(matrix, (rows, reflect_edge(rows + shift, n)), 1.0 / window)
    return matrix


def _resize_taps(n_in: int, n_out: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source pixels and weights of some output pixels, one line each: two corners, smoothed."""
    factor = n_in / n_out
    sigma = max(0.0, (factor - 1.0) / 2.0)
    radius = int(4.0 * sigma + 0.5)
    steps = np.arange(-radius, radius + 1)
    bell = np.exp(-0.5 * (steps / sigma) ** 2) if sigma > 0 else np.ones(1)
    bell = bell / bell.sum()
    centre = (rows + 0.5) * factor - 0.5
    low = np.floor(centre).astype(int)
    share = centre - low
    sources, weights = [], []
    for corner, part in ((low, 1.0 - share), (low + 1, share)):
        sources.append(reflect_pixel(reflect_pixel(corner, n_in)[:, None] + steps, n_in))
        weights.append(bell * part[:, None])
    return np.concatenate(sources, axis=1), np.concatenate(weights, axis=1)


@lru_cache(maxsize=64)
def resize_matrix(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) matrix of smoothing followed by linear interpolation."""
    rows = np.arange(n_out)
    matrix = np.zeros((n_out, n_in))
    sources, weights = _resize_taps(n_in, n_out, rows)
    np.add.at(matrix, (rows[:, None], sources), weights)
    return matrix


@lru_cache(maxsize=64)
def resize_bands(n_in: int, n_out: int, block: int = 16) -> list[tuple[int, int, int, int, np.ndarray]]:
    """The same weights as bands ``(first row, end, first source, end, weights)``: ``block`` output pixels with the sources they use.

    Together they hold a few numbers for each source pixel, whatever the number of output pixels.
    """
    bands = []
    for first in range(0, n_out, block):
        rows = np.arange(first, min(n_out, first + block))
        sources, weights = _resize_taps(n_in, n_out, rows)
        low, high = int(sources.min()), int(sources.max()) + 1
        band = np.zeros((len(rows), high - low))
        np.add.at(band, (rows[:, None] - first, sources - low), weights)
        bands.append((first, first + len(rows), low, high, band))
    return bands


def nonzero(matrix: np.ndarray) -> list[tuple[int, int, float]]:
    """``(dst, src, weight)`` entries of a matrix."""
    return [(int(d), int(s), float(matrix[d, s])) for d, s in zip(*np.nonzero(matrix), strict=True)]
