"""Vectorised tile features: tiles are processed as (n, h, w) blocks of a bounded number of pixels.

Definitions are the published ones: symmetric grey-level co-occurrence, uniform local binary
patterns, Gabor magnitude, histograms of oriented gradients with clipped block norms, Haar detail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
GLCM_OFFSETS = ((0, 1), (1, 0), (0, 4), (4, 0))
LEVELS = 16
#: Side of the tiles that gradients and wavelets see, and pixels (of these or the tile's own) that a worker handles at once.
SIDE = 64
BLOCK_PIXELS = 1 << 19


def _block(px: pd.Series, h: int, w: int) -> np.ndarray:
    return np.stack([np.asarray(p, dtype=np.float64) for p in px]).reshape(-1, h, w)


def stretch(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 levels, unit values) by the 1/99 percent quantiles of each tile."""
    clean = np.where(np.isfinite(block), block, 0.0)
    flat = clean.reshape(len(block), -1)
    low, high = np.quantile(flat, [0.01, 0.99], axis=1)
    unit = np.clip((clean - low[:, None, None]) / np.maximum(high - low, 1e-8)[:, None, None], 0.0, 1.0)
    return np.rint(unit * 255.0).astype(np.uint8), unit


def intensity(block: np.ndarray) -> np.ndarray:
    v = block.reshape(len(block), -1)
    mean, sd = v.mean(axis=1), v.std(axis=1)
    d = v - mean[:, None]
    flat = v.min(axis=1) == v.max(axis=1)
    safe = np.where(flat, 1.0, sd)
    skew = np.where(flat, 0.0, (d ** 3).mean(axis=1) / safe ** 3)
    kurt = np.where(flat, 0.0, (d ** 4).mean(axis=1) / safe ** 4 - 3.0)
    return np.column_stack([mean, sd, skew, kurt, v.min(axis=1), v.max(axis=1),
                            np.quantile(v, QUANTILES, axis=1).T])


def histogram(block: np.ndarray, bins: int = 32) -> np.ndarray:
    _, unit = stretch(block)
    index = np.minimum((unit.reshape(len(block), -1) * bins).astype(np.int64), bins - 1)
    rows = np.arange(len(block))[:, None] * bins
    counts = np.bincount((index + rows).ravel(), minlength=len(block) * bins).reshape(-1, bins)
    return counts * bins / index.shape[1]


def glcm(block: np.ndarray) -> np.ndarray:
    """Contrast, dissimilarity, homogeneity, energy, correlation, each for distances 1 and 4 at 0 and 90 degrees."""
    q = (stretch(block)[0] // 16).astype(np.int64)
    n, h, w = q.shape
    i, j = np.indices((LEVELS, LEVELS))
    measures = []
    for dr, dc in GLCM_OFFSETS:
        a, b = q[:, : max(h - dr, 0), : max(w - dc, 0)], q[:, dr:, dc:]
        code = np.arange(n)[:, None, None] * LEVELS ** 2 + a * LEVELS + b
        m = np.bincount(code.ravel(), minlength=n * LEVELS ** 2).reshape(n, LEVELS, LEVELS).astype(float)
        m += m.transpose(0, 2, 1)
        p = m / np.maximum(m.sum(axis=(1, 2), keepdims=True), 1.0)
        mu = (p * i).sum(axis=(1, 2))
        var = (p * (i - mu[:, None, None]) ** 2).sum(axis=(1, 2))
        cov = (p * (i - mu[:, None, None]) * (j - mu[:, None, None])).sum(axis=(1, 2))
        measures.append(np.stack([
            (p * (i - j) ** 2).sum(axis=(1, 2)), (p * abs(i - j)).sum(axis=(1, 2)),
            (p / (1.0 + (i - j) ** 2)).sum(axis=(1, 2)), np.sqrt((p ** 2).sum(axis=(1, 2))),
            np.where(var < 1e-15, 1.0, cov / np.where(var < 1e-15, 1.0, var))]))
    return np.stack(measures, axis=2).transpose(1, 0, 2).reshape(n, -1)


def lbp(block: np.ndarray) -> np.ndarray:
    """10-bin density of uniform patterns on 16 levels, 8 neighbours at radius 1, zero outside the tile."""
    q = (stretch(block)[0] // 16).astype(float)
    n, h, w = q.shape
    padded = np.pad(q, ((0, 0), (2, 2), (2, 2)))
    bits = []
    for k in range(8):
        r, c = np.round(-np.sin(np.pi * k / 4), 5), np.round(np.cos(np.pi * k / 4), 5)
        r0, c0 = int(np.floor(r)), int(np.floor(c))
        fr, fc = r - r0, c - c0
        at = lambda dr, dc: padded[:, 2 + dr: 2 + dr + h, 2 + dc: 2 + dc + w]
        upper = at(r0, c0) * (1 - fc) + at(r0, c0 + 1) * fc
        lower = at(r0 + 1, c0) * (1 - fc) + at(r0 + 1, c0 + 1) * fc
        bits.append(upper * (1 - fr) + lower * fr - q >= -1e-9)
    bits = np.stack(bits).astype(np.int64)
    changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    # a ring change count includes the wrap; uniform patterns have at most two changes
    code = np.where(changes <= 2, bits.sum(axis=0), 9).reshape(n, -1)
    counts = np.stack([(code == c).sum(axis=1) for c in range(10)], axis=1)
    return counts / code.shape[1]


def gabor_kernel(frequency: float, theta: float) -> np.ndarray:
    sigma = np.sqrt(np.log(2) / 2) / np.pi * 3.0 / frequency  # one octave
    rx = int(np.ceil(max(abs(3 * sigma * np.cos(theta)), abs(3 * sigma * np.sin(theta)), 1)))
    y, x = np.mgrid[-rx: rx + 1, -rx: rx + 1]
    along = x * np.cos(theta) + y * np.sin(theta)
    across = -x * np.sin(theta) + y * np.cos(theta)
    return (np.exp(-0.5 * (along ** 2 + across ** 2) / sigma ** 2) / (2 * np.pi * sigma ** 2)
            * np.exp(2j * np.pi * frequency * along))


def gabor(unit: np.ndarray) -> np.ndarray:
    out = []
    for frequency in (0.10, 0.25):
        for theta in (0.0, np.pi / 4, np.pi / 2):
            kernel = gabor_kernel(frequency, theta)
            half = kernel.shape[0] // 2
            padded = np.pad(unit, ((0, 0), (half, half), (half, half)), mode="symmetric")
            shape = [padded.shape[k + 1] + kernel.shape[k] - 1 for k in (0, 1)]
            full = np.fft.ifft2(np.fft.fft2(padded, shape, axes=(1, 2)) * np.fft.fft2(kernel, shape)[None], axes=(1, 2))
            mag = np.abs(full[:, 2 * half: 2 * half + unit.shape[1], 2 * half: 2 * half + unit.shape[2]])
            out += [mag.mean(axis=(1, 2)), mag.std(axis=(1, 2))]
    return np.stack(out, axis=1)


def _axis_weights(size: int, target: int) -> np.ndarray:
    """Linear resampling matrix with pixel centres, smoothed first when shrinking.

    Places outside reflect at the edge pixel, which is not repeated: -1 reads 1, size reads size - 2.
    """
    factor = size / target
    period = max(2 * (size - 1), 1)

    def mirror(k):
        k = np.abs(k) % period
        return np.where(k >= size, period - k, k)

    smooth = np.eye(size)
    sigma = max(0.0, (factor - 1) / 2)
    if sigma > 0:
        reach = int(4 * sigma + 0.5)
        taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        smooth = np.zeros((size, size))
        for off, wt in zip(range(-reach, reach + 1), taps / taps.sum()):
            np.add.at(smooth, (np.arange(size), mirror(np.arange(size) + off)), wt)
    centre = (np.arange(target) + 0.5) * factor - 0.5
    base = np.floor(centre).astype(int)
    frac = centre - base
    pick = np.zeros((target, size))
    np.add.at(pick, (np.arange(target), mirror(base)), 1 - frac)
    np.add.at(pick, (np.arange(target), mirror(base + 1)), frac)
    return pick @ smooth


def resize(unit: np.ndarray, target: int = SIDE) -> np.ndarray:
    rows, cols = _axis_weights(unit.shape[1], target), _axis_weights(unit.shape[2], target)
    return rows @ unit @ cols.T


def hog(image: np.ndarray, bins: int = 9, cell: int = 8) -> np.ndarray:
    gr, gc = np.zeros_like(image), np.zeros_like(image)
    gr[:, 1:-1] = image[:, 2:] - image[:, :-2]
    gc[:, :, 1:-1] = image[:, :, 2:] - image[:, :, :-2]
    mag = np.hypot(gr, gc)
    angle = np.rad2deg(np.arctan2(gr, gc)) % 180
    which = np.minimum((angle / (180 / bins)).astype(int), bins - 1)
    n, side = len(image), image.shape[1] // cell
    cells = np.stack([np.where(which == b, mag, 0.0).reshape(n, side, cell, side, cell).mean(axis=(2, 4))
                      for b in range(bins)], axis=-1)
    blocks = np.stack([cells[:, r: side - 1 + r, c: side - 1 + c] for r in (0, 1) for c in (0, 1)], axis=3)
    flat = blocks.reshape(n, side - 1, side - 1, -1)
    unit = lambda v: v / np.sqrt((v ** 2).sum(axis=-1, keepdims=True) + 1e-10)
    return unit(np.minimum(unit(flat), 0.2)).reshape(n, -1)


def haar(image: np.ndarray) -> np.ndarray:
    stats = lambda v: [np.abs(v).mean(axis=(1, 2)), v.std(axis=(1, 2))]
    details, approx = [], image
    for _ in range(2):
        a, b = approx[:, ::2, ::2], approx[:, ::2, 1::2]
        c, d = approx[:, 1::2, ::2], approx[:, 1::2, 1::2]
        approx = (a + b + c + d) / 2
        details.insert(0, [(a + b - c - d) / 2, (a - b + c - d) / 2, (a - b - c + d) / 2])
    out = stats(approx)
    for level in details:
        for part in level:
            out += stats(part)
    return np.stack(out, axis=1)


def gradient_textures(block: np.ndarray) -> np.ndarray:
    """Gabor, oriented-gradient and wavelet features of the stretched tile."""
    _, unit = stretch(block)
    small = resize(unit)
    return np.hstack([gabor(unit), hog(small), haar(small)])


def classical(block: np.ndarray) -> np.ndarray:
    _, unit = stretch(block)
    small = resize(unit)
    return np.hstack([intensity(block), histogram(block), glcm(block), lbp(block), gabor(unit), hog(small),
                      haar(small)])


_KINDS = {"intensity": intensity, "histogram": histogram, "glcm": glcm, "lbp": lbp,
          "texture": gradient_textures, "classical": classical}


def tile_features(px: str, h: int, w: int, kind: str) -> Column:
    """Feature array per tile; ``kind`` is one of intensity, histogram, glcm, lbp, texture, classical.

    Some kinds hold dozens of arrays as large as the resized block, so a batch is cut into blocks of BLOCK_PIXELS
    whose features leave before the next block comes.
    """
    compute = _KINDS[kind]
    step = max(1, BLOCK_PIXELS // max(h * w, SIDE * SIDE))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            for at in range(0, len(values), step):
                yield pd.Series(list(compute(_block(values.iloc[at: at + step], h, w))), dtype=object)

    return run(F.col(px))
