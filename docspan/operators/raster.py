"""Page images (grey levels as arrays) to ink regions, in numpy: masks, components, kinds, strikes and skew.

Pages come as rows (page_key, page, width, height, pixels: grey bytes row by row). A page is one row and is
worked on by itself, so pages spread over tasks by count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STRICT, LOOSE = 150, 225


def flatten(grey: np.ndarray, tile: int = 64) -> np.ndarray:
    """Divide by the background (bright percentile by tile) and stretch to 0..255."""
    h, w = grey.shape
    ys, xs = np.linspace(0, h, max(1, h // tile) + 1).astype(int), np.linspace(0, w, max(1, w // tile) + 1).astype(int)
    background = np.empty(grey.shape)
    for a, b in zip(ys, ys[1:]):
        for c, d in zip(xs, xs[1:]):
            background[a:b, c:d] = max(np.percentile(grey[a:b, c:d], 90), 1)
    even = np.clip(grey / background, 0, 1)
    low, high = np.percentile(even, (1, 99.5))
    return (np.clip((even - low) / max(high - low, 1e-6), 0, 1) * 255).astype(np.uint8)


def masks(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strict, loose) ink masks; single pixels are dropped from the loose one."""
    flat = flatten(grey)
    strict, loose = flat < STRICT, flat < LOOSE
    p = np.pad(loose, 1)
    near = p[:-2, 1:-1].astype(int) + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    return strict, loose & (near > 0)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (0: none) of 8-connected components, by runs of rows and union-find."""
    h, w = mask.shape
    padded = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(padded, axis=1)
    rows, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:  # touching, corners included
                parent[root(j)] = root(i)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(rows))], np.int64)
    names = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), np.int64)
    for y, a, b, name in zip(rows, starts, ends, names):
        out[y, a:b] = name
    return out


def kind_of(pixels: int, box_area: int, page_area: int, strict_share: float, border: bool, aspect: float) -> str:
    ratio = pixels / max(box_area, 1)
    if pixels < 12 or (border and box_area > 0.25 * page_area) or aspect > 40 or aspect < 0.025:
        return "noise"
    return "bleed" if strict_share < 0.15 else "noise" if ratio < 0.02 else "writing"


def has_strike(ink: np.ndarray) -> bool:
    """A run of 60 % of the width in the middle half."""
    h, w = ink.shape
    need = max(1, int(0.6 * w))
    for row in ink[h // 4 : max(h // 4 + 1, h - h // 4)]:
        p = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        if len(p) and (p[1::2] - p[::2]).max() >= need:
            return True
    return False


def find_regions(grey: np.ndarray) -> list[dict]:
    """Ink regions of a page, from the largest component down to specks, with boxes as shares of the page."""
    strict, loose = masks(grey)
    labels = components(loose)
    h, w = grey.shape
    out = []
    if not labels.max():
        return out
    ys, xs = np.nonzero(labels)
    names = labels[ys, xs]
    n = labels.max() + 1
    low_y, low_x, high_y, high_x = np.full(n, h), np.full(n, w), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(low_y, names, ys)
    np.minimum.at(low_x, names, xs)
    np.maximum.at(high_y, names, ys + 1)
    np.maximum.at(high_x, names, xs + 1)
    pixels, dark = np.bincount(names, minlength=n), np.bincount(names, weights=strict[ys, xs], minlength=n)
    for i in range(1, n):
        bh, bw = high_y[i] - low_y[i], high_x[i] - low_x[i]
        border = low_y[i] == 0 or low_x[i] == 0 or high_y[i] == h or high_x[i] == w
        kind = kind_of(int(pixels[i]), int(bh * bw), h * w, dark[i] / pixels[i], bool(border), bw / bh)
        crop = labels[low_y[i] : high_y[i], low_x[i] : high_x[i]] == i
        out.append({"x0": float(low_x[i] / w), "y0": float(low_y[i] / h), "x1": float(high_x[i] / w), "y1": float(high_y[i] / h), "kind": kind, "pixel_count": int(pixels[i]), "ink_ratio": float(pixels[i] / (bh * bw)), "has_strike": bool(kind == "writing" and bw > 3 * bh and has_strike(crop & strict[low_y[i] : high_y[i], low_x[i] : high_x[i]]))})
    return sorted(out, key=lambda r: -r["pixel_count"])


def stroke_height(mask: np.ndarray) -> float:
    """75th percentile of the heights of components."""
    labels = components(mask)
    ys, xs = np.nonzero(labels)
    if not len(ys):
        return 0.0
    low, high = np.full(labels.max() + 1, mask.shape[0]), np.zeros(labels.max() + 1, int)
    np.minimum.at(low, labels[ys, xs], ys)
    np.maximum.at(high, labels[ys, xs], ys + 1)
    return float(np.percentile((high - low)[1:], 75))


def skew_angle(mask: np.ndarray, limit: float = 8.0, step: float = 0.25) -> float:
    """The shear, in degrees, whose row sums differ most from row to row."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return 0.0
    best, angle = -1.0, 0.0
    for a in np.arange(-limit, limit + step / 2, step):
        rows = np.round(ys - xs * np.tan(np.radians(a))).astype(int)
        sums = np.bincount(rows - rows.min())
        score = float(np.var(np.diff(sums))) if len(sums) > 1 else 0.0
        if score > best + 1e-9 or (abs(score - best) <= 1e-9 and abs(a) < abs(angle)):
            best, angle = score, float(a)
    return angle


def crop(grey: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    h, w = grey.shape
    return grey[int(y0 * h) : max(int(np.ceil(y1 * h)), int(y0 * h) + 1), int(x0 * w) : max(int(np.ceil(x1 * w)), int(x0 * w) + 1)]


def ink_regions(pages: DataFrame) -> DataFrame:
    """page_key, page, region, box, kind, pixel_count, ink_ratio, has_strike, skew of every page."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, page, w, h, pixels in zip(pdf["page_key"], pdf["page"], pdf["width"], pdf["height"], pdf["pixels"]):
                grey = np.frombuffer(pixels, np.uint8).reshape(h, w)
                skew = skew_angle(masks(grey)[0])
                rows = [{"page_key": key, "page": page, "region": i, "skew": skew, **r} for i, r in enumerate(find_regions(grey))]
                yield pd.DataFrame(rows, columns=["page_key", "page", "region", "x0", "y0", "x1", "y1", "kind", "pixel_count", "ink_ratio", "has_strike", "skew"])

    return pages.select("page_key", "page", "width", "height", "pixels").mapInPandas(per_batch, "page_key string, page int, region int, x0 double, y0 double, x1 double, y1 double, kind string, pixel_count long, ink_ratio double, has_strike boolean, skew double")
