"""Dense image kernels in numpy: silhouettes, derotation, measurement, and drawing of synthetic threads.

They run inside Arrow batches, one image at a time; everything after the width signal is DataFrame work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from plumbline.operators.signal import ESTIMATORS, HEAD_MARGIN

#: The 5 x 5 elliptic structuring element, the smoothing kernels of 5 and 7 taps, and the parts of a pixel that turning tells apart.
ELLIPSE_5 = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], dtype=bool)
SMOOTH_5 = np.array([1, 4, 6, 4, 1]) / 16.0
SMOOTH_7 = np.array([2, 7, 14, 18, 14, 7, 2]) / 64.0
PIXEL_PARTS = 32
#: Rows that are turned in one pass, few enough for a core's cache.
ROWS_AT_ONCE = 32


class MeasurementError(RuntimeError):
    """An image that can't be measured."""


def gaussian_kernel(size: int) -> np.ndarray:
    """Taps of a Gaussian whose width follows its size; those of five and seven taps are the fixed kernels."""
    if size in (5, 7):
        return SMOOTH_5 if size == 5 else SMOOTH_7
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def smooth(image: np.ndarray, size: int = 5) -> np.ndarray:
    """Separable Gaussian blur with mirrored borders (the edge itself isn't repeated); halves are rounded up."""
    r = size // 2
    if size in (5, 7):  # taps are parts of 16 or 64, so whole numbers give the same
        whole = 16 if size == 5 else 64
        taps = (gaussian_kernel(size) * whole).astype(int).tolist()
        x = np.pad(image.astype(np.uint16 if size == 5 else np.uint32), r, mode="reflect")
        x = sum(t * x[i : i + image.shape[0]] for i, t in enumerate(taps))
        x = sum(t * x[:, i : i + image.shape[1]] for i, t in enumerate(taps))
        return ((x + whole * whole // 2) // (whole * whole)).astype(np.uint8)
    taps = gaussian_kernel(size)
    x = np.pad(image.astype(float), r, mode="reflect")
    x = sum(t * x[i : i + image.shape[0]] for i, t in enumerate(taps))
    x = sum(t * x[:, i : i + image.shape[1]] for i, t in enumerate(taps))
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The grey level that maximises the variance between the pixels up to it and the rest; the first of equals."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below = np.cumsum(n)
    total = np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nan_to_num(between, nan=0.0, posinf=0.0).argmax())


def _shifted(mask: np.ndarray, element: np.ndarray, outside: bool) -> list[np.ndarray]:
    r = element.shape[0] // 2
    x = np.pad(mask, r, constant_values=outside)
    return [x[i : i + mask.shape[0], j : j + mask.shape[1]] for i, j in zip(*np.nonzero(element), strict=True)]


def dilate(mask: np.ndarray, element: np.ndarray = ELLIPSE_5) -> np.ndarray:
    return np.logical_or.reduce(_shifted(mask, element, False))


def erode(mask: np.ndarray, element: np.ndarray = ELLIPSE_5) -> np.ndarray:
    return np.logical_and.reduce(_shifted(mask, element, True))


def label_regions(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Connected regions, numbered from 1: runs of each row are joined with the runs they touch in the row above."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begin = np.nonzero(edge == 1)
    first = np.searchsorted(rows, np.arange(h + 1)).tolist()
    begin, end = begin.tolist(), np.nonzero(edge == -1)[1].tolist()
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    for y in range(1, h):
        above, here = first[y - 1], first[y]
        while above < first[y] and here < first[y + 1]:
            if begin[here] < end[above] + reach and begin[above] < end[here] + reach:
                a, b = root(above), root(here)
                parent[max(a, b)] = min(a, b)
            if end[above] < end[here]:
                above += 1
            else:
                here += 1
    roots = [root(i) for i in range(len(rows))]
    number = {r: k + 1 for k, r in enumerate(sorted(set(roots)))}
    out = np.zeros((h, w), dtype=np.int32)
    for y, a, b, r in zip(rows.tolist(), begin, end, roots, strict=True):
        out[y, a:b] = number[r]
    return out, len(number)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with the background that doesn't reach the border."""
    regions, _ = label_regions(~np.pad(mask, 1), diagonal=False)
    return (regions != regions[0, 0])[1:-1, 1:-1]


def silhouette(gray: np.ndarray) -> np.ndarray:
    """The largest filled region of the smoothed image's minority class, after opening and closing.

    Of equally large regions the first from the top.  No region is an error.
    """
    g = smooth(gray)
    mask = g > otsu(g)
    if mask.sum() > mask.size // 2:
        mask = ~mask
    mask = dilate(erode(mask))
    mask = erode(dilate(mask))
    regions, n = label_regions(mask, diagonal=True)
    if not n:
        raise MeasurementError("no foreground contour found")
    best, area = None, -1
    for k in range(1, n + 1):
        own = regions == k
        ys, xs = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
        y0, y1, x0, x1 = ys[0], ys[-1] + 1, xs[0], xs[-1] + 1
        filled = fill_holes(own[y0:y1, x0:x1])
        if filled.sum() > area:
            area = int(filled.sum())
            best = np.zeros_like(mask)
            best[y0:y1, x0:x1] = filled
    return best


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, width and height of the foreground."""
    ys, xs = np.nonzero(mask)
    return int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1


@dataclass(frozen=True)
class Axis:
    cx: float
    cy: float
    angle_deg: float
    length: float


def principal_axis(mask: np.ndarray) -> Axis:
    """The long axis; of its two directions the one from -45 to 135 degrees, so a part that stands is not turned upside down."""
    ys, xs = np.nonzero(mask)
    if len(xs) < 10:
        raise MeasurementError("too few foreground pixels to estimate axis")
    cx, cy = xs.mean(), ys.mean()
    dx, dy = xs - cx, ys - cy
    angle = 0.5 * math.atan2(2 * (dx * dy).mean(), (dx * dx).mean() - (dy * dy).mean())
    if angle < -math.pi / 4:
        angle += math.pi
    along = dx * math.cos(angle) + dy * math.sin(angle)
    return Axis(float(cx), float(cy), math.degrees(angle), float(np.ptp(along)))


def rotate(image: np.ndarray, centre: tuple[float, float], degrees: float, size: tuple[int, int] | None = None) -> np.ndarray:
    """The image turned about a point (counter-clockwise as seen), bilinear, black outside.

    Where a pixel comes from is told to 1/32 of a pixel, so an edge that falls between two pixels counts for both in some rows.
    size: height and width to keep; otherwise the canvas grows to hold all of it.
    """
    h, w = image.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cx, cy = centre
    ahead = np.array([[c, s, (1 - c) * cx - s * cy], [-s, c, s * cx + (1 - c) * cy]])
    if size is None:
        corners = ahead @ np.array([[0, w, w, 0], [0, 0, h, h], [1, 1, 1, 1]], dtype=float)
        low, high = corners.min(axis=1), corners.max(axis=1)
        size = math.ceil(high[1] - low[1]), math.ceil(high[0] - low[0])
        ahead[:, 2] -= low
    out = np.zeros(size, dtype=np.uint8)
    rows, columns = np.flatnonzero(image.any(axis=1)), np.flatnonzero(image.any(axis=0))
    if not rows.size:
        return out
    # what isn't black comes from here, and nothing else need be turned
    left, right, top, bottom = columns[0] - 2, columns[-1] + 2, rows[0] - 2, rows[-1] + 2
    reached = ahead @ np.array([[left, right, right, left], [top, top, bottom, bottom], [1, 1, 1, 1]], dtype=float)
    (u0, v0), (u1, v1) = np.floor(reached.min(axis=1)).astype(int) - 1, np.ceil(reached.max(axis=1)).astype(int) + 2
    u0, v0, u1, v1 = max(u0, 0), max(v0, 0), min(u1, size[1]), min(v1, size[0])
    if u0 >= u1 or v0 >= v1:
        return out
    back = np.linalg.inv(ahead[:, :2])
    xs, ys = np.arange(u0, u1) - ahead[0, 2], np.arange(v0, v1)[:, None] - ahead[1, 2]
    framed = np.pad(image, 2)
    for at in range(0, v1 - v0, ROWS_AT_ONCE):
        some = ys[at : at + ROWS_AT_ONCE]
        px, py = (np.floor((back[i, 0] * xs + back[i, 1] * some) * PIXEL_PARTS + 0.5) / PIXEL_PARTS for i in (0, 1))
        x0, y0 = np.floor(px), np.floor(py)
        fx, fy = px - x0, py - y0
        place = (np.clip(y0, -2, h).astype(np.int32) + 2) * (w + 4) + (np.clip(x0, -2, w).astype(np.int32) + 2)
        flat, less = framed.ravel(), 1 - fx
        upper = flat.take(place) * less + flat.take(place + 1) * fx
        lower = flat.take(place + w + 4) * less + flat.take(place + w + 5) * fx
        out[v0 + at : v0 + at + len(some), u0:u1] = np.floor(upper * (1 - fy) + lower * fy + 0.5)
    return out


def derotate(mask: np.ndarray, axis: Axis) -> np.ndarray:
    """The mask turned so that its axis is vertical."""
    return rotate(mask.astype(np.uint8) * 255, (axis.cx, axis.cy), axis.angle_deg - 90) > 127


def widths(gray: np.ndarray) -> np.ndarray:
    """Foreground pixels in each row of the upright silhouette: the signal that all else derives from."""
    mask = silhouette(gray)
    return derotate(mask, principal_axis(mask)).sum(axis=1).astype(float)


def thread_rows(v: np.ndarray, margin: float = HEAD_MARGIN) -> tuple[int, int]:
    """The rows that signal.thread_region gives: the margin comes off the end that the widest row is nearer to."""
    rows = np.flatnonzero(v)
    if not rows.size:
        raise MeasurementError("width profile has no foreground")
    first, stop, widest = int(rows[0]), int(rows[-1]) + 1, int(np.argmax(v))
    length = stop - first
    off = min(round(length * margin), length - 1)
    if length - off < max(10, int(0.2 * length)):
        return first, stop
    return (first + off, stop) if widest - first <= stop - widest else (first, stop - off)


def measure(gray: np.ndarray, estimator: str = "peak", margin: float = HEAD_MARGIN) -> dict:
    """Diameter and pitch in pixels, confidence and notes of one image."""
    v = widths(gray)
    a, b = thread_rows(v, margin)
    pitch, confidence, method, notes = ESTIMATORS[estimator](v[a:b])
    if pitch is None:
        notes = [*notes, "pitch could not be reliably estimated for this image"]
    return {"major_diameter_px": float(v[a:b].max()), "pitch_px": pitch, "confidence": confidence, "method": method, "notes": notes}


def min_max_bytes(values: np.ndarray) -> np.ndarray:
    """Values from their least to their greatest as 0 to 255, cut down; constant values as 0.  Of a stack, each by itself."""
    axes = tuple(range(-min(values.ndim, 2), 0))
    x = values - values.min(axis=axes, keepdims=True)
    top = x.max(axis=axes, keepdims=True)
    return (np.where(top > 0, x / np.where(top > 0, top, 1), x) * 255).astype(np.uint8)


def jet(levels: np.ndarray) -> np.ndarray:
    """Levels 0 to 255 as blue-green-yellow-red RGB: three ramps, a quarter of the range apart."""
    x = levels / 255.0
    return np.stack([np.clip(1.5 - np.abs(4 * x - c), 0, 1) for c in (3, 2, 1)], axis=-1) * 255


def blend(gray: np.ndarray, heatmap: np.ndarray, alpha: float) -> np.ndarray:
    """The image, or each of a stack, under its heatmap's colours."""
    rgb = gray[..., None].astype(float)
    return np.clip(np.rint(rgb * (1 - alpha) + jet(min_max_bytes(heatmap)) * alpha), 0, 255).astype(np.uint8)


def normalised_input(gray: np.ndarray, size: int = 224) -> np.ndarray:
    """Three channels of the resized image, or of each of a stack, scaled and shifted by the fixed channel means and deviations."""
    from plumbline.operators.vectors import resize_map

    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])  # fixed values
    x = resize_map(gray.astype(float) / 255.0, size, size)
    return ((x[..., None, :, :] - mean[:, None, None]) / deviation[:, None, None]).astype(np.float32)
