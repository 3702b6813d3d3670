"""Numpy kernels over single rasters, called from Arrow functions. Masks are boolean arrays (height, width), maps are floats in 0..1.

Conventions: connectivity is 8; morphology is neutral at the image's edge (pixels outside change nothing) unless said otherwise;
distances are exact Euclidean; ties go to the first pixel in row-major order; rounding is half to even.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

EPS = np.spacing(1)


# resizing -----------------------------------------------------------------------------------------------------------------


def resize_bilinear(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Half-pixel centres, edges clamped, no antialiasing."""
    a = np.asarray(a, np.float64)

    def axis(n_in: int, n_out: int):
        p = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(p).astype(int)
        return low, np.minimum(low + 1, n_in - 1), p - low

    y0, y1, fy = axis(a.shape[0], height)
    x0, x1, fx = axis(a.shape[1], width)
    rows = a[y0] * (1 - fy)[:, None] + a[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def resize_nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    y = np.minimum(np.arange(height) * a.shape[0] // height, a.shape[0] - 1)
    x = np.minimum(np.arange(width) * a.shape[1] // width, a.shape[1] - 1)
    return a[y][:, x]


def resize_lanczos(a: np.ndarray, height: int, width: int, lobes: int = 3) -> np.ndarray:
    """Windowed sinc, widened when shrinking, on bytes: each pass is rounded and clipped to 0..255."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        scale = max(n_in / n_out, 1.0)
        centre = (np.arange(n_out) + 0.5) * n_in / n_out
        x = (np.arange(n_in) + 0.5 - centre[:, None]) / scale
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
        return w / w.sum(1, keepdims=True)

    once = np.clip(np.rint(np.asarray(a, np.float64) @ weights(a.shape[1], width).T), 0, 255)
    return np.clip(np.rint(weights(a.shape[0], height) @ once), 0, 255).astype(np.uint8)


# morphology ---------------------------------------------------------------------------------------------------------------


def ellipse(radius: int) -> np.ndarray:
    """Offsets (dy, dx) of a rasterised ellipse of that radius; radius 1 is a cross."""
    r = int(radius)
    if r <= 0:
        return np.zeros((1, 2), int)
    out = []
    for dy in range(-r, r + 1):
        half = int(np.rint(r * math.sqrt(max(r * r - dy * dy, 0) / (r * r))))
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return np.array(out)


def square(radius: int = 1) -> np.ndarray:
    d = np.arange(-radius, radius + 1)
    return np.stack(np.meshgrid(d, d, indexing="ij"), -1).reshape(-1, 2)


def dilate(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where any offset reaches a true pixel. Works on stacks (..., height, width) too."""
    m = np.asarray(mask, bool)
    h, w = m.shape[-2:]
    out = np.zeros_like(m)
    for dy, dx in np.asarray(offsets).tolist():
        if abs(dy) < h and abs(dx) < w:
            out[..., max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] |= m[..., max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def erode(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return ~dilate(~np.asarray(mask, bool), offsets)


def gradient_boundary(mask: np.ndarray) -> np.ndarray:
    """Dilation less erosion by a 3 x 3 square; the image's edge is no boundary."""
    return dilate(mask, square()) & ~erode(mask, square())


def inner_boundary(mask: np.ndarray, width: int) -> np.ndarray:
    """True pixels within the width (Chebyshev) of a false one; the image's edge counts as false."""
    if width <= 0:
        raise ValueError("width must be positive")
    m = np.asarray(mask, bool)
    inside = np.pad(m, [(0, 0)] * (m.ndim - 2) + [(width, width)] * 2)
    return m & ~erode(inside, square(width))[..., width:-width, width:-width]


# components and distances -------------------------------------------------------------------------------------------------


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels from 1 by first pixel in row-major order, their number)."""
    m = np.asarray(mask, bool)
    labels = least_labels(m[None])[0]
    names, out = np.unique(labels[m], return_inverse=True)
    full = np.zeros(m.shape, np.int64)
    full[m] = out + 1
    return full, len(names)


def least_labels(masks: np.ndarray) -> np.ndarray:
    """For a stack of masks, each true pixel's least row-major index within its component; -1 elsewhere."""
    n, h, w = masks.shape
    far = h * w
    labels = np.where(masks, np.arange(far).reshape(1, h, w), far)
    flat = np.arange(n).reshape(n, 1, 1)
    while True:
        p = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        near = np.minimum.reduce([p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(masks, np.minimum(near, labels), far)
        jump = np.append(new.reshape(n, far), np.full((n, 1), far), 1)[flat, new]  # to the label's own label
        new = np.where(masks, np.minimum(new, jump), far)
        if (new == labels).all():
            return np.where(masks, labels, -1)
        labels = new


def component_areas(mask: np.ndarray) -> np.ndarray:
    labels, n = components(mask)
    return np.bincount(labels.ravel(), minlength=n + 1)[1:]


def largest_component(mask: np.ndarray) -> np.ndarray | None:
    labels, n = components(mask)
    return labels == 1 + int(np.bincount(labels.ravel(), minlength=n + 1)[1:].argmax()) if n else None


def centroid(mask: np.ndarray) -> tuple[float, float] | None:
    y, x = np.nonzero(mask)
    return (float(x.mean()), float(y.mean())) if len(y) else None


def nearest(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Euclidean distance to the nearest true pixel, its flat index) for every pixel; infinity and -1 if there is none. Of equally
    near ones the least index. Columns first, then each row against every column."""
    t = np.asarray(targets, bool)
    h, w = t.shape
    if not t.any():
        return np.full((h, w), np.inf), np.full((h, w), -1)
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(t, rows, -1), 0)  # nearest target of the same column, at or above
    below = np.minimum.accumulate(np.where(t, rows, 3 * h)[::-1], 0)[::-1]
    row_of = np.where((above >= 0) & (rows - above <= below - rows), above, np.where(below < 3 * h, below, -1))
    column = np.abs(rows - row_of)
    best = np.full((h, w), np.iinfo(np.int64).max)
    where = np.full((h, w), -1)
    for x in range(w):
        some = row_of[:, x] >= 0
        d = np.where(some, column[:, x] ** 2, 0)[:, None] + (np.arange(w) - x)[None, :] ** 2
        index = (row_of[:, x] * w + x)[:, None]
        closer = some[:, None] & ((d < best) | ((d == best) & (index < where)))
        best, where = np.where(closer, d, best), np.where(closer, index, where)
    return np.sqrt(best), where


def distance_inside(mask: np.ndarray) -> np.ndarray:
    """Distance of every true pixel to the nearest false one; all true gives the distance beyond the farthest corner."""
    m = np.asarray(mask, bool)
    d = nearest(~m)[0]
    return np.where(m, np.where(np.isfinite(d), d, sum(m.shape)), 0.0)


def distance_peaks(mask: np.ndarray, count: int) -> list[tuple[int, int]]:
    """Up to count points (x, y) farthest inside, each clearing a disc of max(3, round(sqrt(area) / 4)) around it."""
    m = np.asarray(mask, bool)
    if not m.any():
        return []
    d, out = distance_inside(m), []
    radius = max(3, round(math.sqrt(float(m.sum())) / 4))
    yy, xx = np.indices(m.shape)
    for _ in range(count):
        k = int(d.argmax())
        y, x = divmod(k, m.shape[1])
        if d[y, x] <= 0:
            break
        out.append((x, y))
        d[(yy - y) ** 2 + (xx - x) ** 2 <= radius**2] = 0
    return out


# images -------------------------------------------------------------------------------------------------------------------


def _convolve(a: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    ky, kx = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(a, ((ky, ky), (kx, kx)), mode=mode)
    return sum(kernel[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(rgb, np.float64) @ [0.299, 0.587, 0.114]).astype(np.uint8)


SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


def edge_map(rgb: np.ndarray) -> np.ndarray:
    """Sobel magnitude over its 95th percentile, clipped to 1; no edges at all give zeros."""
    g = gray(rgb) / 255.0
    m = np.hypot(_convolve(g, SOBEL, "reflect"), _convolve(g, SOBEL.T, "reflect"))
    scale = float(np.percentile(m, 95))
    return np.zeros_like(m) if scale <= 1e-6 else np.clip(m / scale, 0, 1)


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return np.outer(k, k) / k.sum() ** 2


def gaussian_blur(a: np.ndarray, size: int = 5, sigma: float = 0.0) -> np.ndarray:
    """Reflected edges; without a sigma 0.3 ((size - 1) / 2 - 1) + 0.8."""
    return _convolve(np.asarray(a, float), gaussian_kernel(size, sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8), "reflect")


def canny(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: local maxima of |gx| + |gy| across the gradient that are over high or joined to such through pixels over low."""
    a = np.asarray(image, float)
    gx, gy = _convolve(a, SOBEL, "edge"), _convolve(a, SOBEL.T, "edge")
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    angle[angle >= 180] = 0  # what rounding makes of a tiny negative angle
    keep = np.zeros(a.shape, bool)
    for (dy, dx), lo, hi in (((0, 1), 0, 22.5), ((1, 1), 22.5, 67.5), ((1, 0), 67.5, 112.5), ((1, -1), 112.5, 157.5), ((0, 1), 157.5, 180)):
        here = (angle >= lo) & (angle < hi)
        one = p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
        other = p[1 - dy : 1 - dy + a.shape[0], 1 - dx : 1 - dx + a.shape[1]]
        keep |= here & (m > other) & (m >= one)
    weak = keep & (m > low)
    labels, n = components(weak)
    strong = np.zeros(n + 1, bool)
    strong[np.unique(labels[weak & (m > high)])] = True
    strong[0] = False
    return strong[labels]


def edge_align(mask: np.ndarray, rgb: np.ndarray, sigma: float = 1.5) -> float:
    """Share of the mask's boundary pixels on edges of the blurred image; 0 without a boundary."""
    b = gradient_boundary(mask)
    size = 2 * int(math.ceil(3 * sigma)) + 1
    return float(canny(gaussian_blur(gray(rgb), size, sigma))[b].mean()) if b.any() else 0.0


# label metrics ------------------------------------------------------------------------------------------------------------


def iou(a: np.ndarray, b: np.ndarray, empty: float = 1.0) -> float:
    union = int(np.logical_or(a, b).sum())
    return float(np.logical_and(a, b).sum() / union) if union else empty


def quantised(p: np.ndarray) -> np.ndarray:
    """rint(255 p) > 127: a half is foreground."""
    return np.rint(np.clip(np.asarray(p, np.float32), 0, 1) * np.float32(255)) > 127


def disc(radius: int) -> np.ndarray:
    """Offsets within the Euclidean distance."""
    d = square(radius)
    return d[(d**2).sum(1) <= radius**2]


def _within(points: np.ndarray, targets: np.ndarray, tolerance: int) -> float:
    return float(dilate(targets, disc(tolerance))[points].mean()) if points.any() else 0.0


def bf_score(pred: np.ndarray, truth: np.ndarray, tolerance: int = 3) -> tuple[float, float, float]:
    """(F, precision, recall) of boundary pixels within the tolerance; 0 where either has no boundary."""
    a, b = gradient_boundary(pred), gradient_boundary(truth)
    if not a.any() or not b.any():
        return 0.0, 0.0, 0.0
    p, r = _within(a, b, tolerance), _within(b, a, tolerance)
    return (2 * p * r / (p + r) if p + r else 0.0), p, r


def boundary_iou(pred: np.ndarray, truth: np.ndarray, width: int) -> float:
    return iou(inner_boundary(pred, width), inner_boundary(truth, width))


def boundary_width(height: int, width: int, ratio: float = 0.02) -> int:
    return max(1, round(ratio * math.hypot(height, width)))


def band_metrics(pred: np.ndarray, truth: np.ndarray, band: int) -> dict | None:
    """IoU (0 if both are empty there) and boundary F within the dilated boundary of the truth; None if that is empty."""
    edge = gradient_boundary(truth)
    zone = dilate(edge, ellipse(band))
    if not zone.any():
        return None
    a, b = gradient_boundary(pred) & zone, edge & zone
    p = _within(a, edge, 3) if edge.any() else 0.0
    r = _within(b, gradient_boundary(pred), 3) if gradient_boundary(pred).any() else 0.0
    return {"iou": iou(pred & zone, truth & zone, 0.0), "bf": 2 * p * r / (p + r) if p + r else 0.0, "precision": p, "recall": r, "pixels": int(zone.sum()), "fg": int((truth & zone).sum())}


def band_soft_error(soft: np.ndarray, truth: np.ndarray, band: int = 2) -> dict | None:
    zone = dilate(gradient_boundary(truth), ellipse(band))
    if not zone.any():
        return None
    d = np.asarray(soft, float)[zone] - truth[zone]
    return {"mae": float(np.abs(d).mean()), "mse": float((d**2).mean()), "pixels": int(zone.sum()), "fg": int(truth[zone].sum())}


def component_profile(mask: np.ndarray, expected: int, least_pixels: int = 16, least_ratio: float = 0.001) -> dict:
    if expected < 0 or least_pixels < 1 or not 0 <= least_ratio <= 1:
        raise ValueError("expected >= 0, least_pixels >= 1 and 0 <= least_ratio <= 1 are required")
    areas = np.sort(component_areas(mask))[::-1]
    total = int(areas.sum())
    least = max(least_pixels, math.ceil(np.asarray(mask).size * least_ratio))
    top = float(areas[:expected].sum() / total) if total else 1.0
    return {"count": len(areas), "effective": int((areas >= least).sum()), "expected": expected, "area": total, "top_k_mass": top, "extra_mass": 1.0 - top if total else 0.0}


def flip_specks(mask: np.ndarray, below: int = 4) -> np.ndarray:
    """Components of fewer pixels turn into background if all around their bounding box is background."""
    m = np.asarray(mask, bool).copy()
    labels, n = components(m)
    for k in range(1, n + 1):
        y, x = np.nonzero(labels == k)
        if len(y) < below:
            box = np.s_[max(y.min() - 1, 0) : y.max() + 2, max(x.min() - 1, 0) : x.max() + 2]
            if not (m[box] & (labels[box] != k)).any():
                m[labels == k] = False
    return m


def prepared(pred: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Map scaled to 0..1 by its range (a constant one of bytes by 255), and truth scaled and cut above a half."""
    g = np.asarray(truth, float)
    g = (g - g.min()) / (g.max() - g.min()) if g.max() != g.min() else g / (255.0 if g.max() > 1 else 1.0)
    p = np.asarray(pred, float)
    p = (p - p.min()) / (p.max() - p.min()) if p.max() != p.min() else p / (255.0 if p.max() > 1 else 1.0)
    return p, g > 0.5


def s_measure(p: np.ndarray, g: np.ndarray, alpha: float = 0.5) -> float:
    """Structure measure: object and region similarity, of a prepared pair. A part of one pixel has no variance."""
    share = g.mean()
    if share in (0, 1):
        return float(1 - p.mean() if share == 0 else p.mean())

    def alike(values: np.ndarray) -> float:
        x = values.mean()
        return 2 * x / (x * x + 1 + (values.std(ddof=1) if len(values) > 1 else 0.0) + EPS)

    objects = share * alike(p[g]) + (1 - share) * alike((1 - p)[~g])
    y, x = (int(v) + 1 for v in np.rint(np.argwhere(g).mean(0)))
    h, w = g.shape
    regions = 0.0
    for rows in (np.s_[:y], np.s_[y:]):
        for cols in (np.s_[:x], np.s_[x:]):
            a, b = p[rows, cols], g[rows, cols].astype(float)
            if not a.size:
                continue
            n = max(a.size - 1, 1)
            ma, mb = a.mean(), b.mean()
            va, vb, cab = ((a - ma) ** 2).sum() / n, ((b - mb) ** 2).sum() / n, ((a - ma) * (b - mb)).sum() / n
            top, bottom = 4 * ma * mb * cab, (ma**2 + mb**2) * (va + vb)
            regions += a.size / (h * w) * (top / (bottom + EPS) if top else float(bottom == 0))
    return float(max(0.0, alpha * objects + (1 - alpha) * regions))


def threshold_counts(p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(foreground, background) pixels of the truth at or above each of 256 thresholds, from the highest down."""
    q = (p * 255).astype(np.uint8)
    return tuple(np.bincount(q[part], minlength=256)[::-1].cumsum() for part in (g, ~g))


def _enhanced(ff: np.ndarray, fb: np.ndarray, n_fg: int, size: int) -> np.ndarray:
    on = ff + fb
    if n_fg in (0, size):
        return (size - on if n_fg == 0 else on) / (size - 1 + EPS)
    mp, mg = on / size, n_fg / size
    total = 0.0
    for count, a, b in ((ff, 1 - mp, 1 - mg), (fb, 1 - mp, -mg), (n_fg - ff, -mp, 1 - mg), (size - on - (n_fg - ff), -mp, -mg)):
        total = total + count * (2 * a * b / (a * a + b * b + EPS) + 1) ** 2 / 4
    return total / (size - 1 + EPS)


def e_measure(p: np.ndarray, g: np.ndarray) -> tuple[float, np.ndarray]:
    """(adaptive, curve over 256 thresholds from the highest down)."""
    on = p >= min(2 * p.mean(), 1.0)
    n = int(g.sum())
    return float(_enhanced(np.array((on & g).sum()), np.array((on & ~g).sum()), n, g.size)), _enhanced(*threshold_counts(p, g), n, g.size)


def f_measure(p: np.ndarray, g: np.ndarray, beta2: float = 0.3) -> tuple[float, np.ndarray]:
    on = p >= min(2 * p.mean(), 1.0)
    hit = int((on & g).sum())
    pr, rc = hit / max(int(on.sum()), 1), hit / max(int(g.sum()), 1)
    tp, fp = threshold_counts(p, g)
    precision, recall = tp / np.maximum(tp + fp, 1), tp / max(int(g.sum()), 1)
    top = (1 + beta2) * precision * recall
    return ((1 + beta2) * pr * rc / (beta2 * pr + rc) if hit else 0.0), top / np.where(top == 0, 1, beta2 * precision + recall)


def weighted_f(p: np.ndarray, g: np.ndarray) -> float:
    """Errors spread by a 7 x 7 gaussian, weighted by distance to the truth; 0 for an empty truth."""
    if not g.any():
        return 0.0
    distance, index = nearest(g)
    e = np.abs(p - g)
    moved = np.where(g, e, e.ravel()[index])
    spread = _convolve(moved, gaussian_kernel(7, 5), "constant")
    least = np.where(g & (spread < e), spread, e)
    w = least * np.where(g, 1.0, 2 - np.exp(np.log(0.5) / 5 * distance))
    hit, false = g.sum() - w[g].sum(), w[~g].sum()
    r, pr = 1 - w[g].mean(), hit / (hit + false + EPS)
    return float(2 * r * pr / (r + pr + EPS))


def auroc(score: np.ndarray, truth: np.ndarray) -> float | None:
    """By ranks, ties shared; None unless both classes are there."""
    s, t = np.asarray(score, float).ravel(), np.asarray(truth, bool).ravel()
    n1, n0 = int(t.sum()), int((~t).sum())
    if not n1 or not n0:
        return None
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((rank[t].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def pair_metrics(pred: np.ndarray, truth: np.ndarray, bands: tuple[int, ...] = ()) -> dict:
    """All metrics of a predicted mask against the truth; band metrics are 0 where the truth has no boundary."""
    p, g = np.asarray(pred, bool), np.asarray(truth, bool)
    bf, bp, br = bf_score(p, g)
    em, fm = e_measure(p.astype(float), g), f_measure(p.astype(float), g)
    h, w = g.shape
    a, b = (centroid(x) if x is not None else None for x in (largest_component(p), largest_component(g)))
    shift = 0.0 if a is None and b is None else 1.0 if a is None or b is None else math.dist(a, b) / math.hypot(h, w)
    n, n_truth = components(p)[1], components(g)[1]
    out = {"iou": iou(p, g), "boundary_iou": boundary_iou(p, g, boundary_width(h, w)), "bf": bf, "boundary_precision": bp, "boundary_recall": br, "s_measure": s_measure(p.astype(float), g), "mae": float((p != g).mean()), "centroid_shift": shift, "area_ratio": float(p.sum() / max(int(g.sum()), 1)), "absolute_area_error": float(abs(int(p.sum()) - int(g.sum())) / max(int(g.sum()), 1)), "component_count": n, "component_count_delta": n - n_truth, "component_count_error": abs(n - n_truth), "e_max": float(em[1].max()), "e_mean": float(em[1].mean()), "f_max": float(fm[1].max()), "wfm": weighted_f(p.astype(float), g)}
    for k in bands:
        m = band_metrics(p, g, k)
        out |= {f"band_{k}_iou": m["iou"] if m else 0.0, f"band_{k}_bf": m["bf"] if m else 0.0}
    return out


def nearest_stack(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of every raster of a stack; indices are within the raster."""
    t = np.asarray(targets, bool)
    n, h, w = t.shape
    rows = np.arange(h)[None, :, None]
    above = np.maximum.accumulate(np.where(t, rows, -1), 1)
    below = np.minimum.accumulate(np.where(t, rows, 3 * h)[:, ::-1], 1)[:, ::-1]
    row_of = np.where((above >= 0) & (rows - above <= below - rows), above, np.where(below < 3 * h, below, -1))
    column = (rows - row_of) ** 2
    best, where = np.full((n, h, w), np.iinfo(np.int64).max), np.full((n, h, w), -1)
    across = (np.arange(w)[None, :] - np.arange(w)[:, None]) ** 2
    for x in range(w):
        some = row_of[:, :, x, None] >= 0
        d = np.where(some, column[:, :, x, None], 0) + across[x]
        index = row_of[:, :, x, None] * w + x
        closer = some & ((d < best) | ((d == best) & (index < where)))
        best, where = np.where(closer, d, best), np.where(closer, index, where)
    return np.where(where >= 0, np.sqrt(best.astype(float)), np.inf), where


def _ratio(a: np.ndarray, b: np.ndarray, empty: float = 0.0) -> np.ndarray:
    return np.where(b > 0, a / np.where(b > 0, b, 1), empty)


def _harmonic(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0)


def _structure_stack(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """s_measure() of stacks of masks, from counts alone."""
    n, h, w = g.shape
    size, ng, np_, hit = h * w, g.sum((1, 2)), p.sum((1, 2)), (p & g).sum((1, 2))

    def alike(ones: np.ndarray, of: np.ndarray) -> np.ndarray:
        x = _ratio(ones, of)
        return 2 * x / (x * x + 1 + np.where(of > 1, np.sqrt(x * (1 - x) * of / np.maximum(of - 1, 1)), 0.0) + EPS)

    share = ng / size
    objects = share * alike(hit, ng) + (1 - share) * alike(size - ng - (np_ - hit), size - ng)
    yy, xx = np.arange(h)[None, :, None], np.arange(w)[None, None, :]
    some = np.maximum(ng, 1)
    cy, cx = ((np.rint((g * z).sum((1, 2)) / some) + 1)[:, None, None] for z in (yy, xx))
    regions = np.zeros(n)
    for top in (yy < cy, yy >= cy):
        for left in (xx < cx, xx >= cx):
            part = top & left
            k, a, b, ab = (v.sum((1, 2)).astype(np.int64) for v in (part, p & part, g & part, p & g & part))
            scale = np.maximum(k, 1) * np.maximum(k - 1, 1)
            va, vb, cab = (k * a - a * a) / scale, (k * b - b * b) / scale, (k * ab - a * b) / scale
            ma, mb = a / np.maximum(k, 1), b / np.maximum(k, 1)
            up, down = 4 * ma * mb * cab, (ma**2 + mb**2) * (va + vb)
            regions += np.where(k > 0, k / size * np.where(up != 0, up / (down + EPS), (down == 0).astype(float)), 0.0)
    mixed = np.maximum(0.0, 0.5 * objects + 0.5 * regions)
    return np.where(ng == 0, 1 - np_ / size, np.where(ng == size, np_ / size, mixed))


def _weighted_stack(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """weighted_f() of stacks of masks."""
    n, h, w = g.shape
    distance, index = nearest_stack(g)
    e = (p != g).astype(float)
    moved = np.where(g, e, np.take_along_axis(e.reshape(n, -1), np.maximum(index, 0).reshape(n, -1), 1).reshape(n, h, w))
    wide, kernel, spread = np.pad(moved, ((0, 0), (3, 3), (3, 3))), gaussian_kernel(7, 5), np.zeros((n, h, w))
    for dy in range(7):
        for dx in range(7):
            spread += kernel[dy, dx] * wide[:, dy : dy + h, dx : dx + w]
    error = np.where(g & (spread < e), spread, e) * np.where(g, 1.0, 2 - np.exp(np.log(0.5) / 5 * np.where(np.isfinite(distance), distance, 0.0)))
    ng, inside = g.sum((1, 2)), (error * g).sum((1, 2))
    hit, false, r = ng - inside, (error * ~g).sum((1, 2)), 1 - _ratio(inside, ng)
    pr = hit / (hit + false + EPS)
    return np.where(ng > 0, 2 * r * pr / (r + pr + EPS), 0.0)


def _component_stack(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of components, x, y of the largest one's centroid) of each mask; of none, (0, 0, 0)."""
    labels = least_labels(m)
    n, h, w = labels.shape
    flat = labels.reshape(n, -1)
    counts = np.zeros((n, h * w), np.int64)
    row, at = np.nonzero(flat >= 0)
    np.add.at(counts, (row, flat[row, at]), 1)
    big = m & (labels == counts.argmax(1).reshape(-1, 1, 1))
    size = np.maximum(big.sum((1, 2)), 1)
    return (counts > 0).sum(1), (big * np.arange(w)).sum((1, 2)) / size, (big * np.arange(h)[:, None]).sum((1, 2)) / size


def pair_metrics_stack(pred: np.ndarray, truth: np.ndarray, bands: tuple[int, ...] = ()) -> dict[str, np.ndarray]:
    """pair_metrics() of stacks (n, height, width) of masks, every step over the whole stack. A mask has two levels, so the curves over
    256 thresholds have two values: 255 times that of the mask, and once that of the whole image."""
    p, g = np.asarray(pred, bool), np.asarray(truth, bool)
    n, h, w = g.shape
    size, area, ng, hit = h * w, p.sum((1, 2)), g.sum((1, 2)), (p & g).sum((1, 2))
    inner = [inner_boundary(x, boundary_width(h, w)) for x in (p, g)]
    ep, eg = gradient_boundary(p), gradient_boundary(g)
    near_p, near_g = dilate(ep, disc(3)), dilate(eg, disc(3))
    some = ep.any((1, 2)) & eg.any((1, 2))
    bp, br = (np.where(some, _ratio((x & y).sum((1, 2)), x.sum((1, 2))), 0.0) for x, y in ((ep, near_g), (eg, near_p)))

    def enhanced(ff: np.ndarray, fb: np.ndarray) -> np.ndarray:
        on = ff + fb
        mp, mg, total = on / size, ng / size, 0.0
        for count, a, b in ((ff, 1 - mp, 1 - mg), (fb, 1 - mp, -mg), (ng - ff, -mp, 1 - mg), (size - on - (ng - ff), -mp, -mg)):
            total = total + count * (2 * a * b / (a * a + b * b + EPS) + 1) ** 2 / 4
        return np.where(ng == 0, size - on, np.where(ng == size, on, total)) / (size - 1 + EPS)

    def f_of(tp: np.ndarray, on: np.ndarray) -> np.ndarray:
        precision, recall = tp / np.maximum(on, 1), tp / np.maximum(ng, 1)
        top = 1.3 * precision * recall
        return top / np.where(top == 0, 1, 0.3 * precision + recall)

    e_mask, e_all = enhanced(hit, area - hit), enhanced(ng, size - ng)
    (np_, ax, ay), (n_truth, bx, by) = _component_stack(p), _component_stack(g)
    shift = np.where((area == 0) & (ng == 0), 0.0, np.where((area == 0) | (ng == 0), 1.0, np.hypot(ax - bx, ay - by) / math.hypot(h, w)))
    out = {
        "iou": _ratio(hit, area + ng - hit, 1.0), "boundary_iou": _ratio((inner[0] & inner[1]).sum((1, 2)), (inner[0] | inner[1]).sum((1, 2)), 1.0), "bf": _harmonic(bp, br), "boundary_precision": bp, "boundary_recall": br, "s_measure": _structure_stack(p, g), "mae": (p != g).mean((1, 2)), "centroid_shift": shift,
        "area_ratio": area / np.maximum(ng, 1), "absolute_area_error": np.abs(area - ng) / np.maximum(ng, 1), "component_count": np_, "component_count_delta": np_ - n_truth, "component_count_error": np.abs(np_ - n_truth), "e_max": np.maximum(e_mask, e_all), "e_mean": (255 * e_mask + e_all) / 256, "f_max": np.maximum(f_of(hit, area), f_of(ng, np.full(n, size))), "wfm": _weighted_stack(p, g),
    }
    for k in bands:
        zone = dilate(eg, ellipse(k))
        a, b = ep & zone, eg & zone
        bp, br = _ratio((a & near_g).sum((1, 2)), a.sum((1, 2))), _ratio((b & near_p).sum((1, 2)), b.sum((1, 2)))
        out |= {f"band_{k}_iou": _ratio((p & g & zone).sum((1, 2)), ((p | g) & zone).sum((1, 2))), f"band_{k}_bf": _harmonic(bp, br)}
    return out


# refinement ---------------------------------------------------------------------------------------------------------------


def localise(coarse: np.ndarray, features: np.ndarray, fg: float = 0.8, temperature: float = 0.1, low: float = 0.33, high: float = 0.67) -> dict:
    """Semantic localisation: prototypes of a foreground and a background core give a probability map and, from five agreements
    with the coarse map, a reliability and a route. Without a core on either side the coarse map is kept and the route is low."""
    if temperature <= 0 or not 0 <= low < high <= 1:
        raise ValueError("temperature must be positive and 0 <= low < high <= 1")
    f = np.asarray(features, float)
    if not (f.shape[0] >= f.shape[1] and f.shape[0] >= f.shape[2]):
        f = np.moveaxis(f, -1, 0)
    c = np.clip(resize_bilinear(coarse, *f.shape[1:]), 0, 1)
    on, seed = c > 0.5, c >= fg
    core = erode(seed, ellipse(1))
    core = core if core.any() else seed
    rest = ~dilate(on, ellipse(2))
    rest = rest if rest.any() else c <= 0.1
    names = ("area_agreement", "centroid_agreement", "component_agreement", "region_iou", "semantic_margin")
    if not core.any() or not rest.any():
        return {"probability": c, "mask": on, "core": core, "rest": rest, "reliability": 0.0, "route": "low", "components": dict.fromkeys(names, 0.0)}
    v = f.reshape(f.shape[0], -1).T
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-6)
    v = unit(v)
    margin = v @ unit(v[core.ravel()].mean(0)) - v @ unit(v[rest.ravel()].mean(0))
    p = (1 / (1 + np.exp(-np.clip(margin / temperature, -20, 20)))).reshape(c.shape)
    m = p > 0.5
    a, b = centroid(on), centroid(m)
    areas = sorted((int(on.sum()), int(m.sum())))
    parts = dict(zip(names, (areas[0] / areas[1] if areas[0] else 0.0, float(np.clip(1 - math.dist(a, b) / math.hypot(*c.shape), 0, 1)) if a and b else 0.0, 1 / (1 + abs(components(on)[1] - components(m)[1])), iou(on, m), float(np.clip(p[core].mean() - p[rest].mean(), 0, 1)))))
    reliability = float(np.mean(list(parts.values())))
    return {"probability": p, "mask": m, "core": core, "rest": rest, "reliability": reliability, "route": "high" if reliability >= high else "medium" if reliability >= low else "low", "components": parts}


def _same_size(p: np.ndarray, like: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    return np.clip(p if p.shape == like.shape else resize_bilinear(p, *like.shape), 0, 1)


def _core(c: np.ndarray, s: np.ndarray) -> np.ndarray:
    core = erode((c >= 0.8) & (s >= 0.5), ellipse(1))
    return core if core.any() else c >= 0.8


def weak_box(mask: np.ndarray, ratio: float = 0.1) -> tuple[int, int, int, int] | None:
    y, x = np.nonzero(mask)
    if not len(y):
        return None
    h, w = mask.shape
    px, py = (max(2, round((int(v.max()) - int(v.min()) + 1) * ratio)) for v in (x, y))
    return max(0, int(x.min()) - px), max(0, int(y.min()) - py), min(w - 1, int(x.max()) + px), min(h - 1, int(y.max()) + py)


def prompts(coarse: np.ndarray, semantic: np.ndarray, route: str) -> list[dict]:
    """Prompt variants by route: none, two (a point; the point and a weak box) or three (and consensus points with a safe negative)."""
    if route not in ("low", "medium", "high"):
        raise ValueError(f"unknown route {route}")
    c = np.clip(np.asarray(coarse, float), 0, 1)
    s, on = _same_size(semantic, c), c > 0.5
    points = [] if route == "low" else distance_peaks(_core(c, s), 1 if route == "high" else 3)
    if not points:
        return []
    reach = max(3, round(math.sqrt(float(on.sum())) * 0.2))
    box = weak_box(on | ((s >= 0.65) & dilate(on, ellipse(reach))))
    out = [{"name": "point_only", "positive": points[:1], "negative": [], "box": None}]
    if box is not None:
        out.append({"name": "weak_box", "positive": points[:1], "negative": [], "box": box})
    if route == "medium":
        out.append({"name": "consensus_points", "positive": points, "negative": safe_negative(on, s), "box": None})
    return out


def safe_negative(on: np.ndarray, semantic: np.ndarray) -> list[tuple[int, int]]:
    """The point farthest from the mask among safe background; none if there is no such."""
    safe = ~dilate(on, ellipse(3)) & (semantic < 0.3)
    d = np.where(safe, distance_inside(~on), 0)
    if not safe.any() or d.max() <= 0:
        return []
    y, x = divmod(int(d.argmax()), on.shape[1])
    return [(x, y)]


def assess(candidates: list[dict], coarse: np.ndarray, semantic: np.ndarray, rgb: np.ndarray) -> list[dict]:
    """Candidates (prompt, index, mask) with q_semantic, q_stability, q_edge, q_safety, their mean as quality, and validity."""
    c = np.clip(np.asarray(coarse, float), 0, 1)
    s, on = _same_size(semantic, c), c > 0.5
    core, rest = _core(c, s), ~dilate(on, ellipse(5)) & (s < 0.3)
    edges = edge_map(rgb)
    masks = [m if m.shape == c.shape else resize_nearest(m, *c.shape) for m in (np.asarray(x["mask"], bool) for x in candidates)]
    out = []
    for x, m in zip(candidates, masks):
        area, base = int(m.sum()), max(int(on.sum()), 1)
        inside = s[m].mean() if area else 0.0
        outside = s[~m].mean() if area < c.size else 1.0
        others = {y["prompt"] for y in candidates} - {x["prompt"]}
        stable = np.mean([max(iou(m, n) for y, n in zip(candidates, masks) if y["prompt"] == o) for o in sorted(others)]) if others else 0.5
        edge = gradient_boundary(m)
        a, b = centroid(m), centroid(on)
        near = float(np.clip(1 - math.dist(a, b) / math.hypot(*c.shape), 0, 1)) if a and b else 0.0
        safety = np.mean([min(area + 1, base + 1) / max(area + 1, base + 1), near, m[core].mean() if core.any() else 0.5, (~m)[rest].mean() if rest.any() else 0.5])
        q = {"q_semantic": float(np.clip(0.5 * (inside + 1 - outside), 0, 1)), "q_stability": float(stable), "q_edge": float(edges[edge].mean()) if edge.any() else 0.0, "q_safety": float(safety)}
        out.append({**x, "mask": m, **q, "quality": float(np.mean(list(q.values()))), "valid": bool(0 < area < c.size and safety >= 0.25)})
    return out


def choose(assessed: list[dict], minimum: float = 0.35) -> dict | None:
    """Best valid candidate, the first of equals, if its quality reaches the minimum."""
    valid = [x for x in assessed if x["valid"]]
    best = max(valid, key=lambda x: x["quality"], default=None)
    return best if best is not None and best["quality"] >= minimum else None


def constraint(coarse: np.ndarray, semantic: np.ndarray, route: str) -> dict:
    """The band in which a label may change, and the cores in which it may not."""
    c = np.clip(np.asarray(coarse, float), 0, 1)
    s, on = _same_size(semantic, c), c > 0.5
    r = math.sqrt(max(float(on.sum()), 1.0) / math.pi)
    radius = {"high": min(max(round(0.05 * r), 2), 12), "medium": min(max(round(0.10 * r), 4), 20)}.get(route, 0)
    core = erode(c >= 0.8, ellipse(max(1, radius // 2)))
    core = core if core.any() else c >= 0.8
    rest = ~dilate(on, ellipse(max(2, radius * 2))) & (s < 0.3)
    band = np.zeros(c.shape, bool)
    if radius:
        band = (dilate(on, ellipse(radius)) & ~erode(on, ellipse(radius))) | dilate(on ^ (s >= 0.5), ellipse(max(1, radius // 2)))
        band &= ~core & ~rest
    return {"band": band, "core": core, "rest": rest, "radius": radius}


def fuse(selected: dict, assessed: list[dict], coarse: np.ndarray, semantic: np.ndarray, rgb: np.ndarray, limits: dict, protected: np.ndarray | None = None) -> dict:
    """Moves the coarse map towards the selected mask by a confidence that is nil outside the band and where protected foreground
    would be lost."""
    c = np.clip(np.asarray(coarse, float), 0, 1)
    s, m = _same_size(semantic, c), selected["mask"]
    agree = np.mean([x["mask"] == m for x in assessed], axis=0)
    edge = 0.5 + 0.5 * np.clip(gaussian_blur(edge_map(rgb), 5), 0, 1)
    conf = selected["quality"] * agree * np.where(m, s, 1 - s) * edge
    frozen = ~limits["band"] | limits["core"] | limits["rest"]
    if protected is not None:
        if protected.shape != c.shape:
            raise ValueError("protected foreground must match the coarse map's shape")
        frozen = frozen | (protected & ~m)
    conf = np.clip(np.where(frozen, 0, conf), 0, 1)
    out = np.clip((1 - conf) * c + conf * m, 0, 1)
    return {"refined": out, "confidence": conf, "changed_ratio": float((np.abs(out - c) > 1 / 255).mean()), "before": components(quantised(c))[1], "after": components(quantised(out))[1]}


def clean_islands(mask: np.ndarray, coarse: np.ndarray, semantic: np.ndarray, most_extra: float = 0.05) -> dict:
    """Drops components without support (coarse >= 0.8 or semantic >= 0.65) if the mask has more, or more extra mass, than the coarse
    map allows; if none has support the largest stays."""
    m = np.asarray(mask, bool)
    if not 0 <= most_extra <= 1 or not m.shape == np.shape(coarse) == np.shape(semantic):
        raise ValueError("maps must share a shape and the extra mass be in 0..1")
    expected = component_profile(quantised(coarse), 0)["effective"]
    profile = component_profile(m, expected)
    risk = profile["effective"] > expected or profile["extra_mass"] > most_extra
    if not risk or not m.any():
        return {"mask": m.copy(), "risk": risk, "before": profile["count"], "after": profile["count"], "removed": 0, "removed_ratio": 0.0}
    labels, n = components(m)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(labels[(np.asarray(coarse) >= 0.8) | (np.asarray(semantic) >= 0.65)])] = True
    keep[0] = False
    if not keep.any():
        keep[1 + int(np.bincount(labels.ravel())[1:].argmax())] = True
    out = keep[labels]
    return {"mask": out, "risk": True, "before": n, "after": int(keep.sum()), "removed": n - int(keep.sum()), "removed_ratio": float((m & ~out).sum() / m.sum())}


def backbone(coarse_mask: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Cores joined within each component of the coarse mask: all cores grow in one breadth-first wave; where two meet for the first
    time, the ways back to both are added. Row-major seeds and neighbours fix the order."""
    inside = np.asarray(coarse_mask, bool)
    seeds = np.asarray(core, bool) & inside
    labels, n = components(seeds)
    whole, _ = components(inside)
    out = seeds.copy()
    of = {k: int(whole.ravel()[np.flatnonzero(labels.ravel() == k)[0]]) for k in range(1, n + 1)}
    open_joins = n - len(set(of.values()))
    group = list(range(n + 1))

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    owner, parent = labels.copy(), {}
    wave = deque(map(tuple, np.argwhere(seeds).tolist()))
    while wave and open_joins:
        y, x = wave.popleft()
        for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
            p = (y + dy, x + dx)
            if not (0 <= p[0] < inside.shape[0] and 0 <= p[1] < inside.shape[1] and inside[p]):
                continue
            if not owner[p]:
                owner[p], parent[p] = owner[y, x], (y, x)
                wave.append(p)
            elif find(owner[p]) != find(owner[y, x]):
                group[find(owner[p])] = find(owner[y, x])
                for q in (p, (y, x)):
                    while q is not None:
                        out[q], q = True, parent.get(q)
                open_joins -= 1
    return out


def coarse_fallback(coarse: np.ndarray) -> dict:
    c = np.clip(np.asarray(coarse, float), 0, 1)
    n = components(quantised(c))[1]
    return {"refined": c, "confidence": np.zeros_like(c), "changed_ratio": 0.0, "before": n, "after": n}


def calibrate(selected: dict | None, assessed: list[dict], coarse: np.ndarray, semantic: np.ndarray, rgb: np.ndarray, limits: dict, most_growth: int = 1, most_extra: float = 0.05) -> dict:
    """Cleans the selected candidate, protects connections, fuses, and falls back to the coarse map if components multiply."""
    if most_growth < 0:
        raise ValueError("growth must not be negative")
    c = np.clip(np.asarray(coarse, float), 0, 1)
    if selected is None:
        return {"fusion": coarse_fallback(c), "cleanup": None, "backbone": np.zeros(c.shape, bool), "growth": 0, "fallback": "no_selected_candidate"}
    tidy = clean_islands(selected["mask"], c, _same_size(semantic, c), most_extra)
    cleaned = {**selected, "mask": tidy["mask"]}
    same = lambda x: (x["prompt"], x["index"]) == (selected["prompt"], selected["index"])
    bones = backbone(quantised(c), limits["core"])
    fusion = fuse(cleaned, [cleaned if same(x) else x for x in assessed], c, semantic, rgb, limits, bones)
    before = component_profile(quantised(c), 0)["effective"]
    growth = component_profile(quantised(fusion["refined"]), before)["effective"] - before
    if growth > most_growth:
        return {"fusion": coarse_fallback(c), "cleanup": tidy, "backbone": bones, "growth": growth, "fallback": "excess_effective_component_growth"}
    return {"fusion": fusion, "cleanup": tidy, "backbone": bones, "growth": growth, "fallback": None}


# masks by strategy, windows, codecs ---------------------------------------------------------------------------------------


def pick_mask(masks: list[np.ndarray], coarse: np.ndarray, how: str, scores: list[float] | None = None, edges: list[float] | None = None) -> np.ndarray:
    """best_iou, reverse (least IoU), edge (0.3 score + 0.4 IoU + 0.3 edge), area (nearest area) or union (parts within the coarse
    mask of masks with IoU >= 0.25, and what they leave uncovered: the coarse mask itself)."""
    c = np.asarray(coarse, bool)
    if not masks or (how == "area" and not c.any()):
        return c
    overlap = [iou(m, c, 0.0) for m in masks]
    if how == "best_iou":
        return masks[int(np.argmax(overlap))]
    if how == "reverse":
        return masks[int(np.argmin(overlap))]
    if how == "edge":
        return masks[int(np.argmax([0.3 * s + 0.4 * o + 0.3 * e for s, o, e in zip(scores, overlap, edges)]))]
    if how == "area":
        return masks[int(np.argmin([abs(int(m.sum()) - int(c.sum())) for m in masks]))]
    if how == "union":
        return c.copy()
    raise ValueError(f"unknown strategy {how}")


def gated_label(mask: np.ndarray, coarse: np.ndarray, score: float, edge: float, gamma: float = 50.0, lower: float = 0.2, upper: float = 999.0) -> np.ndarray:
    """Coarse, mask or their fusion by the gate score."""
    s = 0.3 * score + 0.4 * iou(mask, coarse, 0.0) + gamma * edge
    return coarse if s < lower else mask if s > upper else s * mask + (1 - s) * coarse > 0.5


def sampled_points(mask: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Up to n distinct true pixels (x, y); the seed belongs to the raster's key, so order of rows plays no part."""
    yx = np.argwhere(mask)
    if not len(yx):
        return np.zeros((0, 2), int)
    return yx[np.random.RandomState(seed).choice(len(yx), min(n, len(yx)), replace=False)][:, ::-1]


def pack_mask(mask: np.ndarray) -> bytes:
    return np.packbits(np.asarray(mask, bool)).tobytes()


def unpack_mask(data: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[: height * width].astype(bool).reshape(height, width)


def entropy_windows(p: np.ndarray, windows: int, threshold: float) -> np.ndarray:
    """(row, column) of windows whose mean of -p ln max(p, 1e-5) exceeds the threshold; windows share the raster adaptively."""
    e = -np.asarray(p, float) * np.log(np.maximum(p, 1e-5))
    cut = lambda n: [(i * n // windows, -(-(i + 1) * n // windows)) for i in range(windows)]
    score = np.array([[e[a:b, c:d].mean() for c, d in cut(e.shape[1])] for a, b in cut(e.shape[0])])
    return np.argwhere(score > threshold)


def padded_batch(rasters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rasters padded to the largest height and width, and where they are valid."""
    h, w = max(r.shape[0] for r in rasters), max(r.shape[1] for r in rasters)
    out, valid = np.zeros((len(rasters), h, w)), np.zeros((len(rasters), h, w), bool)
    for i, r in enumerate(rasters):
        out[i, : r.shape[0], : r.shape[1]] = r
        valid[i, : r.shape[0], : r.shape[1]] = True
    return out, valid


def split_tiles(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    h, w = a.shape
    return a.reshape(rows, h // rows, cols, w // cols).swapaxes(1, 2).reshape(rows * cols, h // rows, w // cols)


def merge_overlapping(tiles: list[np.ndarray], corners: list[tuple[int, int]], height: int, width: int) -> np.ndarray:
    """Mean over the tiles that cover each pixel; uncovered ones are 0."""
    total, count = np.zeros((height, width)), np.zeros((height, width))
    for t, (y, x) in zip(tiles, corners):
        total[y : y + t.shape[0], x : x + t.shape[1]] += t
        count[y : y + t.shape[0], x : x + t.shape[1]] += 1
    return total / np.maximum(count, 1)


def centre_crop(a: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = (a.shape[0] - height) // 2, (a.shape[1] - width) // 2
    return a[y : y + height, x : x + width]


def centre_pad(a: np.ndarray, height: int, width: int, value: float = -10.0) -> np.ndarray:
    out = np.full((height, width), value)
    y, x = (height - a.shape[0]) // 2, (width - a.shape[1]) // 2
    out[y : y + a.shape[0], x : x + a.shape[1]] = a
    return out


def look_twice(mask: np.ndarray, threshold: float) -> list[tuple[int, int, int, int]] | None:
    """Boxes (x, y, w, h) of components over 1 % of the raster, largest box first, if the largest component is under the threshold;
    the centred half without any component; None if there is no need to look again."""
    h, w = mask.shape
    labels, n = components(mask)
    if not n:
        return [(w // 4, h // 4, w // 2, h // 2)]
    share = np.bincount(labels.ravel(), minlength=n + 1)[1:] / (h * w)
    if share.max() >= threshold:
        return None
    out = []
    for k in np.flatnonzero(share > 0.01) + 1:
        y, x = np.nonzero(labels == k)
        out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return sorted(out, key=lambda b: -b[2] * b[3])


def control_masks(coarse: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hard (0 or 255) and soft (bytes) labels of the coarse map at the image's size."""
    p = np.clip(resize_bilinear(coarse, height, width), 0, 1)
    return (np.where(p > 0.5, 255, 0)).astype(np.uint8), np.rint(p * 255).astype(np.uint8)
