"""The older refinement's kernels: sampled prompts, truncated mask choice, gating, and edge-aware smoothing on a bilateral grid."""

from __future__ import annotations

import numpy as np

from tessella.operators import kernels as K


def box_of(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, w, h) with w and h the spans between the outermost pixels."""
    y, x = np.nonzero(mask)
    return (int(x.min()), int(y.min()), int(np.ptp(x)), int(np.ptp(y))) if len(y) else None


def grown(box: tuple[int, int, int, int], ratio: float, height: int, width: int) -> tuple[int, int, int, int]:
    x, y, w, h = box
    nw, nh = int(w * (1 + ratio)), int(h * (1 + ratio))
    nx, ny = max(0, int(x - (nw - w) / 2)), max(0, int(y - (nh - h) / 2))
    return nx, ny, min(nw, width - nx), min(nh, height - ny)


def centroid_prompt(mask: np.ndarray, with_box: bool = False) -> dict | None:
    """One point at the truncated centroid, and the bounding box grown by half where asked; None for an empty mask."""
    c = K.centroid(mask)
    if c is None:
        return None
    return {"positive": [(int(c[0]), int(c[1]))], "negative": [], "box": grown(box_of(mask), 0.5, *mask.shape) if with_box else None}


def outside_points(box: tuple[int, int, int, int], height: int, width: int, n: int, seed: int) -> np.ndarray:
    """n points (x, y) spread evenly over the area outside the box; none if the box fills the raster."""
    free = np.ones((height, width), bool)
    x, y, w, h = box
    free[max(y, 0) : y + h, max(x, 0) : x + w] = False
    at = np.argwhere(free)
    return at[np.random.RandomState(seed).randint(0, len(at), n)][:, ::-1] if len(at) else np.zeros((0, 2), int)


def cautious_points(mask: np.ndarray, box: tuple[int, int, int, int], n: int, least_distance: float, seed: int) -> np.ndarray:
    """Up to n distinct points in the box but off the mask, farther from its centroid than the distance."""
    c = K.centroid(mask)
    if c is None:
        return np.zeros((0, 2), int)
    x, y, w, h = box
    yy, xx = np.indices(mask.shape)
    inside = (xx >= x) & (xx < x + w) & (yy >= y) & (yy < y + h)
    return K.sampled_points(inside & ~mask & (np.hypot(xx - c[0], yy - c[1]) > least_distance), n, seed)


def choose_mask(masks: list[np.ndarray], scores: list[float], coarse: np.ndarray, edges: list[float], low: float = 0.25, high: float = 0.9) -> int | None:
    """Index of the best 0.3 score + 0.4 IoU + 0.3 edge among masks with IoU of at least low; the first over high wins outright; None,
    the coarse mask, if there is no such."""
    best, at = -np.inf, None
    for i, (m, s, e) in enumerate(zip(masks, scores, edges)):
        o = K.iou(m, coarse, 0.0)
        if o > high:
            return i
        if o >= low and 0.3 * s + 0.4 * o + 0.3 * e > best:
            best, at = 0.3 * s + 0.4 * o + 0.3 * e, i
    return at


def refine(masks: list[np.ndarray], scores: list[float], coarse: np.ndarray, rgb: np.ndarray) -> dict:
    """Choice and gate in one; the audit says what was applied: the chosen index, its score, and the gate's score and decision."""
    edges = [K.edge_align(m, rgb) for m in masks]
    at = choose_mask(masks, scores, coarse, edges)
    if at is None:
        return {"label": coarse, "index": None, "score": None, "decision": "FALLBACK"}
    s = 0.3 * scores[at] + 0.4 * K.iou(masks[at], coarse, 0.0) + 50.0 * edges[at]
    return {"label": K.gated_label(masks[at], coarse, scores[at], edges[at]), "index": at, "score": s, "decision": "FALLBACK" if s < 0.2 else "FULL" if s > 999 else "FUSION"}


class Grid:
    """Pixels grouped by position, luma and chroma cells. splat sums over cells, slice reads them back, blur adds neighbours."""

    def __init__(self, rgb: np.ndarray, spatial: float, luma: float, chroma: float):
        a = np.asarray(rgb, float)
        yy, xx = np.indices(a.shape[:2])
        y = a @ [0.299, 0.587, 0.114]
        u = a @ [-0.168736, -0.331264, 0.5] + 128
        v = a @ [0.5, -0.418688, -0.081312] + 128
        cells = np.stack([(xx / spatial).astype(int), (yy / spatial).astype(int), (y / luma).astype(int), (u / chroma).astype(int), (v / chroma).astype(int)], -1).reshape(-1, 5)
        self.cells, self.of = np.unique(cells, axis=0, return_inverse=True)
        self.of = self.of.ravel()
        self.n = len(self.cells)
        known = {tuple(c): i for i, c in enumerate(self.cells.tolist())}
        self.links = []
        for d in range(5):
            for step in (-1, 1):
                pairs = [(i, j) for c, i in known.items() if (j := known.get(tuple(x + step * (k == d) for k, x in enumerate(c)))) is not None]
                self.links.append(np.array(pairs, int).reshape(-1, 2))

    def splat(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, self.n)

    def slice(self, y: np.ndarray) -> np.ndarray:
        return y[self.of]

    def blur(self, y: np.ndarray) -> np.ndarray:
        out = 10.0 * y
        for at in self.links:
            np.add.at(out, at[:, 0], y[at[:, 1]])
        return out


def smooth(target: np.ndarray, rgb: np.ndarray, confidence: float = 0.999, spatial: float = 16, luma: float = 16, chroma: float = 8, strength: float = 256, rounds: int = 25, tolerance: float = 1e-5) -> np.ndarray:
    """The map closest to the target that is smooth within the grid's cells and between neighbours: a least-squares problem solved by
    preconditioned conjugate gradients."""
    g = Grid(rgb, spatial, luma, chroma)
    m, n = g.splat(np.ones(target.size)), np.ones(g.n)
    for _ in range(10):
        n = np.sqrt(n * m / g.blur(n))
    m = n * g.blur(n)
    w = g.splat(np.full(target.size, confidence))
    b = g.splat(np.asarray(target, float).ravel() * confidence)
    apply = lambda y: strength * (m * y - n * g.blur(n * y)) + w * y
    scale = 1 / np.maximum(strength * (m - 10.0 * n * n) + w, 1e-5)
    y = b / w
    r = b - apply(y)
    z = scale * r
    p = z.copy()
    for _ in range(rounds):
        if np.linalg.norm(r) <= tolerance * max(np.linalg.norm(b), 1e-300):
            break
        q = apply(p)
        a = (r @ z) / (p @ q)
        y, new = y + a * p, r - a * q
        znew = scale * new
        p = znew + (new @ znew) / (r @ z) * p
        r, z = new, znew
    return g.slice(y).reshape(np.shape(target))


def snapped(mask: np.ndarray, rgb: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, bool]:
    """The smoothed mask's largest part, holes filled, if its IoU with the mask is over least; else the mask. And which it was."""
    m = np.asarray(mask, bool)
    s = smooth(m.astype(float), rgb) > 0.5
    outside, _ = K.components(np.pad(~s, 1, constant_values=True))
    filled = ~(outside == outside[0, 0])[1:-1, 1:-1]
    big = K.largest_component(filled)
    big = np.ones_like(m) if big is None else big
    return (big, True) if K.iou(big, m) > least else (m, False)
