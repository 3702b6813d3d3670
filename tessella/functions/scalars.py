"""Column formulas of the decision layer. All are native expressions, so they stay within code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded half up, without a negative zero."""
    r = F.round(c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded below and above; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def file_stem(path: Column) -> Column:
    """Last path segment without its last extension; a leading dot is no extension."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"^(.+?)(?:\.[^.]*)?$", 1)


def parent_dataset(path: Column) -> Column:
    """Name of the folder two levels above the file; null where the path is shorter."""
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3))


def is_safe_name(name: Column) -> Column:
    """Not empty, no separators, and neither "." nor ".."."""
    return F.coalesce(name.rlike(r"^[^/\\]+$") & ~name.isin(".", ".."), F.lit(False))


def is_experiment_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def sigmoid(x: Column, temperature: float = 1.0, limit: float = 20.0) -> Column:
    """Logistic of x / temperature, the logit held within the limit."""
    return 1.0 / (1.0 + F.exp(-clip(x / temperature, -limit, limit)))


def ratio_score(a: Column, b: Column) -> Column:
    """exp(-|ln((a + 1) / (b + 1))|), in its closed form: the smaller over the larger."""
    x, y = a + 1.0, b + 1.0
    return F.least(x, y) / F.greatest(x, y)


def area_agreement(a: Column, b: Column) -> Column:
    """Smaller area over the larger; 0 if either is empty."""
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def component_agreement(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.abs(a - b))


def centroid_agreement(x0: Column, y0: Column, x1: Column, y1: Column, height: int, width: int) -> Column:
    """1 less the distance as a share of the diagonal; 0 where either centroid is missing."""
    return F.coalesce(clip(1.0 - F.hypot(x0 - x1, y0 - y1) / math.hypot(height, width), 0.0, 1.0), F.lit(0.0))


def centroid_shift(x0: Column, y0: Column, x1: Column, y1: Column, height: int, width: int) -> Column:
    """Distance as a share of the diagonal; 0 if both are missing, 1 if one is."""
    return F.when(x0.isNull() & x1.isNull(), 0.0).when(x0.isNull() | x1.isNull(), 1.0).otherwise(F.hypot(x0 - x1, y0 - y1) / math.hypot(height, width))


def route(reliability: Column, low: float = 0.33, high: float = 0.67) -> Column:
    if not 0.0 <= low < high <= 1.0:
        raise ValueError("route thresholds must satisfy 0 <= low < high <= 1")
    return F.when(reliability >= high, "high").when(reliability >= low, "medium").otherwise("low")


def selection_score(score: Column, iou: Column, edge: Column) -> Column:
    return 0.3 * score + 0.4 * iou + 0.3 * edge


def gate_score(score: Column, iou: Column, edge: Column, gamma: Column | float = 50.0) -> Column:
    return 0.3 * score + 0.4 * iou + (gamma if isinstance(gamma, Column) else F.lit(gamma)) * edge


def gate(score: Column, lower: float = 0.2, upper: float = 999.0) -> Column:
    return F.when(score < lower, "FALLBACK").when(score > upper, "FULL").otherwise("FUSION")


def fused_pixel(score: Column, mask: Column, coarse: Column) -> Column:
    """S * m + (1 - S) * c > 0.5; with a score over 1 the coarse weight is negative, as the rule has it."""
    return score * mask + (1.0 - score) * coarse > 0.5


def route_radius(route_name: Column, area: Column) -> Column:
    """Band radius from the radius of the disc of that area: 5 % within 2 to 12, 10 % within 4 to 20, or none. Halves go to even."""
    r = F.sqrt(F.greatest(area, F.lit(1.0)) / math.pi)
    return F.when(route_name == "high", clip(F.rint(0.05 * r), 2, 12)).when(route_name == "medium", clip(F.rint(0.10 * r), 4, 20)).otherwise(F.lit(0.0)).cast("int")


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, height: int, width: int, ratio: float = 0.1, least: int = 2) -> list[Column]:
    """Inclusive box with each side padded by the rounded ratio of its extent, at least so much, inside the raster."""
    px = F.greatest(F.lit(least), F.rint((x1 - x0 + 1) * ratio).cast("int"))
    py = F.greatest(F.lit(least), F.rint((y1 - y0 + 1) * ratio).cast("int"))
    return [F.greatest(F.lit(0), x0 - px), F.greatest(F.lit(0), y0 - py), F.least(F.lit(width - 1), x1 + px), F.least(F.lit(height - 1), y1 + py)]


def expanded_box(x: Column, y: Column, w: Column, h: Column, height: int, width: int, ratio: float) -> list[Column]:
    """Corner and size form grown about its centre by a ratio, truncated to integers, inside the raster."""
    nw, nh = (w * (1 + ratio)).cast("int"), (h * (1 + ratio)).cast("int")
    nx = F.greatest(F.lit(0), (x - (nw - w) / 2).cast("int"))
    ny = F.greatest(F.lit(0), (y - (nh - h) / 2).cast("int"))
    return [nx, ny, F.least(nw, F.lit(width) - nx), F.least(nh, F.lit(height) - ny)]


def look_twice_box(x: Column, y: Column, w: Column, h: Column, height: int, width: int, fill: Column | None = None, scale: float = 1.3) -> list[Column]:
    """Box (x, y, w, h) scaled about its centre, shifted back inside the raster and truncated. With a fill ratio of the box
    the scale is sqrt(2 - share of the raster / fill), else the constant."""
    k = F.lit(scale) if fill is None else F.sqrt(F.greatest(2.0 - (w * h) / float(height * width) / fill, F.lit(0.0)))
    nw, nh = w * k, h * k
    nx, ny = F.greatest(x - (nw - w) / 2, F.lit(0.0)), F.greatest(y - (nh - h) / 2, F.lit(0.0))
    nx = F.when(nx + nw > width, width - nw).otherwise(nx)
    ny = F.when(ny + nh > height, height - nh).otherwise(ny)
    return [nx.cast("int"), ny.cast("int"), nw.cast("int"), nh.cast("int")]


def box_overlaps(a: list[Column], b: list[Column], eps: float = 1e-7) -> dict[str, Column]:
    """IoU, GIoU, DIoU and CIoU of boxes (x0, y0, x1, y1)."""
    ax0, ay0, ax1, ay1 = a
    bx0, by0, bx1, by1 = b
    iw = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    ih = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    aw, ah, bw, bh = ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0
    inter = iw * ih
    union = aw * ah + bw * bh - inter + eps
    iou = inter / union
    cw, ch = F.greatest(ax1, bx1) - F.least(ax0, bx0), F.greatest(ay1, by1) - F.least(ay0, by0)
    hull = cw * ch + eps
    diagonal = cw * cw + ch * ch + eps
    apart = (F.pow(bx0 + bx1 - ax0 - ax1, F.lit(2.0)) + F.pow(by0 + by1 - ay0 - ay1, F.lit(2.0))) / 4
    v = (4 / math.pi**2) * F.pow(F.atan(bw / (bh + eps)) - F.atan(aw / (ah + eps)), F.lit(2.0))
    return {"iou": iou, "giou": iou - (hull - union) / hull, "diou": iou - apart / diagonal, "ciou": iou - (apart / diagonal + v * v / (v - iou + (1 + eps)))}


def blend_weight(fg_student: Column, fg_teacher: Column, epoch: Column, max_epoch: int, start: int) -> Column:
    """clip(0.5 (1 + cos(|difference| pi)) + epoch / (max + start), 0, 1)."""
    return clip(0.5 * (1.0 + F.cos(F.abs(fg_student - fg_teacher) * math.pi)) + epoch / float(max_epoch + start), 0.0, 1.0)


def blended(pseudo: Column, teacher: Column, weight: Column) -> Column:
    return pseudo * (1.0 - weight) + teacher * weight


def ema_decay(step: Column, alpha: float = 0.999) -> Column:
    return F.least(1.0 - 1.0 / (step + 1.0), F.lit(alpha))


def epoch_due(epoch: Column, start: int, interval: int, max_epoch: int) -> Column:
    """From the start epoch on (negative counts from the end), every interval epochs."""
    first = start if start >= 0 else max_epoch + start
    return (epoch >= first) & ((epoch - first) % interval == 0)


def adaptive_threshold(mean: Column) -> Column:
    return F.least(2.0 * mean, F.lit(1.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; a constant series is returned as it is, after division by 255 if it holds bytes."""
    return F.when(high != low, (x - low) / (high - low)).otherwise(F.when(high > 1, x / 255.0).otherwise(x))


def in_unit(bytes_: Column, unit: str) -> Column:
    powers = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}
    if unit not in powers:
        raise ValueError(f"unknown unit {unit}")
    return bytes_ / float(1024 ** powers[unit])


def entropy(p: Column) -> Column:
    return -p * F.ln(F.greatest(p, F.lit(1e-5)))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def natural_key(name: Column) -> Column:
    """Array that sorts like the name with runs of digits as numbers: digits are padded, other text is lower case."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 30, "0"))).otherwise(F.concat(F.lit("1"), F.lower(p))))


def yuv(r: Column, g: Column, b: Column) -> list[Column]:
    """Full-range BT.601 luma and chroma, chroma about 128."""
    return [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128.0, 0.5 * r - 0.418688 * g - 0.081312 * b + 128.0]


def rgb(y: Column, u: Column, v: Column) -> list[Column]:
    return [y + 1.402 * (v - 128.0), y - 0.344136 * (u - 128.0) - 0.714136 * (v - 128.0), y + 1.772 * (u - 128.0)]
