"""Operators over raster columns: array<double> of a fixed height and width, row by row.

Arithmetic over pixels is native (higher-order functions in the row, no explode). Neighbourhoods and components run in Arrow
functions over whole batches of rasters at once. Full-size images come as binary columns to the kernels; they are never exploded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels


def mask_of(v: Column, threshold: float = 0.0) -> Column:
    return F.transform(v, lambda x: x.cast("double") > threshold)


def soft_of(v: Column, shift: float = 0.5) -> Column:
    return F.transform(v, lambda x: F.least(F.greatest(x.cast("double") + shift, F.lit(0.0)), F.lit(1.0)))


def area(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x)).cast("long")


def both(a: Column, b: Column) -> Column:
    return area(F.zip_with(a, b, lambda x, y: x & y))


def either(a: Column, b: Column) -> Column:
    return area(F.zip_with(a, b, lambda x, y: x | y))


def iou(a: Column, b: Column, empty: float = 1.0) -> Column:
    u = either(a, b)
    return F.when(u == 0, F.lit(empty)).otherwise(both(a, b) / u)


def mean_absolute(soft: Column, mask: Column, n: int) -> Column:
    return F.aggregate(F.zip_with(soft, mask, lambda x, y: F.abs(x - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / n


def true_places(mask: Column) -> Column:
    return F.filter(F.transform(mask, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())


def moments(mask: Column, width: int) -> dict[str, Column]:
    """Centroid and bounding box of the true pixels; null without any."""
    at = true_places(mask)
    n = F.nullif(F.size(at), F.lit(0))
    xs, ys = F.transform(at, lambda i: i % width), F.transform(at, lambda i: F.floor(i / width).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return {"cx": total(xs) / n, "cy": total(ys) / n, "x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def share(v: Column, test: Callable[[Column], Column], n: int) -> Column:
    """Share of the pixels that pass the test."""
    return F.size(F.filter(v, test)) / n


def _stack(column: pa.Array, height: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), height, width)


#: Pixels of a stack that a function gets at once.
STACK_PIXELS = 4 << 20


def map_rasters(rows: DataFrame, keep: list[str], rasters: list[str], height: int, width: int, function: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """keep, then the columns that function returns for stacks (n, height, width) of the raster columns. A row with a null raster, a null
    in one, or one of another size has null results. Lists in the result come as object arrays or 2-D arrays."""
    fit = F.lit(True)
    for c in rasters:
        fit = fit & F.coalesce((F.size(c) == height * width) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))
    source = rows.select(*keep, *(F.when(fit, F.col(c).cast("array<double>")).alias(f"__{i}") for i, c in enumerate(rasters)))
    k, names = len(keep), [x.split()[0] for x in schema.split(", ")]
    step = max(1, STACK_PIXELS // (height * width))

    def arrays_of(batch) -> list[pa.Array]:
        out = function(*(_stack(batch.column(k + i), height, width) for i in range(len(rasters))))
        return [pa.array(list(v)) if v.ndim > 1 or v.dtype == object else pa.array(v) for v in (out[n] for n in names)]

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                good = batch.column(k).is_valid()
                fitting = batch.filter(good)
                if len(fitting) == len(batch):
                    arrays = arrays_of(batch)
                elif len(fitting):
                    place = np.cumsum(good.to_numpy(zero_copy_only=False)) - 1
                    arrays = [x.take(pa.array(place, mask=~good.to_numpy(zero_copy_only=False))) for x in arrays_of(fitting)]
                else:
                    arrays = [pa.nulls(len(batch))] * len(names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *arrays], names=[*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    return source.mapInArrow(run, f"{kept}, {schema}")


def component_columns(masks: np.ndarray, least_pixels: int = 1, expected: int = 1) -> dict[str, np.ndarray]:
    """Count, areas (falling), effective count, largest component's box and centroid, extra mass beyond the expected largest."""
    labels = kernels.least_labels(masks > 0)
    n, h, w = labels.shape
    flat = labels.reshape(n, -1)
    counts = np.zeros((n, h * w), np.int64)
    row, at = np.nonzero(flat >= 0)
    np.add.at(counts, (row, flat[row, at]), 1)
    areas = -np.sort(-counts, 1)
    total = counts.sum(1)
    largest = counts.argmax(1)
    big = labels == largest.reshape(-1, 1, 1)
    big &= (total > 0).reshape(-1, 1, 1)
    yy, xx = np.indices((h, w))
    size = big.sum((1, 2))
    safe = np.maximum(size, 1)
    none = size == 0
    edge = lambda v, far, f: np.where(none, -1, f(np.where(big, v, far), axis=(1, 2)))
    top = areas[:, :expected].sum(1)
    return {
        "component_count": (counts > 0).sum(1),
        "effective_count": (counts >= max(least_pixels, 1)).sum(1),
        "foreground_area": total,
        "largest_area": areas[:, 0],
        "cx": np.where(none, -1.0, (big * xx).sum((1, 2)) / safe),
        "cy": np.where(none, -1.0, (big * yy).sum((1, 2)) / safe),
        "x0": edge(xx, w, np.min), "y0": edge(yy, h, np.min), "x1": edge(xx, -1, np.max), "y1": edge(yy, -1, np.max),
        "top_k_mass": np.where(total > 0, top / np.maximum(total, 1), 1.0),
        "extra_mass": np.where(total > 0, 1 - top / np.maximum(total, 1), 0.0),
    }


COMPONENT_SCHEMA = "component_count long, effective_count long, foreground_area long, largest_area long, cx double, cy double, x0 long, y0 long, x1 long, y1 long, top_k_mass double, extra_mass double"


def boundary_scores(pred: np.ndarray, truth: np.ndarray, tolerance: int, width: int) -> dict[str, np.ndarray]:
    """BF within the tolerance (up to 4 or so pixels: by dilation with the disc) and boundary IoU of two stacks of masks."""
    a, b = kernels.gradient_boundary(pred > 0), kernels.gradient_boundary(truth > 0)
    d = np.arange(-tolerance, tolerance + 1)
    disc = np.argwhere((d[:, None] ** 2 + d[None, :] ** 2) <= tolerance**2) - tolerance
    na, nb = a.sum((1, 2)), b.sum((1, 2))
    p = (a & kernels.dilate(b, disc)).sum((1, 2)) / np.maximum(na, 1)
    r = (b & kernels.dilate(a, disc)).sum((1, 2)) / np.maximum(nb, 1)
    some = (na > 0) & (nb > 0)
    p, r = np.where(some, p, 0.0), np.where(some, r, 0.0)
    u, v = kernels.inner_boundary(pred > 0, width), kernels.inner_boundary(truth > 0, width)
    union = (u | v).sum((1, 2))
    return {"bf": np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0), "p_b": p, "r_b": r, "boundary_iou": np.where(union > 0, (u & v).sum((1, 2)) / np.maximum(union, 1), 1.0)}


def labels_of_masks(masks: np.ndarray) -> dict[str, np.ndarray]:
    return {"labels": kernels.least_labels(masks > 0).reshape(len(masks), -1)}


def evaluate_pairs(rows: DataFrame, keep: list[str], pred: str, truth: str, height: int, width: int, bands: tuple[int, ...] = ()) -> DataFrame:
    """All pair metrics of mask columns, one Arrow pass over whole stacks."""
    names = list(kernels.pair_metrics(np.ones((2, 2), bool), np.ones((2, 2), bool), bands))
    whole = {"component_count", "component_count_delta", "component_count_error"}

    def run(p: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        found = kernels.pair_metrics_stack(p > 0, g > 0, bands)
        return {n: found[n].astype(np.int64 if n in whole else float) for n in names}

    return map_rasters(rows, keep, [pred, truth], height, width, run, ", ".join(f"{n} {'long' if n in whole else 'double'}" for n in names))


def curve_means(curves: DataFrame, by: list[str], curve: str) -> DataFrame:
    """(by, max, mean) of the mean curve over rows: curves are averaged first."""
    points = curves.select(*by, F.posexplode(curve).alias("k", "v")).groupBy(*by, "k").agg(F.avg("v").alias("v"))
    return points.groupBy(*by).agg(F.max("v").alias("max"), F.avg("v").alias("mean"))
