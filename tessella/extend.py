"""Extension points: named registries, and candidate providers that turn prompts into masks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessella.operators import kernels


class Registry:
    """Names to objects. A name is taken once; an unknown one raises KeyError."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str | None = None):
        def add(item):
            key = name or item.__name__
            if key in self._items:
                raise KeyError(f"{self.kind} {key} is registered already")
            self._items[key] = item
            return item

        return add

    def get(self, name: str):
        if name not in self._items:
            raise KeyError(f"no {self.kind} {name}; there are {sorted(self._items)}")
        return self._items[name]

    def __contains__(self, name: str) -> bool:
        return name in self._items


PROVIDERS = Registry("candidate provider")
FUNCTIONS = Registry("function")


def register_sql_functions(spark: SparkSession) -> None:
    """Makes every registered function, a user-defined function of Spark, callable in SQL."""
    for name, f in FUNCTIONS._items.items():
        spark.udf.register(name, f)


def check_box(box, height: int, width: int) -> None:
    x0, y0, x1, y1 = box
    if not (0 <= x0 <= x1 < width and 0 <= y0 <= y1 < height):
        raise ValueError(f"box {tuple(box)} is not inside {width} x {height}")


def provide_candidates(rows: DataFrame, provider: Callable[[], object]) -> DataFrame:
    """Candidate masks of every image and prompt. rows has image_name, h, w, data (RGB bytes) and prompts; provider() gives an
    object with encode(image) and predict(points, labels, box) -> [(mask, score), ...]. An image is encoded once for all its prompts, and
    not at all without any. The order of rows is free; (image_name, prompt_name, mask_index) is the key."""

    def run(frames):
        model = provider()
        for pdf in frames:
            out = []
            for name, h, w, data, prompts in zip(pdf["image_name"], pdf["h"], pdf["w"], pdf["data"], pdf["prompts"]):
                if prompts is None or not len(prompts):
                    continue
                model.encode(np.frombuffer(bytes(data), np.uint8).reshape(h, w, 3))
                for p in prompts:
                    box = p["box_xyxy"]
                    if box is not None:
                        check_box(box, h, w)
                    pos, neg = (np.array([list(x) for x in p[k]], int).reshape(-1, 2) for k in ("positive_points", "negative_points"))
                    found = model.predict(np.concatenate([pos, neg]), np.array([1] * len(pos) + [0] * len(neg)), box)
                    out += [(name, p["name"], i, float(s), h, w, kernels.pack_mask(m)) for i, (m, s) in enumerate(found)]
            yield pd.DataFrame(out, columns=["image_name", "prompt_name", "mask_index", "score", "h", "w", "mask"])

    return rows.select("image_name", "h", "w", "data", "prompts").mapInPandas(run, "image_name string, prompt_name string, mask_index long, score double, h int, w int, mask binary")
