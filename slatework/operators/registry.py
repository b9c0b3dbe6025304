"""Named attribution methods: a registry, families, and the grouped application of one to a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Method = Callable[[np.ndarray, int], np.ndarray]
METHODS: dict[str, Method] = {}
FAMILIES: dict[str, list[str]] = {}


def register_attribution(name: str, family: str = "other"):
    """Decorator: register ``f(image, target) -> heatmap`` under a name, replacing an earlier one."""

    def add(f: Method) -> Method:
        METHODS[name] = f
        members = FAMILIES.setdefault(family, [])
        if name not in members:
            members.append(name)
        return f

    return add


def select_methods(chosen: list[str] | str = "all") -> list[str]:
    """Names for ``all``, family names or method names, in order and once each; unknown ones raise KeyError."""
    asked = list(METHODS) if chosen == "all" else [m for c in ([chosen] if isinstance(chosen, str) else chosen) for m in (FAMILIES[c] if c in FAMILIES else [c])]
    unknown = [m for m in asked if m not in METHODS]
    if unknown:
        raise KeyError(f"unknown methods: {unknown}")
    return list(dict.fromkeys(asked))


def attribute(images: DataFrame, methods: list[str] | str, width: int) -> DataFrame:
    """image_id, method, heatmap of every image (image_id, pixels, target) by every method, in Arrow batches."""
    chosen = {m: METHODS[m] for m in select_methods(methods)}
    kind = dict(images.dtypes)["image_id"]

    def run(batches):
        for pdf in batches:
            for name, f in chosen.items():
                maps = [np.asarray(f(np.asarray(p, dtype=float).reshape(-1, width), int(t)), dtype=float).ravel().tolist() for p, t in zip(pdf["pixels"], pdf["target"], strict=True)]
                yield pd.DataFrame({"image_id": pdf["image_id"], "method": name, "heatmap": maps})

    return images.select("image_id", "pixels", "target").mapInPandas(run, f"image_id {kind}, method string, heatmap array<double>")


def register_sql(spark: SparkSession) -> list[str]:
    """Register the text normaliser and the interior point as SQL functions; returns their names."""
    from slatework.functions.names import nfc
    from slatework.operators.spatial import polylabel

    spark.udf.register("nfc_normalize", nfc)
    spark.udf.register("polylabel", polylabel())
    return ["nfc_normalize", "polylabel"]


def soft_masks(number: int, width: int, height: int, grid: int = 12, keep: float = 0.5, seed: int = 42) -> np.ndarray:
    """number x height x width masks in 0..1: Bernoulli grids (a cell is kept with probability ``keep``), resized by bilinear weights."""
    from slatework.operators.heatmaps import axis_weights

    cells = (np.random.default_rng(seed).random((number, grid, grid)) < keep).astype(float)
    return np.clip(axis_weights(grid, height) @ (cells @ axis_weights(grid, width).T), 0.0, 1.0)


def rise(score, image: np.ndarray, masks: np.ndarray | None = None, number: int = 512, grid: int = 12, keep: float = 0.5, seed: int = 42) -> np.ndarray:
    """Masks averaged by the score of the masked image: sum(score x mask) / max(sum(mask), 1e-12). ``score`` is injected; masks are made where none are given."""
    if masks is None:
        masks = soft_masks(number, image.shape[1], image.shape[0], grid, keep, seed)
    s = np.array([score(image * m) for m in masks])
    return np.tensordot(s, masks, 1) / np.maximum(masks.sum(axis=0), 1e-12)
