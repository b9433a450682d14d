"""Column functions for colours, progress, view boxes and scales."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lightness, chroma and fallback of cluster colours, limits of a view box.
LIGHTNESS, CHROMA, NO_COLOUR = 0.7193, 0.157, "rgb(113 113 122)"
SMALLEST_VIEW, LARGEST_VIEW = 10.0, 3000.0


def colour_angle(cluster_angle: Column, leaf_angle: Column) -> Column:
    """the cluster's angle, a tenth of the way to the leaf's."""
    return cluster_angle + (leaf_angle - cluster_angle) * 0.1


def css_colour(angle: Column) -> Column:
    """F15."""
    shade = F.format_string("oklch(%s %s %.4f)", F.lit(str(LIGHTNESS)), F.lit(str(CHROMA)), F.degrees(angle))
    return F.when(angle.isNotNull(), shade).otherwise(F.lit(NO_COLOUR))


def _linear_rgb(lightness: float, chroma: np.ndarray, hue: np.ndarray) -> np.ndarray:
    """OKLCH to linear sRGB by the public OKLab matrices."""
    a, b = chroma * np.cos(hue), chroma * np.sin(hue)
    lms = np.stack([lightness + 0.3963377774 * a + 0.2158037573 * b, lightness - 0.1055613458 * a - 0.0638541728 * b, lightness - 0.0894841775 * a - 1.2914855480 * b]) ** 3
    to = np.array([[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.7076147010]])
    return to @ lms


#: Linear sRGB to linear Display P3 (public matrix of the two spaces' primaries, both under D65).
_TO_P3 = np.array([[0.8224619687, 0.1775380313, 0.0], [0.0331941989, 0.9668058011, 0.0], [0.0170826307, 0.0723974407, 0.9105199286]])


def rgb_of(angles: np.ndarray, space: str = "srgb") -> np.ndarray:
    """F16: sRGB or Display P3 (``p3``; rows of three in 0..1) of cluster angles, chroma reduced until the colour is in the gamut."""
    if space not in ("srgb", "p3"):
        raise ValueError(f"unknown colour space {space}")
    of = (lambda c: _TO_P3 @ _linear_rgb(LIGHTNESS, c, angles)) if space == "p3" else (lambda c: _linear_rgb(LIGHTNESS, c, angles))
    lo, hi = np.zeros(len(angles)), np.full(len(angles), CHROMA)
    fits = ((linear := of(hi)) >= -1e-4).all(axis=0) & (linear <= 1 + 1e-4).all(axis=0)
    for _ in range(20):
        mid = (lo + hi) / 2
        linear = of(mid)
        inside = (linear >= -1e-4).all(axis=0) & (linear <= 1 + 1e-4).all(axis=0)
        lo, hi = np.where(inside, mid, lo), np.where(inside, hi, mid)
    linear = np.clip(of(np.where(fits, CHROMA, lo)), 0, 1)
    return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055).T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def srgb(angle: pd.Series) -> pd.Series:
    """F16 as a column."""
    return pd.Series(list(rgb_of(angle.to_numpy(dtype=float))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def p3(angle: pd.Series) -> pd.Series:
    """F16 in Display P3."""
    return pd.Series(list(rgb_of(angle.to_numpy(dtype=float), "p3")))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), numerator / denominator)))


def overall_progress(render: Column, analysis: Column, cluster: Column) -> Column:
    """Stage ratios weighted 0.2, 0.6, 0.2; each column is a struct (numerator, denominator)."""
    part = lambda s: ratio(s["numerator"], s["denominator"])
    return part(render) * 0.2 + part(analysis) * 0.6 + part(cluster) * 0.2


def percent(done: Column, total: Column) -> Column:
    """F22."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(done * 100 / total).cast("int")))


def symlog(x: Column, constant: float = 1.25) -> Column:
    """F17's transform: the sign times log1p(abs / constant)."""
    return F.signum(x) * F.log1p(F.abs(x) / constant)


def scaled(value: Column, low: Column, high: Column, size: float = 1000.0) -> Column:
    """Linear to 0..size; the middle where the axis is constant."""
    return F.when(high == low, F.lit(size / 2)).otherwise((value - low) / (high - low) * size)


def zoomed(box: Column, x: Column, y: Column, factor: Column) -> Column:
    """the view box (x, y, width, height) zoomed about a focus, its width within limits; an empty one stays."""
    width = F.least(F.greatest(box["width"] * factor, F.lit(SMALLEST_VIEW)), F.lit(LARGEST_VIEW))
    real = width / box["width"]
    out = F.struct((x - (x - box["x"]) * real).alias("x"), (y - (y - box["y"]) * real).alias("y"), width.alias("width"), (box["height"] * real).alias("height"))
    return F.when((box["width"] <= 0) | (box["height"] <= 0), box).otherwise(out)


def panned(box: Column, dx: Column, dy: Column) -> Column:
    return F.struct((box["x"] + dx).alias("x"), (box["y"] + dy).alias("y"), box["width"].alias("width"), box["height"].alias("height"))


def fitting(bounds: Column, aspect: Column) -> Column:
    """The view box of an aspect around bounds (min_x, max_x, min_y, max_y); null if these are empty."""
    w, h = bounds["max_x"] - bounds["min_x"], bounds["max_y"] - bounds["min_y"]
    a = F.when((aspect > 0) & (aspect < float("inf")) & ~F.isnan(aspect), aspect).otherwise(F.lit(1.0))
    width = F.least(F.greatest(F.when(w / h > a, w).otherwise(h * a), F.lit(SMALLEST_VIEW)), F.lit(LARGEST_VIEW))
    box = F.struct((bounds["min_x"] + w / 2 - width / 2).alias("x"), (bounds["min_y"] + h / 2 - width / a / 2).alias("y"), width.alias("width"), (width / a).alias("height"))
    return F.when((w > 0) & (h > 0), box)


def meet_scale(rect: Column, box: Column) -> Column:
    return F.least(rect["width"] / box["width"], rect["height"] / box["height"])


def to_graph(x: Column, y: Column, rect: Column, box: Column) -> Column:
    """Screen to graph coordinates for a view box centred in a rectangle; null if either is empty."""
    s = meet_scale(rect, box)
    left, top = (rect[o] + (rect[d] - box[d] * s) / 2 for o, d in (("left", "width"), ("top", "height")))
    point = F.struct((box["x"] + (x - left) / s).alias("x"), (box["y"] + (y - top) / s).alias("y"))
    return F.when((rect["width"] > 0) & (rect["height"] > 0) & (box["width"] > 0) & (box["height"] > 0), point)


def screen_delta(dx: Column, dy: Column, rect: Column, box: Column) -> Column:
    s = meet_scale(rect, box)
    return F.when((rect["width"] > 0) & (rect["height"] > 0) & (box["width"] > 0) & (box["height"] > 0), F.struct((dx / s).alias("x"), (dy / s).alias("y")))


def padded_bounds(box: Column, scale: Column, pixels: float = 24.0) -> Column:
    """What is visible, with a margin in pixels."""
    p = scale * pixels
    return F.struct((box["x"] - p).alias("min_x"), (box["x"] + box["width"] + p).alias("max_x"), (box["y"] - p).alias("min_y"), (box["y"] + box["height"] + p).alias("max_y"))


def inside(x: Column, y: Column, bounds: Column) -> Column:
    """P18."""
    return x.between(bounds["min_x"], bounds["max_x"]) & y.between(bounds["min_y"], bounds["max_y"])


def leaf_angle(rank: Column, n: Column) -> Column:
    """Rank counts from 0."""
    return (rank + 0.5) * (2 * math.pi) / n
