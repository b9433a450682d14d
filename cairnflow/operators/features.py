"""Feature matrices: principal components, attribute emphasis, scatter coordinates."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Floors that the definitions fix.
SMALLEST_STD, SMALLEST_NORM = 1e-6, 1e-6


def orthonormal(rows: np.ndarray) -> np.ndarray:
    """V6: modified Gram-Schmidt in the given order; a row that is left with a norm of at most 1e-6 becomes zero."""
    out = np.zeros_like(rows, dtype=float)
    for i, row in enumerate(np.asarray(rows, dtype=float)):
        rest = row.copy()
        for done in out[:i]:
            rest -= (rest @ done) * done
        norm = np.sqrt(rest @ rest)
        out[i] = rest / norm if norm > SMALLEST_NORM else 0.0
    return out


def column_moments(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A5: means and population standard deviations of a vector column's components."""
    v = array_to_vector(F.col(column).cast("array<double>"))
    n, mean, var = df.select(F.count("*"), Summarizer.mean(v), Summarizer.variance(v)).first()
    if not n:
        return np.zeros(0), np.zeros(0)
    variance = np.asarray(var) * (n - 1) / n if n > 1 else np.zeros(len(mean))
    return np.asarray(mean), np.sqrt(np.maximum(variance, 0))


def component_moments(df: DataFrame, column: str) -> DataFrame:
    """A5 as a table: (component, mean, std) of a vector column."""
    each = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("component", "x"))
    return each.groupBy("component").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def pca(df: DataFrame, column: str, dims: int, out: str) -> DataFrame:
    """V4: centred scores on the first components, without whitening; each loading's largest entry is positive.

    MLlib gathers the covariance on the executors; its size is the square of the vector length, not of the rows.
    """
    n, p = df.select(F.count("*"), F.max(F.size(column))).first()
    if n < 2 or (p or 0) < 2:
        raise ValueError("principal components need two rows and two columns")
    k = max(1, min(dims, n, p))
    vectors = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    loadings = PCA(k=k, inputCol="_v", outputCol="_s").fit(vectors).pc.toArray()
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    mean, _ = column_moments(df, column)
    return project(df, column, loadings.T, mean, out)


def project(df: DataFrame, column: str, rows: np.ndarray, centre: np.ndarray, out: str) -> DataFrame:
    """Coordinates of (vector - centre) along the rows of a small matrix, as an array column: a matrix product for each Arrow batch."""
    axes, shift = np.asarray(rows, dtype=float).T.copy(), np.asarray(rows, dtype=float) @ np.asarray(centre, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def coordinates(vectors: pd.Series) -> pd.Series:
        some = vectors.dropna()
        if some.empty:
            return pd.Series([None] * len(vectors), dtype=object)
        found = np.stack(some.to_numpy()).astype(float) @ axes - shift
        return pd.Series([*found], index=some.index, dtype=object).reindex(vectors.index)

    return df.withColumn(out, coordinates(F.col(column).cast("array<double>")))


def standardize(df: DataFrame, column: str, out: str) -> DataFrame:
    """Every component less its mean, over its population standard deviation of at least 1e-6."""
    mean, std = column_moments(df, column)
    m, s = (F.array(*map(F.lit, map(float, x))) for x in (mean, np.maximum(std, SMALLEST_STD)))
    centred = F.zip_with(F.col(column).cast("array<double>"), m, lambda x, y: x - y)
    return df.withColumn(out, F.zip_with(centred, s, lambda x, y: x / y))


def build_features(df: DataFrame, column: str, out: str, use_pca: bool = True, dims: int = 64, emphasis: dict[str, int] | None = None, directions: dict[str, list[float]] | None = None) -> DataFrame:
    """The clustering features of a vector column.

    Without PCA the vectors themselves, whatever the emphasis. Emphasised attributes become axes of their own: the
    coordinate along the attribute's direction (made orthonormal in the order of names), standardised, times the mean
    spread of the base axes and two to the power of the level. Base axes are components of what is left of the vectors.
    Missing directions are warned about and skipped.
    """
    if not use_pca:
        return df.withColumn(out, F.col(column).cast("array<double>"))
    levels = {a: max(-4, min(4, v)) for a, v in sorted((emphasis or {}).items()) if v}
    if levels and not directions:
        warnings.warn("no attribute directions: emphasis is left out", stacklevel=2)
    known = [a for a in levels if a in (directions or {})]
    for a in set(levels) - set(known):
        if directions:
            warnings.warn(f"no direction for {a}", stacklevel=2)

    def base(d: DataFrame, c: str) -> DataFrame:
        n, p = d.select(F.count("*"), F.max(F.size(c))).first()
        return d.withColumn("_base", F.col(c).cast("array<double>")) if n < 2 or (p or 0) <= dims else pca(d, c, dims, "_base")

    if not known:
        return base(df, column).withColumn(out, F.col("_base")).drop("_base")
    axes = orthonormal(np.array([directions[a] for a in known], dtype=float))
    along = project(df, column, axes, np.zeros(axes.shape[1]), "_axes")
    shadow = F.array(*(F.aggregate(F.zip_with(F.col("_axes"), F.array(*map(F.lit, map(float, col))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for col in axes.T))
    rest = base(along.withColumn("_rest", F.zip_with(F.col(column).cast("array<double>"), shadow, lambda x, y: x - y)), "_rest")
    scale = max(float(column_moments(rest, "_base")[1].mean()), SMALLEST_STD)  # A16
    weighted = F.zip_with(F.col("_z"), F.array(*(F.lit(scale * 2.0 ** levels[a]) for a in known)), lambda x, y: x * y)
    return standardize(rest, "_axes", "_z").withColumn(out, F.concat("_base", weighted)).drop("_axes", "_rest", "_base", "_z")


def scatter(df: DataFrame, column: str, out: str = "two") -> DataFrame:
    """V9: two standardised principal coordinates; a missing or constant axis is 0."""
    n, p = df.select(F.count("*"), F.max(F.size(column))).first()
    flat = pca(df, column, 2, "_p") if n >= 2 and (p or 0) > 2 else df.withColumn("_p", F.col(column).cast("array<double>"))
    z = standardize(flat, "_p", "_z") if n else flat.withColumn("_z", F.col("_p"))
    at = lambda i: F.coalesce(F.get("_z", F.lit(i)), F.lit(0.0))
    return z.withColumn(out, F.struct(at(0).alias("x"), at(1).alias("y"))).drop("_p", "_z")
