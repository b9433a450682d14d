import warnings

import numpy as np
import pytest

from cairnflow.operators import features

RNG = np.random.default_rng(11)
FEW, MANY = RNG.normal(size=(5, 7)).tolist(), RNG.normal(size=(9, 4)).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()])


def svd_scores(x, k):
    x = np.asarray(x, float) - np.mean(x, axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    return x @ vt[:k].T


def test_features_without_emphasis_are_components(spark):
    got = column(features.build_features(frame(spark, FEW), "v", "f", dims=3), "f")
    assert np.allclose(np.abs(got), np.abs(svd_scores(FEW, 3)), atol=1e-9)


def test_features_without_pca_are_the_vectors(spark):
    got = column(features.build_features(frame(spark, FEW), "v", "f", use_pca=False, dims=2, emphasis={"serif": 4}, directions={"serif": [1.0] + [0.0] * 6}), "f")
    assert got.tolist() == FEW


def test_scatter_axes_are_standardised(spark):
    out = features.scatter(frame(spark, MANY), "v").orderBy("id").collect()
    xy = np.array([[r.two.x, r.two.y] for r in out])
    assert np.allclose(xy.mean(axis=0), 0, atol=1e-9) and np.allclose(xy.var(axis=0), 1)


def test_scatter_of_a_single_column(spark):
    out = features.scatter(frame(spark, [[1], [2], [3]]), "v").orderBy("id").collect()
    assert [r.two.y for r in out] == [0, 0, 0]
    assert out[0].two.x < out[1].two.x < out[2].two.x


def test_gram_schmidt():
    rows = RNG.normal(size=(4, 6))
    q = features.orthonormal(np.concatenate([rows, rows[:1] + rows[2:3]]))  # the last one depends on the others
    assert np.allclose(q[:4] @ q[:4].T, np.eye(4)) and not q[4].any()
    assert np.allclose(rows @ q[:4].T, np.tril(rows @ q[:4].T))


def test_emphasis_doubles_with_each_level(spark):
    rows = (RNG.normal(size=(8, 32)) / 20).tolist()
    direction = [0.0] * 31 + [1.0]
    one, two = (column(features.build_features(frame(spark, rows), "v", "f", dims=4, emphasis={"serif": k}, directions={"serif": direction}), "f")[:, -1] for k in (1, 2))
    assert abs(one.mean()) < 1e-9 and np.allclose(two, 2 * one)
    same = [column(features.build_features(frame(spark, rows), "v", "f", dims=4, emphasis=e, directions=d), "f") for e, d in ((None, None), ({"serif": 0}, {"serif": direction}))]
    assert np.allclose(*same)


def test_missing_directions_are_skipped(spark):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        got = column(features.build_features(frame(spark, FEW), "v", "f", dims=3, emphasis={"thin": 2}), "f")
    assert any("directions" in str(w.message) for w in seen) and got.shape == (5, 3)


def test_components_need_two_rows(spark):
    with pytest.raises(ValueError):
        features.pca(frame(spark, [[1, 2]]), "v", 2, "s")
