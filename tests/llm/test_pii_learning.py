import functools
from collections import Counter

import numpy as np
import pytest

from cairnflow.llm import boosting, pii


def test_every_text_is_learned_from(spark, monkeypatch):
    texts = [f"number {i} of 555-{i:04d} and {i % 7}.{i % 5}.1.{i % 300}" for i in range(3500)] + ["nobody (at) example.org", "call 12 or +1 (826) 555-4081 now " * 700]
    assert len(texts) > 3000 and len(texts[-1]) > 20_000  # more and longer than any sample once was
    seen = []
    monkeypatch.setattr(pii, "fit_table", lambda rows, *a: seen.extend(rows.collect()) or ({}, {}), raising=False)
    pii.train(spark.createDataFrame([(t,) for t in [*texts, *texts[:50], None, "", "no sign of anything"]], "text string").repartition(5))
    want, good = Counter(), Counter()
    for t in texts:
        for k, y, x in pii.examples(t):
            key = k, bytes(np.searchsorted(pii.CUTS, [int(v) for v in x]).astype(np.uint8))
            want[key] += 1
            good[key] += y
    got, got_good = Counter(), Counter()
    for r in seen:
        got[r.kind, bytes(r.x)] += r.n
        got_good[r.kind, bytes(r.x)] += r.good
    assert got == want and +got_good == +good


def test_long_texts_alone_give_models(spark, monkeypatch):
    monkeypatch.setattr(pii, "fit_table", functools.partial(boosting.fit_table, trees=2), raising=False)
    long = "some words of 12 things and 555 others, written down on page 7 " * 400
    assert len(long) > 20_000
    found = pii.train(spark.createDataFrame([(f"{long} {i}",) for i in range(60)], "text string"))
    assert found.trees and found.trees.keys() == found.thresholds.keys()


def test_trees_of_a_table_equal_those_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEPT", 2)
    monkeypatch.setattr(boosting, "SHARE", 700)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (5000, 4))
    y = (((x[:, 0] > 5) ^ (x[:, 2] > 3)) | (rng.random(5000) < 0.05)).astype(int)
    tested = rng.random(5000) < 0.2
    rows = [(k, bytes(map(int, r)), bool(t), 2, 2 * int(c if k == "a" else 1 - c)) for k in "ab" for r, c, t in zip(x, y, tested, strict=True)]
    rows += [("alone", bytes(4), False, 1, 1), ("untested", bytes(4), False, 1, 1), ("untested", bytes(4), False, 1, 0)]
    df = spark.createDataFrame(rows, "kind string, x binary, tested boolean, n long, good long").repartition(6)
    models, thresholds = boosting.fit_table(df, np.arange(31), 0.9, trees=5)
    assert models.keys() == thresholds.keys() == {"a", "b"}
    for k, truth in (("a", y), ("b", 1 - y)):
        twice = [np.repeat(v, 2, axis=0) for v in (x[~tested], truth[~tested])]
        plain = boosting.Boosted(trees=5).fit(*twice).predict(x.astype(float))
        p = models[k].predict(x.astype(float))
        assert p == pytest.approx(plain, abs=1e-3)
        assert thresholds[k] == boosting.threshold(boosting.steps(p[tested]), truth[tested], 0.9)
