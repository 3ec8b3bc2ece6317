"""The mapped SVC fit: as good an optimum as MLlib's on the same objective, without MLlib's fit and its cached map."""

import numpy as np
import pytest

from vitalis.operators import models as MD
from vitalis.operators import svc


def _rows(spark, n=600):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n)) > 0).astype(int)
    return spark.createDataFrame([(*map(float, r), 5.0, int(v)) for r, v in zip(x, y)], "a double, b double, c double, same double, label int")


def _loss(rows, feats, spec, coefficients, intercept, weights):
    data = np.array([[r[f] for f in feats] for r in rows])
    z = np.sqrt(2 / len(spec[1])) * np.cos(data @ np.asarray(spec[0]).T + spec[1])
    y = np.array([2 * r["label"] - 1 for r in rows])
    return float(weights @ np.maximum(0, 1 - y * (z @ coefficients + intercept)) / weights.sum())


@pytest.mark.parametrize("reg", [0.0, 0.01])
def test_optimum_is_that_of_mllib(spark, reg):
    feats = ["a", "b", "c", "same"]
    df = MD.P.class_weights(_rows(spark), "label", "weight")
    spec = MD.rff_spec(4, 0.3, 20)
    vec = MD.Fitted("SVC", None, feats, rff=spec)._vectors(df)
    mllib = MD.estimator("SVC", {"regParam": reg}, "weight").fit(vec)
    coefficients, intercept = svc.fit_svc(df, feats, spec, "label", "weight", {"regParam": reg})
    rows = df.collect()
    w = np.array([r["weight"] for r in rows])
    ours, theirs = (_loss(rows, feats, spec, c, b, w) for c, b in ((coefficients, intercept), (mllib.coefficients.toArray(), mllib.intercept)))
    assert abs(ours - theirs) < 0.02 * theirs


def test_mapped_rows_are_not_kept(spark, monkeypatch):
    """The fit goes over the rows themselves: MLlib's, which caches all mapped features, has no part in it."""
    def refuse(*_, **__):
        raise AssertionError("MLlib's fit")
    monkeypatch.setattr(MD, "estimator", refuse)
    df = _rows(spark)
    fitted = MD.fit("SVC", df, ["a", "b", "c"], "label")
    right = fitted.transform(df).where("prediction = label").count()
    assert right > 0.8 * df.count()       # half of the rows without the map


def test_steps_are_searched_a_pass_at_a_time():
    calls = []

    def f(points):
        calls.append(len(points))
        return [(float((p - 3) @ (p - 3)) + 1, 2 * (p - 3)) for p in points]

    assert np.allclose(svc.minimize(f, 4, 100, 1e-9), 3, atol=1e-3)
    assert len(calls) < 20


def test_what_cannot_be_fitted_is_said(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1)], "a double, label int")
    with pytest.raises(Exception, match="no finite number"):
        svc.fit_svc(df, ["a"], MD.rff_spec(1, 0.5, 5), "label")
