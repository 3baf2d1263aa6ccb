"""The positive-unlabelled risk, its gradient, and the class prior, on texts whose classes are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def text(rng, good):
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(3, 9)))) for _ in range(int(rng.integers(40, 90)))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
    return " ".join(w if rng.random() < 0.6 else "!!" + str(rng.integers(0, 999)) + "|" for w in words)


def sample(spark, n, prior, share, seed):
    """n texts, a share of whose good ones is labelled; and which are good."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < prior
    rows = [(i, text(rng, g), bool(g and rng.random() < share)) for i, g in enumerate(good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, positive boolean").repartition(5)
    return docs, good


@pytest.fixture(scope="module")
def rows(spark):
    docs, _ = sample(spark, 500, 0.5, 0.4, 1)
    return quality.feature_table(docs, "doc_id", "text").join(docs.select("doc_id", "positive"), "doc_id").cache()


def fitted_scale(m):
    mean = m.total / m.n
    scale = np.sqrt(np.maximum(m.squares / m.n - mean**2, 0))
    mean[-1], scale[scale < 1e-3] = 0, 1.0
    return scale, mean


def test_risk_and_gradient(rows):
    m = quality.moments(rows)
    pdf = rows.toPandas()
    assert (m.n, m.n_positive) == (len(pdf), pdf["positive"].sum())
    model = quality.PuModel(*fitted_scale(m))
    model.prior = 0.45
    rng = np.random.default_rng(0)
    model.w = rng.standard_normal(quality.N_FEATURES) * 0.05
    positive, negative, gradient, hessian = model.risk(rows, m)
    x, p = model(pdf), pdf["positive"].to_numpy()

    def plain(w):
        f = x @ w
        return 0.45 * np.logaddexp(0, -f[p]).mean(), np.logaddexp(0, f).mean() - 0.45 * np.logaddexp(0, f[p]).mean()

    assert (positive, negative) == pytest.approx(plain(model.w), rel=1e-9)
    for i in rng.choice(quality.N_FEATURES, 12, replace=False):
        step = np.zeros(quality.N_FEATURES)
        step[i] = 1e-5
        up, down = sum(plain(model.w + step)), sum(plain(model.w - step))
        assert gradient[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    f = 1 / (1 + np.exp(-(x @ model.w)))
    assert hessian == pytest.approx((x * (f * (1 - f))[:, None]).T @ x / len(x), abs=1e-9)


def test_risk_on_negatives_stays_above_zero(rows):
    """With a prior far too high, unbounded steps would drive it below."""
    m = quality.moments(rows)
    model = quality.PuModel(*fitted_scale(m))
    for prior in (0.5, 0.9, 0.99):
        model.prior, model.w = prior, np.zeros(quality.N_FEATURES)
        before = sum(model.risk(rows, m)[:2])
        model.newton(rows, m, 4)
        positive, negative, _, _ = model.risk(rows, m)
        assert negative >= 0 and positive + negative <= before + 1e-9


@pytest.mark.parametrize("prior", [0.3, 0.6])
def test_prior_and_scores(spark, prior):
    docs, good = sample(spark, 2000, prior, 0.3, 2)
    labels = docs.where("positive").select("doc_id", F.lit(1).alias("quality"))
    got = quality.score_quality(docs.select("doc_id", "text"), labels).collect()
    estimate = got[0]["class_prior"]
    assert abs(estimate - good.mean()) < 0.08
    held = [(r["score"] >= 0.5) == good[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.95
