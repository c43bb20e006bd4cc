import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laneflow.operators import descent, regression

CELLS, STEPS = 4, 3
INPUTS = "location string, split string, history array<array<double>>, actual array<double>"


def rows(location, train, validation, ahead=1, seed=1):
    rng = random.Random(seed)
    out = []
    for n in range(train + validation):
        history = [[rng.uniform(20, 90) for _ in range(CELLS)] for _ in range(STEPS)]
        actual = [0.7 * history[-1][c % CELLS] + 12 + rng.gauss(0, 3) for c in range(CELLS * ahead)]
        if n % 9 == 0:
            actual[0] += 400  # odd windows
        out.append((location, "train" if n < train else "validation", history, actual))
    return out


def plain(samples, config, ahead=1):
    """The same fit as one numpy loop: errors of each epoch, the best weights, and when they were seen."""
    x = (np.array([s[2] for s in samples]) - 60) / 10
    y = ((np.array([s[3] for s in samples]) - 60) / 10).reshape(len(samples), ahead, CELLS)
    train = np.array([s[1] == "train" for s in samples])
    lag, offset = np.zeros((ahead, STEPS)), np.zeros((ahead, CELLS))
    moments = [np.zeros_like(v) for v in (lag, offset, lag, offset)]
    log, best = [], None
    for epoch in range(config.epochs + 1):
        r = y - np.einsum("sl,nlc->nsc", lag, x) - offset
        root = np.sqrt(1 + r**2)
        loss, val = (root[train] - 1).mean(), (root[~train] - 1).mean() if (~train).any() else None
        if val is None or best is None or val < best[1]:
            best = (epoch, val, lag.copy(), offset.copy())
        log.append((epoch, loss, val, best[0]))
        if epoch - best[0] >= config.patience:
            break
        push = (r / root)[train]
        n = push.size
        gradients = [-np.einsum("nsc,nlc->sl", push, x[train]) / n, -push.sum(axis=0) / n]
        for i, g in enumerate(gradients):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 2] = np.maximum(0.999 * moments[i + 2], abs(g))
        rate = config.rate / (1 - 0.9 ** (epoch + 1))
        lag = lag - rate * moments[0] / (moments[2] + 1e-8)
        offset = offset - rate * moments[1] / (moments[3] + 1e-8)
    return log, best


@pytest.fixture(scope="module")
def groups():
    return {"a": rows("a", 40, 10), None: rows(None, 30, 5, seed=2), "no validation": rows("no validation", 8, 0, seed=3)}


@pytest.fixture(scope="module")
def fitted(spark, groups):
    untrained = [("no train", "validation", *r[2:]) for r in rows("", 3, 0)]
    everything = sum(groups.values(), []) + untrained + [("a", "test", [[None]], [None])]
    random.Random(4).shuffle(everything)
    inputs = spark.createDataFrame(everything, INPUTS).repartition(3)
    return descent.fit(inputs, CELLS, descent.Descent(rate=0.3, epochs=9, patience=1))


def test_epochs_and_weights_equal_plain_code(groups, fitted):
    log = fitted.log.orderBy("epoch").collect()
    weights = {w.location: w for w in fitted.weights.collect()}
    assert set(weights) == set(groups)  # no train samples, no model
    stopped = 0
    for location, samples in groups.items():
        told, (best, _, lag, offset) = plain(samples, descent.Descent(rate=0.3, epochs=9, patience=1))
        mine = [r for r in log if r.location == location]
        assert [(r.epoch, r.best_epoch) for r in mine] == [(t[0], t[3]) for t in told]
        assert [r.loss for r in mine] == pytest.approx([t[1] for t in told])
        assert [r.val_loss for r in mine] == (
            [None] * len(told) if told[0][2] is None else pytest.approx([t[2] for t in told])
        )
        assert [r.running for r in mine] == [True] * (len(told) - 1) + [False]
        stopped += len(told) < 10
        w = weights[location]
        assert w.per_lag == pytest.approx(lag[0].tolist())
        assert w.per_cell == pytest.approx((60 + 10 * offset[0] - 60 * lag[0].sum()).tolist())
    assert stopped and any(r.best_epoch == 9 for r in log)


def test_model_forecasts_like_its_predictor(spark, groups, fitted):
    samples = groups["a"][:3]
    inputs = spark.createDataFrame([(i, *s) for i, s in enumerate(samples)], f"sample_id int, {INPUTS}")
    scored = fitted.model.transform(regression.lag_rows(inputs, CELLS)).orderBy("sample_id", "cell").collect()
    predict = fitted.model.predictor("a")()
    expected = predict(np.array([s[2] for s in samples]))
    assert [r.prediction for r in scored] == pytest.approx(expected.ravel().tolist())


def test_steps_have_weights_of_their_own(spark):
    samples = rows("a", 30, 6, ahead=2)
    config = descent.Descent(rate=0.1, epochs=3)
    out = descent.fit(spark.createDataFrame(samples, INPUTS), CELLS, config).weights.orderBy("step").collect()
    _, (_, _, lag, _) = plain(samples, config, ahead=2)
    assert [w.step for w in out] == [0, 1]
    assert np.array([w.per_lag for w in out]) == pytest.approx(lag)


def test_no_samples_give_no_model(spark):
    out = descent.fit(spark.createDataFrame([], INPUTS), CELLS)
    assert out.weights.count() == 0 and out.log.count() == 0


def test_missing_speeds_fail_the_fit(spark):
    inputs = spark.createDataFrame([("a", "train", [[1.0, None, 1.0, 1.0]], [1.0] * 4)], INPUTS)
    with pytest.raises(Exception, match="missing speeds"):
        descent.fit(inputs, CELLS)
    with pytest.raises(ValueError, match="channels"):
        descent.fit(inputs, regression.Lags(CELLS, features=2))
    assert inputs.filter(F.col("split") == "train").count() == 1
