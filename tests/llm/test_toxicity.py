"""The recurrent network against plain loops and finite differences; scores on held-out labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.llm import recurrent as net, toxicity
from aislewise.llm.common import table

FOLDER = "/root/testdata/sf0.1"


def plain_logit(network, words):
    """The logit of one window, token by token."""
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    h = net.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def embedded(word):
        tokens, _ = net.distinct_tokens(word, np.array([0]), np.array([len(word)]))
        return np.r_[w["word"][tokens.word[0]], w["character"][tokens.character].mean(0)]

    gates = [embedded(word) @ w["input"] + w["bias"] for word in words]
    sides = []
    for name, part, order in (("forward", slice(0, 3 * h), 1), ("backward", slice(3 * h, None), -1)):
        state, states = np.zeros(h), []
        for g in gates[::order]:
            a, b = g[part], state @ w[name]
            z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h:2 * h] + b[h:2 * h])
            state = (1 - z) * np.tanh(a[2 * h:] + r * b[2 * h:]) + z * state
            states.append(state)
        sides.append(states[::order])
    if not words:
        return w["out_bias"][0]
    states = np.hstack([np.array(s) for s in sides])
    score = np.tanh(states @ w["attend"]) @ w["query"]
    weight = np.exp(score - score.max())
    return (weight / weight.sum()) @ states @ w["out"] + w["out_bias"][0]


def plain_windows(text):
    words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")
             if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w).encode() for w in words]
    if len(words) <= net.WIDTH:
        return [words]
    last = len(words) - net.WIDTH
    return [words[k:k + net.WIDTH] for k in {*range(0, last, net.STRIDE), last}]


@pytest.mark.parametrize("group, part", [(2048, 1 << 20), (3, 200)])
def test_every_overlapping_window_counts(group, part):
    rng = np.random.default_rng(3)
    network = net.Network.fresh()
    texts = ["", " \n", "one", "One, TWO; três ünïcode***", "x" * 5000]
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 200, n)) for n in (31, 32, 33, 56, 57, 400)]
    found = net.logits(network, [t.encode() for t in texts], group, part)
    wanted = [max(plain_logit(network, w) for w in plain_windows(t)) for t in texts]
    assert np.allclose(found, wanted, atol=2e-4)


def test_windows_overlap_and_cover():
    for n in range(0, 300):
        starts = net.window_starts(n)
        covered = {t for a in starts for t in range(a, min(a + net.WIDTH, n))}
        assert covered == set(range(n)) and (np.diff(starts) > 0).all()
        assert all(b - a <= net.STRIDE < net.WIDTH for a, b in zip(starts, starts[1:], strict=False))


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(6)
    documents = [[b"alpha beta gamma"], [b"beta delta " * 9], [b""], [b"epsilon"]]
    bags = net.Bags.of(documents, np.array([1.0, 0, 1, 0]))
    network = net.Network({k: v.astype(np.float64) for k, v in net.Network.fresh().weights.items()})
    scale = np.array([1.0, 0.5, 2.0, 1.0])
    shown = np.array([1, 0, 1, 1, 1], bool)[:len(bags.tokens.word)]

    def loss():
        _, gates = network.inputs(bags.tokens, shown)
        logit, _ = network.forward(gates.astype(np.float64), bags.windows, bags.real)
        return float((scale * (np.logaddexp(0, logit) - bags.y * logit)).mean())

    grads, value = network.gradients(bags.tokens, bags.windows, bags.real, bags.y, scale, shown)
    assert abs(value - loss()) < 1e-5
    for name, weights in network.weights.items():
        flat, g = weights.reshape(-1), grads[name].reshape(-1)
        strongest = np.argsort(-np.abs(g))[:4]
        for k in {*strongest.tolist(), *rng.integers(0, len(flat), 2).tolist()}:
            kept, step = flat[k], 1e-2
            flat[k] = kept + step
            up = loss()
            flat[k] = kept - step
            down = loss()
            flat[k] = kept
            assert abs((up - down) / (2 * step) - g[k]) < 2e-3 * max(1, abs(g[k])), (name, k)


def test_calibration_is_the_logistic_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * x - 1)))).astype(float)
    slope, offset = toxicity.calibrate(x, y, np.ones(4000))
    assert abs(slope - 0.7) < 0.1 and abs(offset + 1) < 0.2
    slope, offset = toxicity.calibrate(np.array([-5.0, 5]), np.array([0.0, 1]), np.ones(2))
    assert np.isfinite([slope, offset]).all()
    assert toxicity.calibrate(np.array([-5.0, 5]), np.array([1.0, 0]), np.ones(2))[0] == 0


def test_held_out_labels(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    found = toxicity.assess(docs, labels).join(labels.select(
        F.col("doc_id").alias("id"), "toxic"), "id", "left").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [(r.score, r.toxic, r.predicted) for r in found if r.held_out and r.toxic is not None]
    score, y, predicted = (np.array(v) for v in zip(*held, strict=True))
    rank = np.argsort(np.argsort(score))
    n = y.sum()
    auc = (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))
    assert auc > 0.94 and predicted[y == 0].mean() < 0.03 and predicted[y == 1].mean() > 0.7


def test_awkward_rows(spark):
    schema = "doc_id long, text string, y string, id string, score double, windows int, part int"
    texts = [(1, "you idiot"), (2, None), (3, ""), (4, " \n\t*** "), (5, "idiot " * 50_000), (6, "a"),
             (None, "no id"), (None, None), (7, "same"), (7, "same"), (8, "z" * 300_000)]
    docs = spark.createDataFrame([(i, t, "y", "i", 0.1, 1, 2) for i, t in texts], schema)
    labels = spark.createDataFrame(
        [(k, k % 2) for k in range(1, 40)] + [(1, None), (None, 1), (7, 1), (7, 0)],
        "doc_id long, toxic int")
    found = toxicity.assess(docs, labels).collect()
    assert len(found) == len(texts)
    empty = {r.score for r in found if r.id in (2, 3, 4)}
    assert len(empty) == 1 and len({r.score for r in found if r.id == 7}) == 1
    assert toxicity.assess(docs.where("doc_id = -1"), labels).count() == 0
    none = toxicity.assess(docs, labels.where("doc_id = -1"))
    assert none.agg(F.min("score"), F.max("score"), F.count("score")).first()[:] == (0.5, 0.5, 11)
    one = toxicity.assess(docs, labels.where("toxic = 1"))
    assert one.agg(F.max("score")).first()[0] == 0.5
