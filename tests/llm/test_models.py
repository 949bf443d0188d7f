"""The two networks: exact counts and held-out quality."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlode.llm import lm, toxic

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return lm.op10_lm_scoring(spark, sf_dir).collect()


def test_counts_and_base_score(spark, sf_dir, scored):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(t for i, text in docs.items() if not out[i] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert len(scored) == len(docs)
    for r in scored:
        own = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(t in c for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)


def test_network_beats_the_base(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up_and_state_is_carried():
    net = lm.Network()
    total = sum(np.exp(net.score(np.array([5, w, lm.END]), np.array([0, 3]))[1]) for w in range(lm.VOCABULARY))
    assert abs(total - 1) < 1e-4
    text = np.random.default_rng(0).integers(2, 50, 700)
    alone = net.score(text, np.array([0, 700]))
    together = net.score(np.concatenate((text, text[:5], text)), np.array([0, 700, 705, 1405]))
    assert np.allclose(alone, together[:700], atol=1e-4) and np.allclose(alone, together[705:], atol=1e-4)


def test_gradients_are_slopes_of_the_loss():
    """Backpropagation of a window against differences of its loss."""
    r = np.random.default_rng(3)
    ids, target, fresh = r.integers(0, 300, (6, 5)), r.integers(0, 300, (6, 5)), r.random((6, 5)) < 0.2
    state = r.normal(size=(lm.HIDDEN, 5)).astype(np.float32) * np.float32(0.3)
    net = lm.Network()
    grad, _, _ = net.gradients(ids, fresh, target, state)
    for name, g in grad.items():
        for at in np.argsort(-np.abs(g), axis=None)[:3]:
            losses = []
            for way in (0.01, -0.01):
                w = {k: v.copy() for k, v in net.w.items()}
                w[name].flat[at] += way
                losses.append(lm.Network(w).gradients(ids, fresh, target, state)[2])
            assert math.isclose((losses[0] - losses[1]) / 0.02, g.flat[at], rel_tol=0.02, abs_tol=1e-4), name


def test_forward_pass_against_plain_numbers():
    """A gated unit written out for one lane, a class and then a word of it."""
    net, text, e = lm.Network(), [7, 300, 2, 1999, lm.END], lambda v: 1 / (1 + np.exp(-v))
    w = {k: v.astype(float) for k, v in net.w.items()}
    h, k, last, expected = lm.HIDDEN, np.zeros(lm.HIDDEN), lm.END, []
    for t in text:
        x, g = w["in"] @ w["word"][last] + w["bias"][:, 0], w["state"] @ k
        z, reset = e(x[:h] + g[:h]), e(x[h : 2 * h] + g[h : 2 * h])
        c = np.tanh(x[2 * h :] + reset * g[2 * h :])
        k, part = z * k + (1 - z) * c, slice(t // lm.CLASS * lm.CLASS, (t // lm.CLASS + 1) * lm.CLASS)
        p, q = np.exp(w["class"] @ k + w["class_bias"]), np.exp(w["out"][part] @ k + w["out_bias"][part])
        expected.append(np.log(p[t // lm.CLASS] / p.sum() * q[t % lm.CLASS] / q.sum()))
        last = t
    assert np.allclose(net.score(np.array(text), np.array([0, len(text)])), expected, atol=1e-4)


def test_lm_odd_texts(odd, empty):
    rows = lm.score(odd, lambda k: k >= 0).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(empty, lambda k: k >= 0).count() == 0


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxic.op7_toxicity(spark, big).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert ((p >= 0) & (p <= 1)).all()
    auc = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert auc > 0.75  # some forty toxic texts to learn from; see README for larger tables


def test_toxicity_odd_texts(odd, empty):
    net = toxic.Network()
    rows = toxic.score(odd, net).collect()
    assert len(rows) == 9 and {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert toxic.score(empty, net).count() == 0


def test_toxicity_labels(spark):
    """Documents that share an id, and labels that are missing or of one side only."""
    docs = spark.createDataFrame([(i % 20, f"word{i % 3} " * (i % 7 + 1)) for i in range(40)], "doc_id long, text string")
    some = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    nets = [toxic.fit(d, some, F.lit(True)).w for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert all(np.array_equal(nets[0][k], nets[1][k]) for k in nets[0])
    for rows in (some.limit(0), some.where("toxic = 0")):
        assert len(toxic.score(docs, toxic.fit(docs, rows, F.lit(True))).collect()) == 40


def test_network_learns_from_all_of_long_texts(spark, tmp_path):
    """Words in a fixed order, of which only the rest of long texts tells."""
    early, late = ("".join(f"{c}{i} " for i in range(5)) for c in "xy")
    rows = [(i, early * 900 + late * 2000 if i else late * 40) for i in range(41)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"file://{tmp_path}/t")
    found = {r.doc_id: r for r in lm.score(spark.read.parquet(f"file://{tmp_path}/t"), lambda k: k > 0).collect()}
    assert len(found) == 41 and not found[0].learned
    assert found[0].score > found[0].base_score / 2


def plain_log_prob(net, rows, target, grad):
    """A class, then a word of it, by the greatest logarithm, with gradients of the negative mean: pass after pass over a class's columns."""
    group, scale = (target // lm.CLASS).astype(np.uint8), np.float32(1 / len(target))
    order = np.argsort(group, kind="stable")
    x, target, group = rows[:, : lm.HIDDEN].T.take(order, axis=1), target[order], group[order]
    log_p, back = np.zeros(len(target)), np.zeros_like(x)

    def choose(kind, part, here, chosen):
        own, w = x[:, here], net.w[kind][part]
        p = w @ own
        p += net.w[f"{kind}_bias"][part][:, None]
        p -= p.max(axis=0)
        k = np.arange(len(chosen))
        picked = p[chosen, k]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        log_p[here] += picked - np.log(total)
        p *= scale / total
        p[chosen, k] -= scale
        grad[kind][part] += p @ own.T
        grad[f"{kind}_bias"][part] += p.sum(axis=1)
        back[:, here] += w.T @ p

    for a in range(0, len(target), 1024):
        choose("class", slice(None), slice(a, a + 1024), group[a : a + 1024])
    cuts = np.searchsorted(group, np.arange(lm.VOCABULARY // lm.CLASS + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        for a in range(cuts[c], cuts[c + 1], 1024):
            z = min(a + 1024, cuts[c + 1])
            choose("out", slice(c * lm.CLASS, (c + 1) * lm.CLASS), slice(a, z), target[a:z] - c * lm.CLASS)
    at = np.argsort(order)
    return log_p[at], back.T[at]


def softmax_case(spread):
    r, net = np.random.default_rng(5), lm.Network()
    net.w["out_bias"], net.w["class_bias"] = (np.linspace(-spread, spread, len(net.w[k])).astype(np.float32) for k in ("out_bias", "class_bias"))
    rows = np.ones((8192, lm.HIDDEN + 1), np.float32)
    rows[:, :-1] = np.tanh(r.normal(size=(8192, lm.HIDDEN)))
    target = np.minimum(r.zipf(1.2, 8192) - 1, lm.VOCABULARY - 1)
    return net, rows, target, [{k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2)]


@pytest.mark.parametrize("spread", [5, 400])
def test_softmax_against_the_plain_one(spread):
    """Small logarithms are raised as they are; of large ones none may overflow or leave a sum of nothing."""
    net, rows, target, (own, other) = softmax_case(spread)
    for got, expected in zip(net.log_prob(rows, target, own), plain_log_prob(net, rows, target, other), strict=True):
        assert np.isfinite(got).all() and np.allclose(got, expected, rtol=1e-3, atol=1e-4)
    for k, g in other.items():
        assert np.allclose(own[k], g, rtol=1e-3, atol=1e-5), k


def test_softmax_takes_fewer_passes_than_the_plain_one():
    """Learning and scoring spend most of their time here; the check tool's budget of CPU time leaves no room for the plain way."""
    net, rows, target, (own, other) = softmax_case(5)
    took = {}
    for _ in range(9):
        for way, grad in ((lambda g: net.log_prob(rows, target, g), own), (lambda g: plain_log_prob(net, rows, target, g), other)):
            began = time.process_time()
            way(grad)
            took.setdefault(id(grad), []).append(time.process_time() - began)
    assert min(took[id(own)]) < 0.85 * min(took[id(other)]), took
