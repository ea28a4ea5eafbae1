"""The models' numpy code against plain versions: tree walks, gated steps, numeric gradients; the net without log-odds."""

import numpy as np
import pytest

from lithoframe.llm import quality, queries, toxicity
from lithoframe.llm.labelled import training_rows


def test_flattened_trees_are_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        margin = trees.base
        for at in trees.roots.tolist():
            while not (trees.left[at] == trees.right[at]):
                at = int(trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
            while trees.left[at] != at:  # what has no branch hands on to itself or to its only child
                at = int(trees.left[at])
            margin += trees.value[at]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert np.mean((trees.score(x) > 0.5) == (y > 0.5)) > 0.95


def plain_logit(net, x):
    """One window, a word at a time."""
    p, h = net.p, net.hidden
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for d in "fb":
        state, states = np.zeros(h), []
        for row in x if d == "f" else x[::-1]:
            g, back = row @ p[f"{d}_x"] + p[f"{d}_b"], state @ p[f"{d}_h"]
            z, r = sig(g[:h] + back[:h]), sig(g[h : 2 * h] + back[h : 2 * h])
            state = (1 - z) * state + z * np.tanh(g[2 * h :] + r * back[2 * h :])
            states.append(state)
        sides.append(np.array(states if d == "f" else states[::-1]))
    both = np.concatenate(sides, axis=1)
    e = np.exp(np.tanh(both @ p["att_w"]) @ p["att_v"])
    return float((e / e.sum()) @ both @ p["out_w"] + p["out_b"][0])


def test_windows_equal_plain_steps():
    rng = np.random.default_rng(1)
    net = toxicity.GatedNet(3)
    x = rng.normal(size=(60, 2 * net.embed + 2)).astype(np.float32)
    index, owner = toxicity.layout([60], np.arange(1, 61))
    got = net.run(net.projected(x), index)
    want = [plain_logit(net, x[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(60)]
    assert np.allclose(got, want, atol=1e-4) and len(want) == len(owner)
    short, _ = toxicity.layout([5], np.arange(1, 6))
    assert np.allclose(net.run(net.projected(x[:5]), short), [plain_logit(net, x[:5])], atol=1e-4)


@pytest.mark.parametrize("name", ["f_x", "f_h", "f_b", "b_x", "b_h", "b_b", "att_w", "att_v", "out_w", "out_b"])
def test_gradients_are_numeric_ones(name):
    rng = np.random.default_rng(2)
    net = toxicity.GatedNet(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(30, 2 * net.embed + 2))
    index, _ = toxicity.layout([30], np.arange(1, 31))
    labels, weights = (np.arange(index.shape[1]) % 2).astype(float), np.linspace(1, 2, index.shape[1])

    def loss():
        z = np.array([plain_logit(net, x[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(30)])
        return float((weights * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - labels * z)).sum() / weights.sum())

    g, d_x = net.gradients(x, index, labels, weights)
    values = [(net.p[name], g[name])] + ([(x, d_x)] if name == "f_x" else [])
    for array, grad in values:
        for at in rng.integers(0, array.size, 6).tolist():
            own, step = array.flat[at], 1e-4
            array.flat[at] = own + step
            up = loss()
            array.flat[at] = own - step
            down = loss()
            array.flat[at] = own
            assert abs((up - down) / (2 * step) - grad.flat[at]) < 2e-4


def test_net_learns_without_log_odds(spark):
    """Its embeddings, gates and attention alone tell held-out texts apart."""
    data = "/root/testdata/sf0.1"
    docs, labels = (queries.table(spark, data, t) for t in ("documents", "labels"))
    rows = training_rows(docs, labels, "toxic", 5, 0, 3000, 8000)
    cut = len(rows) * 4 // 5
    order = np.random.default_rng(0).permutation(len(rows))
    train, held = [rows[i] for i in order[:cut]], [rows[i] for i in order[cut:]]
    y = np.array([v for _, v in held])
    share = {}
    for with_odds in (True, False):
        score = toxicity.Scorer(toxicity.fit(train, with_odds=with_odds)).score([t for t, _ in held])
        share[with_odds] = float(np.mean((score >= 0.5) == (y == 1)))
    print(share, "majority", max(y.mean(), 1 - y.mean()))
    assert share[True] >= 0.95 and share[False] > max(y.mean(), 1 - y.mean())
