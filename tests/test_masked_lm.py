"""A training step against its plain formula."""

import numpy as np

from wavepanel.llm import masked_lm as M


def test_step_adds_every_words_part_to_its_rows():
    rnd = np.random.default_rng(3)
    heads = np.arange(50, dtype=np.uint64)
    common = M.start(np.arange(50 + M.SLOTS, 0, -1).astype(float), 8, 4, 32, heads)
    w, around = rnd.integers(0, 50, 500), rnd.integers(0, 33, (500, len(M.PLACES)))
    t = M.Trainer(common, 0.1)
    h = np.tanh(sum(common.tables[k][around[:, k]] for k in range(len(M.PLACES))))
    z = h @ common.out[:-1] + common.out[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(common.word_scores(w, around), np.log(p[np.arange(500), common.class_of[w]]) + common.log_share[w], atol=1e-5)
    p[np.arange(500), common.class_of[w]] -= 1
    p /= 500
    want_out = common.out - 0.1 * (g := np.vstack([h.T @ p, p.sum(axis=0)])) / np.sqrt(1e-8 + g * g)
    t.step(w, around)
    back = (p @ common.out[:-1].T) * (1 - h * h)
    for k in range(len(M.PLACES)):
        g = np.zeros(common.tables.shape[1:])
        np.add.at(g, around[:, k], back)
        g[-1] = 0
        assert np.allclose(t.m.tables[k], common.tables[k] - 0.1 * g / np.sqrt(1e-8 + g * g), atol=1e-4)
        assert (t.used[k] == np.bincount(around[:, k], minlength=33)).all()
    assert np.allclose(t.m.out, want_out, atol=1e-5) and t.words == 500
