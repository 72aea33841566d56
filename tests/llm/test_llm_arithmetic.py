"""The language model's words, sums and gradients, each against a plain form."""

import numpy as np
import pyarrow as pa
import pytest

from residuum.llm import language_model as lm
from residuum.llm.text import words


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_words_of_a_column_are_those_of_each_text(monkeypatch, size):
    monkeypatch.setattr(lm, "SPLIT_BYTES", size)
    texts = [None, "", " ", "a", "  A\tb\x0b\x0cC\r\n d ", "\x1c\x1d a\x1eb\x85  x y É", "q" * 99, "\n\n", "b a b"]
    want = [words(t.encode() if t is not None else None) for t in texts]
    v = lm.Vocabulary({b"a": 0, b"b": 1, b"": 2}, np.ones(3), 3, np.full(lm.FORMS, 0.5), 3, 3)
    for kind in (pa.string(), pa.large_string()):
        parts = list(lm.split_words(pa.array(texts, kind)))
        assert [w for p, _ in parts for w in p.to_pylist()] == [w for x in want for w in x]
        assert [n for _, p in parts for n in p] == [len(x) for x in want]
        got = list(v.tokens(pa.array(texts, kind)))
        assert [r for _, r in got] == [[w for w in x if w not in v.index] for x in want]
        assert [i.tolist() for i, _ in got] == [[v.index.get(w, -1 - lm.form(w)) for w in [*x, b""]] for x in want]
    assert list(v.tokens(pa.array([], pa.string()))) == []


def test_sums_by_row():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(0, 50, 300), np.full(40, 7), np.full(lm.OFTEN, 60), np.full(lm.OFTEN + 1, 61), [62, 40_000]])
    for own in (rows, rows[:-1], rows[-1:]):
        values = rng.normal(size=(len(own), 3)).astype(np.float32)
        want = np.zeros((40_001, 3))
        np.add.at(want, own, values)
        found, sums = lm._by_row(own, values)
        assert found.tolist() == sorted(set(own.tolist())) and np.abs(sums - want[found]).max() < 1e-4


def test_gradients_equal_differences_of_the_loss(monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "Steps", lambda p, rate: lambda grads: seen.append({k: (r, g.copy()) for k, (r, g) in grads.items()}))
    monkeypatch.setattr(lm, "LANES", 2), monkeypatch.setattr(lm, "UPDATES", 1)
    rng = np.random.default_rng(4)
    index = {f"w{i}".encode(): i for i in range(90)} | {b"": 90}
    v = lm.Vocabulary(index, np.full(91, 5.0), 80, np.full(lm.FORMS, 3.0), 455, 91)
    forms = np.array([lm.form(w) for w in index])
    net = lm.Net.start(v, forms)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) + rng.normal(0, 0.2, net.p[k].shape)
    stream = rng.integers(0, 91, 2 * lm.WINDOW)
    lm.train_shard(net, v, forms, [stream], 0.01)
    rows = lm._rows(v, stream, forms).reshape(2, lm.WINDOW)
    end_row = int(lm._rows(v, np.array([90]), forms)[0])

    def loss() -> float:
        h, before, out = np.zeros((2, lm.HIDDEN)), np.full(2, end_row), 0.0
        for t in range(lm.WINDOW):
            h = net.step(before, h * (before != end_row)[:, None])[0]
            before = rows[:, t]
            out -= net.log_likelihood(h, before, v.classes).astype(float).sum()
        return out / rows.size

    for key, (touched, g) in seen[0].items():
        whole = np.zeros_like(net.p[key])
        whole[slice(None) if touched is None else touched] = g
        direction = rng.normal(size=whole.shape)
        kept, ends = net.p[key], []
        for step in (1e-4, -1e-4):
            net.p[key] = kept + step * direction
            ends.append(loss())
        net.p[key] = kept
        want = (ends[0] - ends[1]) / 2e-4
        assert want == pytest.approx(float((whole * direction).sum()), rel=0.02, abs=2e-3), key
