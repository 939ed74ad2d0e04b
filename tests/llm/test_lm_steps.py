"""Operator 5: the training step against its direct form, and words looked up once."""

import numpy as np
import pyarrow as pa

from ledgerspark.llm import lm


def _vocabulary(texts):
    codes, n = np.unique(np.concatenate([lm.Codes().of(t) for t in texts]), return_counts=True)
    sums = {}
    for c, k in zip(codes.tolist(), n.tolist(), strict=True):
        sums[c % lm.BUCKETS] = sums.get(c % lm.BUCKETS, 0) + k + 1
    counted = list(zip(codes.view(np.int64).tolist(), n.tolist(), strict=True))
    return lm.Vocabulary(counted, sums, int(n.sum()), len(codes))


def _direct_step(parts, squares, rng, cdf, log_noise, rate, ctx, y):
    r, c, t, b = parts
    n = len(y)
    rows = [r[ctx[:, j]] for j in range(lm.CONTEXT)]
    q = sum(rows[j] @ c[j] for j in range(lm.CONTEXT))
    z = np.minimum(np.searchsorted(cdf, rng.random(lm.NOISE)), lm.UNITS - 1)
    true = 1 / (1 + np.exp((q * t[y]).sum(axis=1) + b[y] - log_noise[y]))
    fake = -1 / (1 + np.exp(-(q @ t[z].T + b[z] - log_noise[z])))
    dq = true[:, None] * t[y] + fake @ t[z]
    slopes = [np.zeros_like(p) for p in parts]
    np.add.at(slopes[2], y, q * true[:, None])
    np.add.at(slopes[3], y, true)
    np.add.at(slopes[2], z, fake.T @ q)
    np.add.at(slopes[3], z, fake.sum(axis=0))
    for j in range(lm.CONTEXT):
        slopes[1][j] = rows[j].T @ dq
        np.add.at(slopes[0], ctx[:, j], dq @ c[j].T)
    for p, sq, g in zip(parts, squares, slopes, strict=True):
        sq += g * g / n
        p += rate * g / np.sqrt(sq * n)


def test_step_equals_the_direct_form():
    rng = np.random.default_rng(3)
    unigram = rng.random(lm.UNITS) + 0.01
    unigram /= unigram.sum()
    ctx, y = lm.windows([rng.choice(lm.UNITS, n, p=unigram) for n in (1, 700, 3, 900)])
    trainer = lm.Trainer(lm.Model(unigram), unigram, 0.1, 5)
    parts = [p.astype(np.float64) for p in lm.Model(unigram).parts]
    squares, draw = [np.full_like(p, 0.1) for p in parts], np.random.default_rng(5)
    for i in range(0, len(y), lm.BATCH):  # the last batch is a shorter one
        a = slice(i, i + lm.BATCH)
        trainer.step(ctx[a], y[a])
        _direct_step(parts, squares, draw, np.cumsum(unigram), np.log(unigram * lm.NOISE), 0.1, ctx[a], y[a])
    for got, want in zip(trainer.model.parts, parts, strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-5)


def test_large_scores_stay_in_range():
    unigram = np.full(lm.UNITS, 1 / lm.UNITS)
    model = lm.Model(unigram)
    model.parts[3][0] = 500.0  # exp() of it is no float
    ctx, y = lm.windows([np.array([0, 1, 0], np.int64)])
    got = model.log_probs(ctx, y)
    assert np.isfinite(got).all() and abs(got[0]) < 1e-3 and got[1] < -400


def test_each_word_is_looked_up_once(monkeypatch):
    texts = [b"a b a b a", None, b"B c  a", b"a " * 50]
    vocab = _vocabulary(texts)
    asked = []
    real = lm.Vocabulary.count_of
    monkeypatch.setattr(lm.Vocabulary, "count_of", lambda self, codes: asked.append(len(codes)) or real(self, codes))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    flat = lm.Model(vocab.unigram).flat()
    assert list(lm._train(vocab, flat, 0.1)(iter([batch])))
    assert sum(asked) == 4  # a, b, c and the end


def test_words_agree_with_codes_beyond_the_limit():
    texts = [" ".join(f"w{i * 7 % 300}" for i in range(n)).encode() for n in (0, 5, 900, 40)] * 2
    vocab = _vocabulary(texts[:6])
    words, codes = lm.Words(vocab, limit=50), lm.Codes()
    for t in texts:
        w, c = words.of(t), codes.of(t)
        n, at = vocab.count_of(c)
        assert (words.code[w] == c).all() and (words.count[w] == n).all() and (words.at[w] == at).all()
        assert (words.unit[w] == vocab.unit_of(c, at)).all()
