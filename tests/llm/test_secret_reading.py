"""Tokens are read many texts at once; what is read and learned is as if they came one by one."""

import numpy as np

from seamark.llm import secrets

from .conftest import ODD

TEXTS = [*(t or "" for t in ODD), "", "\0nul \0" + "a" * 40, "größenordnung-7\U0001f642Пароль12345 x", "end_of_text_1", "x" * 7 + " " + "y" * 8 + "\ud800zzzzzzzzz", "deadbeef" * 4]


def test_texts_read_at_once_have_the_tokens_and_windows_of_each(monkeypatch):
    read = secrets.Texts(TEXTS)
    want = [(i, *m.span(), m[0]) for i, t in enumerate(TEXTS) for m in secrets.CANDIDATE.finditer(t)]
    assert [(i, a - read.first[i], b - read.first[i], t) for i, a, b, t in zip(read.owner, read.start, read.end, read.tokens())] == want
    assert (read.windows(read.start, read.end) == secrets.codes([secrets.window(TEXTS[i], a, b) for i, a, b, _ in want])).all()
    assert [i for some in secrets.at_once(TEXTS) for i in some] == list(range(len(TEXTS)))


def test_a_logit_is_that_of_the_token_and_of_what_stands_round_it():
    net, rng = secrets.Network(3), np.random.default_rng(0)
    c = rng.integers(1, secrets.CODES, (300, secrets.BEFORE + secrets.TOKEN + secrets.AFTER)).astype(np.uint8)
    for row, size in zip(c, rng.integers(8, secrets.TOKEN + 1, len(c))):
        row[secrets.BEFORE + size : secrets.BEFORE + secrets.TOKEN] = 0
    z = np.maximum(sum(net.w[k][c[:, k : c.shape[1] - secrets.TAPS + 1 + k].astype(int)] for k in range(secrets.TAPS)) + net.b, 0)
    inner = z[:, secrets.INNER]
    outer = np.concatenate([z[:, : secrets.INNER.start], z[:, secrets.INNER.stop :]], 1)
    want = np.concatenate([inner.max(1), inner.mean(1), outer.max(1)], 1) @ net.v
    assert np.allclose(net.logits(c), want, atol=1e-4)
    least = float(np.median(want))
    assert set(net.above(c, least)) == set(np.flatnonzero(net.logits(c) > least))
    assert np.allclose(net.highest(c, 5), np.sort(want)[-5:], atol=1e-4)


def test_examples_of_a_block_move_together(spark, docs, monkeypatch):
    """One row of the shuffle for up to ``SENT`` examples, not one for each."""
    sent, real = [], secrets.map_batches
    monkeypatch.setattr(secrets, "map_batches", lambda *a: sent.append(real(*a)) or sent[-1])
    parts = secrets.examples(docs([f"anyword{'abcdefghij'[i % 10] * (i // 10 + 1)} number-{i:05d}" for i in range(2_000)]))
    assert sum(r[0] for r in secrets.counted(parts).values()) > 2_000 and sent[0].count() <= 20
