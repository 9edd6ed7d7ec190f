"""Tokens that no pattern finds: other formats, without digits, and behind long prefixes."""

import numpy as np
import pytest

from seamark.llm import secrets


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(2)


def key(rng, n, letters="0123456789abcdef"):
    return "".join(rng.choice(list(letters), n))


def test_every_token_is_a_candidate():
    text = "qWzRtYpLkJhGfDsA " + "x" * 80 + "7 " + "/usr/share/" * 8 + "a1b2c3d4"
    assert [text[a:b] for a, b in secrets.candidates(text, [])] == text.split()
    long = text.split()[-1]
    assert any("a1b2c3d4" in w for w in secrets.windows(long, 0, len(long)))


def test_a_format_that_fills_the_corpus_is_added_and_masked(spark, docs, rng):
    other = lambda: f"{key(rng, 19)}-{key(rng, 19)}"
    words = "the quick brown fox considers several ordinary sentences about mountains and rivers"
    texts = [f'{words} token = "{key(rng, 40)}" or {key(rng, 32)} then call {rng.integers(10**9, 10**10)} at 10.0.{i}.17' if i % 2 else f"{words} see {other()} from 10.0.{i}.17 end" for i in range(400)]
    net = secrets.train(docs(texts))
    new = [other() for _ in range(20)]
    rows = secrets.without_secrets(docs([f"{words} see {k} from 10.0.3.17 end" for k in new]), net).collect()
    assert sum(k not in r["text"] for k, r in zip(new, sorted(rows, key=lambda r: r["doc_id"]))) >= 18
    assert all(r["text"].startswith(words) and r["text"].endswith(" from 10.0.3.17 end") for r in rows)
    behind = "/usr/share/lib/files/of/the/owner/" + other()
    assert secrets.scan(net, [f"{words} see {behind} end"])[0].spans
