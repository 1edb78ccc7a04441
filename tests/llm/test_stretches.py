"""What the language search remembers and passes over changes no result."""

import pickle
import random

import numpy as np

from stenoflow.llm import language as L


def _model(seed):
    return L.Model(np.random.default_rng(seed).normal(0, 0.3, (6, L.DIMENSION)).astype(np.float32))


def test_words_are_scored_once_by_a_worker():
    sent = pickle.dumps(_model(1))
    first = pickle.loads(sent)
    first.spoken(["casa", "mare"])
    again, other = pickle.loads(sent), pickle.loads(pickle.dumps(_model(2)))
    assert set(again.seen) == {"casa", "mare"} and not other.seen
    assert other.word("casa") == _model(2).word("casa") != first.word("casa")


def test_spoken_words():
    model, text = _model(1), "Casa casa ăăă casa mare. Hmm mare, um, ам MARE casa"
    assert model.spoken(L._WORD.findall(text.lower())) == [model.word(w) for w in L._words_of(text)]


def test_path_of_two_choices():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 12)
        scores = [tuple(rng.choice([-1.5, -0.5, 0.0, 0.5, 1.5]) for _ in range(3)) for _ in range(n)]
        prior, start = ([rng.choice([-1.0, 0.0]) for _ in range(3)] for _ in range(2))
        x, y = rng.choice([(0, 1), (0, 2), (1, 2)])
        score = lambda path: start[path[0]] + sum(s[c] for s, c in zip(scores, path)) + sum(prior[b] - L.SWITCH for a, b in zip(path, path[1:]) if a != b)  # noqa: B023, E731
        best = max(score([(x, y)[k >> i & 1] for i in range(n)]) for k in range(1 << n))
        assert abs(score(L._path(scores, x, y, prior, start)) - best) < 1e-9
