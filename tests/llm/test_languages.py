"""Scores of long words and short stretches of another language."""

import itertools

import numpy as np
import pytest

from eavesgraph.llm import languages


def model():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c", "abc"]
    rng = np.random.default_rng(0)
    return languages.PieceModel(["l", "m"], {p: i for i, p in enumerate(pieces)}, rng.random((len(pieces), 2)) * 1e-4, 4)


def exact(m, word):
    """The forward sum in exact fractions."""
    from fractions import Fraction

    w, out = "▁" + word, []
    for l in range(len(m.langs)):
        a = [Fraction(1)] + [Fraction(0)] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - m.longest), j):
                k = m.pieces.get(w[i:j])
                if k is not None or j == i + 1:
                    a[j] += a[i] * Fraction(float(m.prob[k, l]) if k is not None else m.letter)
        out.append(np.log(float(a[-1].numerator >> max(0, a[-1].numerator.bit_length() - 900))) + max(0, a[-1].numerator.bit_length() - 900) * np.log(2) - np.log(float(a[-1].denominator >> max(0, a[-1].denominator.bit_length() - 900))) - max(0, a[-1].denominator.bit_length() - 900) * np.log(2))
    return out


@pytest.mark.parametrize("n", [1, 10, 40, 41, 60, 200])
def test_scores_equal_an_exact_sum(n):
    m = model()
    for word in ("abcab" * n)[:n], "x" * n, ("abx" * n)[:n]:
        assert np.allclose(m.score(word), exact(m, word), rtol=1e-9)


def test_a_word_of_any_length_scores_in_proportion():
    m = model()
    a, b = m.score("x" * 2500), m.score("x" * 5000)
    assert np.allclose(b - a, 2500 * np.log(m.letter)) and np.isfinite(m.score("ab" * 2500)).all()


@pytest.mark.parametrize("seed", range(30))
def test_the_path_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    score = rng.normal(size=(6, 3)) * [0.5, 1, 3][seed % 3]
    pi = rng.dirichlet([1, 1, 0.1])
    s = score + np.log(pi)
    cost = lambda p: sum(s[t, k] for t, k in enumerate(p)) + sum(languages.STAY if a == b else languages.CHANGE for a, b in zip(p, p[1:]))
    best = max(map(cost, itertools.product(range(3), repeat=6)))
    assert np.isclose(cost(languages.best_path(score, pi)), best)


def test_a_short_stretch_in_a_long_text_is_found():
    score = np.full((100, 3), -40.0)
    score[:, 0] = -20
    score[50:52] = [-40, -20, -40]
    pi, _ = languages.shares(score, np.full(100, 7.0))
    assert languages.best_path(score, pi).tolist() == [0] * 50 + [1, 1] + [0] * 48
