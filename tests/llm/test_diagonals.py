"""Passages with repeated words, against a brute-force alignment."""

import numpy as np
import pytest

from eavesgraph.llm import leakage


def brute(doc, item):
    """(words, errors) of the longest stretch by dynamic programming from every start."""
    best, most = (0, 0), len(item) // leakage.PER_ERROR
    for q in range(len(item)):
        for p in range(len(doc)):
            if doc[p] != item[q]:
                continue
            cost = {(q + 1, p + 1): 0}
            for i in range(q + 1, len(item) + 1):
                for j in range(p + 1, min(len(doc), p + 1 + i - q + most) + 1):
                    ways = [cost[k] + 1 for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in cost]
                    same = i - q > 1 and j - p > 1 and item[i - 1] == doc[j - 1]
                    if same and (i - 1, j - 1) in cost:
                        ways.append(cost[i - 1, j - 1])
                    if (i, j) in cost:
                        ways.append(cost[i, j])
                    if not ways or min(ways) > most:
                        continue
                    cost[i, j] = min(ways)
                    if (same and cost.get((i - 1, j - 1), 99) == cost[i, j]) and i - q >= max(leakage.LEAST, leakage.PER_ERROR * cost[i, j]):
                        best = max(best, (i - q, -cost[i, j]))
    return best[0], -best[1]


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_a_diagonal_is_dropped_only_beside_a_kept_one(spark, rows):
    tail = "river stone cloud bread winter lantern"
    found = leakage.leaked(*tables(spark, [(5, "la " * 9 + tail)], [(1, "la " * 6 + tail)]))
    assert rows(found) == [(5, 1, 12, 0)]


def test_repeated_words_at_an_edge(spark, rows):
    tail = "stop that right now please sir thanks"
    docs = [(n, f"well {'no ' * n}{tail} bye") for n in range(5, 41)] + [(n + 100, f"well {tail} {'no ' * n}bye") for n in range(5, 41)]
    found = leakage.leaked(*tables(spark, docs, [(1, "no " * 5 + tail), (2, tail + " no" * 5)]))
    assert rows(found) == sorted([(n, 1, 12, 0) for n in range(5, 41)] + [(n + 100, 2, 12, 0) for n in range(5, 41)], key=str)


def test_long_items_are_followed_to_their_end(spark, rows):
    item = [f"w{i}" for i in range(400)]
    text = [w for i, w in enumerate(item) for w in ([w, "more"] if i % 7 == 6 else [w])]
    assert rows(leakage.leaked(*tables(spark, [(1, " ".join(text))], [(1, " ".join(item))]))) == [(1, 1, 400, 57)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_random_texts_of_few_words(spark, rows, seed):
    rng = np.random.default_rng(seed)
    words = np.array(["ba", "be", "bi", "bo", "bu", "da"][: 3 + seed])
    items = [(i, rng.choice(words, rng.integers(12, 31))) for i in range(6)]
    docs = []
    for d in range(40):
        w = list(items[d % 6][1])
        for _ in range(rng.integers(0, 6)):
            k = rng.integers(0, len(w))
            w[k : k + 1] = [[], [rng.choice(words)], [w[k], rng.choice(words)]][rng.integers(0, 3)]
        docs.append((d, list(rng.choice(words, rng.integers(0, 9))) + w + list(rng.choice(words, rng.integers(0, 9)))))
    want = [(d, i, *b) for d, t in docs for i, s in items if (b := brute(list(t), list(s)))[0]]
    found = leakage.leaked(*tables(spark, [(d, " ".join(t)) for d, t in docs], [(i, " ".join(s)) for i, s in items]))
    assert rows(found) == sorted(want, key=str) and len(want) > 20
