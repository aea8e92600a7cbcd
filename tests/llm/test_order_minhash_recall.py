"""Order MinHash against all pairs: classes by brute force, recall by edit similarity, the bound before alignment."""

import random

import numpy as np
import pytest

from leafmill.llm import order_minhash


def distance(a: list, b: list) -> int:
    """Word edit distance, cell by cell."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng: random.Random, words: list[str], share: float, evenly: bool) -> list[str]:
    out, n = list(words), int(share * len(words))
    for i in [int(k * len(words) / n) for k in range(n)] if evenly else rng.sample(range(len(words)), n):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def test_classes_equal_all_pairs(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 90))]
        texts += [base, edited(rng, base, rng.choice([0.04, 0.1, 0.15]), rng.random() < 0.5), edited(rng, base, rng.choice([0.25, 0.3]), False)]
    texts += [["one", "two"], ["one", "two"], []]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            longest = max(len(texts[i]), len(texts[j]))
            if longest and distance(texts[i], texts[j]) <= 0.2 * longest + 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("evenly", [False, True])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.12, 0.15, 0.18, 0.2])
def test_pairs_of_each_similarity_share_a_sketch(share, evenly):
    rng = random.Random(int(share * 100))
    hashed = lambda w: order_minhash.hashed_words(" ".join(w).encode())
    pairs = []
    for _ in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        pairs.append((hashed(base), hashed(edited(rng, base, share, evenly))))
    assert order_minhash.similar(pairs).all()
    one, two = (order_minhash.sketches([p[i] for p in pairs])[1] for i in (0, 1))
    assert (one == two).any(1).mean() >= 0.9


def test_bound_is_never_above_the_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 25))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        assert order_minhash.least_distance(np.array(a, np.uint64), np.array(b, np.uint64)) <= distance(a, b)


def test_occurrences_and_sketches_of_odd_texts():
    assert order_minhash.occurrences(np.array([5, 7, 5, 5, 7], np.uint64)).tolist() == [0, 0, 1, 2, 1]
    words = order_minhash.hashed_words(b"a b a b a b a b a b")
    live, rows = order_minhash.sketches([words[:0], words[:1], words[:2], words])
    assert live.tolist() == [1, 2, 3] and rows.shape == (3, order_minhash.ALL_SKETCHES)
    assert len(np.unique(order_minhash.elements([words])[0])) == 6
