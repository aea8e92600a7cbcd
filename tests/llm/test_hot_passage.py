"""Near-duplicates among many texts that share a long passage."""

import random

from leafmill.llm import order_minhash


def hot_passage(pairs: int, strangers: int, shared: int = 78, own: int = 22, kept: int = 13):
    """Texts of one passage and own words; a pair's texts share `kept` of their own words. The rows, and the pairs."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(shared)
    texts, same = [], []
    for _ in range(pairs):
        common = words(kept)
        same.append((len(texts), len(texts) + 1))
        texts += [" ".join(passage + common + words(own - kept)) for _ in range(2)]
    texts += [" ".join(passage + words(own)) for _ in range(strangers)]
    keys = list(range(len(texts)))
    rng.shuffle(keys)
    return [(keys[i], t) for i, t in enumerate(texts)], [(keys[a], keys[b]) for a, b in same]


def test_pairs_among_strangers_with_one_passage_are_linked(spark):
    rows, same = hot_passage(200, 400, kept=7)
    found = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(found[a] == found[b] for a, b in same) >= 194
    assert len(set(found.values())) >= 600
