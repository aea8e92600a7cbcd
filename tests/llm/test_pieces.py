"""Merges that look a pair up once, pieces remembered from task to task."""

import pickle
import random

import numpy as np
import public_tokenizers as P

from leafmill.llm import byte_bpe

RANKS = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


class Asked(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


def plainly(piece: bytes) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while ranked := [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]:
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


def test_merges_look_each_new_pair_up_once():
    rng = random.Random(4)
    for size in (1, 2, 3, 12, 39, 40, 41, 90):
        for letters in ("ab", "etaoin shrdlu", "éàx"):
            piece = "".join(rng.choice(letters) for _ in range(size)).encode()[:size]
            asked = Asked(RANKS)
            assert byte_bpe.merged(piece, asked) == plainly(piece) or piece in RANKS
            assert asked.asked <= 3 * len(piece)


def test_pieces_are_sent_empty_and_remember_what_they_merged(spark, monkeypatch):
    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    docs = spark.createDataFrame([(1, "zzqxvkwjq twice twice"), (2, None)], "doc_id long, text string")
    assert byte_bpe.encode(docs, RANKS, P.PATTERN).count() == 2
    assert isinstance(sent[0], byte_bpe.Pieces) and not len(sent[0])
    there = pickle.loads(pickle.dumps(sent[0]))
    assert np.frombuffer(there[" zzqxvkwjq"], "<i4").tolist() == plainly(b" zzqxvkwjq") and list(there) == [" zzqxvkwjq"]
