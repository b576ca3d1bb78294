"""Every word has the class of its own neighbours, also where it isn't one of the most frequent."""

import random

import numpy as np
import pytest

from tidemark.llm import brown


def test_rare_words_are_classed_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 6)
    rng = random.Random(2)
    kinds = [["".join(rng.choice("abcdefg") for _ in range(5)) + k + "zz" for _ in range(30)] for k in "xy"]
    around = [("before", "after"), ("left", "right")]
    # a word of each kind is frequent; all others have one ending and one count
    said = [f"{a} {w} {b}" for ws, (a, b) in zip(kinds, around, strict=True) for w in [*ws, *["often" + b] * 20] for _ in range(6)]
    rng.shuffle(said)
    held = np.flatnonzero(brown.held_out(np.arange(1000))).tolist()
    train = [i for i in range(1000) if i not in set(held)]
    texts = [" ".join(said[i : i + 4]) for i in range(0, len(said), 4)]
    asked = [f"{a} {ws[0]} {b}" for a, b in around for ws in kinds]
    df = spark.createDataFrame([*zip(train, texts), *zip(held, asked)], "doc_id long, text string")  # noqa: B905
    got = {r.doc_id: r.score for r in brown.score_documents(df).collect()}
    own_first, other_first, other_last, own_last = (got[i] for i in held[:4])
    assert own_first > other_first + 0.5 and own_last > other_last + 0.5
    assert own_first == pytest.approx(own_last, abs=0.2)


def test_exchange_ends_where_no_move_is_better():
    """Gains are the likelihood's own differences: classes that other gains end in, or go round in, can be bettered."""

    def likelihood(counts, cls):
        member = np.eye(cls.max() + 1)[cls]
        return brown._likelihood(member.T @ counts @ member)

    for seed in range(20):
        rng = np.random.default_rng(seed)
        counts = (rng.integers(0, 12, (12, 12)) * rng.integers(0, 2, (12, 12))).astype(float)
        cls = brown.exchange(counts, 4)
        assert cls[0] == 0 and 0 not in cls[1:]
        here = likelihood(counts, cls)
        for u in range(1, len(cls)):
            for c in range(1, 4):
                other = cls.copy()
                other[u] = c
                assert likelihood(counts, other) <= here + 1e-6, (seed, u, c)
