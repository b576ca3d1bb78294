"""Looking up new pieces doesn't go through all known ones."""

import numpy as np

from tidemark.llm.tokens import ByteLevelEncoder, tokenizer_path


def test_known_hashes_are_not_gone_through(monkeypatch):
    enc = ByteLevelEncoder(tokenizer_path("byte_bpe_50k.json"))
    asked = []
    isin = np.isin
    monkeypatch.setattr(np, "isin", lambda x, known, **k: (asked.append(len(known)), isin(x, known, **k))[1])
    texts = [["one two three"], ["two three four five"], ["six one"], [""], ["five six seven two"]]
    for some in texts:
        flat, counts = enc.encode(some)
        want = [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]
        assert flat.tolist() == [i for ids in want for i in ids] and counts.tolist() == [len(ids) for ids in want]
    assert not asked
    assert enc._has(np.r_[enc.known, enc.known + np.uint64(1)]).tolist() == [True] * len(enc.known) + np.isin(enc.known + np.uint64(1), enc.known).tolist()
