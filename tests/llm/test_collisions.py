"""Words that collide under any polynomial hash modulo 2 ** 64: results must not depend on it."""

import numpy as np
import pytest

from tidemark.llm import bottom_k, brown, packing, suffix_dedup, token_store
from tidemark.llm.common import shared_dir
from tidemark.llm.suffixes import PrefixHash, distinct_slices
from tidemark.llm.tokens import ByteLevelEncoder, tokenizer_path

BYTE = tokenizer_path("byte_bpe_50k.json")
TM = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
CO = TM.translate(str.maketrans("ab", "ba"))


def test_the_pair_collides():
    data = np.frombuffer((TM + CO).encode(), np.uint8)
    a, b = PrefixHash(data).of(np.array([0, 1024]), np.array([1024, 1024]))
    assert a == b
    one, of, _ = distinct_slices(np.tile(data, 2), np.array([0, 1024, 2048, 3072]), np.full(4, 1024))
    assert of.tolist() == [of[0], of[1], of[0], of[1]] and of[0] != of[1] and len(one) == 2


@pytest.mark.parametrize("apart", [False, True])
def test_encoder_gives_the_librarys_ids(apart):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(BYTE), ByteLevelEncoder(BYTE)
    some = [f"x {TM} y", f"x {CO} y", f"x {TM}", f"{CO} {TM} {CO}"]
    for batch in [[t] for t in some] if apart else [some]:
        flat, n = ours.encode(batch)
        ends = np.cumsum(n)
        for t, a, b in zip(batch, ends - n, ends, strict=True):
            assert flat[a:b].tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_operators_tell_them_apart(spark):
    from tokenizers import Tokenizer

    d = spark.createDataFrame([(1, f"x {TM}"), (2, f"x {CO}")], "doc_id long, text string").coalesce(1)
    want = {i: Tokenizer.from_file(BYTE).encode(f"x {w}", add_special_tokens=False).ids for i, w in ((1, TM), (2, CO))}
    got = {}
    for r in packing.pack_documents(d, BYTE).orderBy("start").collect():
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert got == {i: [*w, 0] for i, w in want.items()}
    path = shared_dir(spark)
    token_store.write_token_shards(d, path, BYTE)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read_token_shards(spark, path).collect()} == {i: [*w, 2] for i, w in want.items()}
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bottom_k.near_duplicates(d).collect()}
    assert near == {1: (1, 1, True), 2: (1, 2, True)}
    # 12 tokens where the pair is four words, three training words and the end: x, both words, the end
    d = spark.createDataFrame([(1, f"x {TM}"), (2, f"x {CO}"), (3, CO)], "doc_id long, text string").coalesce(1)
    train = [i for i in (1, 2, 3) if not brown.held_out(np.array([i]))[0]]
    words = {1: ["x", TM, None], 2: ["x", CO, None], 3: [CO, None]}
    n, v = sum(len(words[i]) for i in train), len({w for i in train for w in words[i]})
    for r in brown.score_documents(d).collect():
        c = [sum(x == w for i in train for x in words[i]) for w in words[r.doc_id]]
        assert r.train_tokens == n and r.n_known == sum(x > 0 for x in c)
        assert r.base_score == pytest.approx(sum(np.log10((x + 1) / (n + v + 1)) for x in c))


def test_repeats_tell_them_apart(spark):
    d = spark.createDataFrame([(1, TM), (2, CO), (3, "q" + TM)], "doc_id long, text string")
    raw = {1: TM.encode(), 2: CO.encode(), 3: b"q" + TM.encode()}
    least = {}
    for i in (3, 2, 1):
        least.update({raw[i][a : a + 50]: i for a in range(len(raw[i]) - 49)})
    for r in suffix_dedup.remove_repeats(d).collect():
        gone = bytearray(len(raw[r.doc_id]))
        for a in range(len(gone) - 49):
            if least[raw[r.doc_id][a : a + 50]] < r.doc_id:
                gone[a : a + 50] = b"\1" * 50
        assert r.n_removed == sum(gone)


def test_the_sorter_verifies_colliding_suffixes():
    from tidemark.llm.suffixes import SuffixSorter

    data = np.frombuffer((TM + CO + TM).encode(), np.uint8)
    starts = np.array([0, 1024, 2048])
    order, fresh = SuffixSorter(data, 1024).sort(np.zeros(3, np.int64), starts)
    assert [data[starts[i] : starts[i] + 1024].tobytes().decode() for i in order] == sorted([TM, CO, TM])
    assert fresh.sum() == 2
