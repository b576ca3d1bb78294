"""Each stage of the pipeline, and all of them, against a brute-force version: repeated and null ids, clashing names, empty tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import toxicity
from tidemark.llm.common import with_row_key
from tidemark.llm.tokens import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, removed string, fresh int, cid long, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    """(doc_id, text): copies, near copies, shared passages, repeated lines, null and repeated ids, a U+FFFD."""
    rng = random.Random(21)
    base = [words(rng, rng.randint(20, 60)) + "\n" + words(rng, 15) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    near = base[0].split(" ")
    near[5] = "changed"
    passage = "日本語の文章です、" * 4 + words(rng, 14)
    out += [(20, base[1]), (20, base[1]), (21, " ".join(near)), (22, words(rng, 30) + " " + passage), (23, "� " + passage + "é tail " + words(rng, 20)), (24, base[2] + "\n" + words(rng, 9))]
    out += [(30, words(rng, 25)), (30, base[3]), (30, words(rng, 25)), (None, base[4]), (None, base[4]), (None, words(rng, 22)), (31, None), (32, ""), (33, " \n "), (34, base[5].split("\n")[1])]
    out += [(40 + i, words(rng, 20) + " idiot scum idiot") for i in range(3)]
    return [(i, t, "en", f"s{k % 3}", None if t is None else len(t), "r", k, k, "k") for k, (i, t) in enumerate(out)]


def in_order(rows):
    """Rows by id (null first); the texts of one id in the order of digests, which only the key knows."""
    return sorted(rows, key=lambda r: r["key"])


@pytest.fixture(scope="module")
def keyed(spark):
    df, key = with_row_key(spark.createDataFrame(rows(), COLUMNS))
    return in_order([{**r.asDict(), "key": r[key]} for r in df.collect()])


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def back(rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return sorted((tuple(r[c] for c in names) for r in rows), key=repr)


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def fresh(r, text):
    return None if not text.strip() else {**r, "text": text, "n_chars": len(text)}


def lines_by_hand(rows):
    first, late = {}, set()
    for k, r in enumerate(rows):
        for p, x in enumerate((r["text"] or "").split("\n")):
            if x:
                first.setdefault(x, (k, p))
    xs = list(first)
    for i, a in enumerate(xs):
        for b in xs[i + 1 :]:
            most = min(len(a), len(b)) // 10
            if abs(len(a) - len(b)) <= most and distance(a, b, most) <= most:
                late.add(max(a, b, key=first.get))
    out = []
    for k, r in enumerate(rows):
        lines = (r["text"] or "").split("\n")
        keep = [x for p, x in enumerate(lines) if not x or (first[x] == (k, p) and x not in late)]
        out.append(r if len(keep) == len(lines) else fresh(r, "\n".join(keep)))
    return [r for r in out if r]


def near_by_hand(rows):
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[b] = min(root[a], root[b])
    return [r for k, r in enumerate(rows) if root[k] == k]


def repeats_by_hand(rows):
    raw = [(r["text"] or "").encode() for r in rows]
    least = {}
    for k in reversed(range(len(raw))):
        least.update({raw[k][a : a + 50]: k for a in range(len(raw[k]) - 49)})
    out = []
    for k, r in enumerate(rows):
        gone = bytearray(len(raw[k]))
        for a in range(len(gone) - 49):
            if least[raw[k][a : a + 50]] < k:
                gone[a : a + 50] = b"\1" * 50
        if not any(gone):
            out.append(r)
            continue
        at, left = 0, []
        for c in r["text"]:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                left.append(c)
            at += n
        out.append(fresh(r, "".join(left)))
    return [r for r in out if r]


def toxic_model(spark, rows):
    rng = random.Random(5)
    some = [(i, words(rng, 40) + (" idiot scum" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    return toxicity.fit(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))


def frame(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], COLUMNS)


def test_row_key(spark, keyed):
    assert len({r["key"] for r in keyed}) == len(rows())
    ids = [r["doc_id"] for r in keyed]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    plain, key = with_row_key(spark.createDataFrame([(3, "a"), (1, "b")], "doc_id long, text string"))
    assert {(r.doc_id, r[key]) for r in plain.collect()} == {(3, 3), (1, 1)}


@pytest.mark.parametrize("stage, by_hand", [("line dedup", lines_by_hand), ("near-dedup", near_by_hand), ("repeated passages", repeats_by_hand)])
def test_stage(spark, keyed, stage, by_hand):
    docs = frame(spark, keyed)
    got = dict(P.STAGES)[stage](spark, docs, None)
    assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
    want = back(by_hand(keyed))
    assert result(got) == want and len(want) < len(keyed)
    assert dict(P.STAGES)[stage](spark, docs.limit(0), None).collect() == []


def test_a_replacement_character_of_the_input_stays(spark):
    passage = "日本語の文章です、" * 8
    docs = spark.createDataFrame([(1, passage), (2, "� x " + passage[3:] + " y�")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.cut_repeats(spark, docs, None).collect()}
    assert got == {1: passage, 2: "� x  y�"}


def test_toxic_stage_keeps_clean_rows(spark, keyed):
    model = toxic_model(spark, keyed)
    docs = frame(spark, keyed)
    kept = toxicity.keep_clean(docs, model)
    assert result(kept) == back([r for r in keyed if "idiot" not in (r["text"] or "")])
    assert toxicity.keep_clean(docs.limit(0), model).collect() == []


def test_run(spark, keyed, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    labelled = [(1000 + i, words(rng, 40) + (" idiot scum" if i % 4 == 0 else ""), "en", "l", 1, "r", i, i, "k") for i in range(200)]
    frame(spark, keyed).unionByName(spark.createDataFrame(labelled, COLUMNS)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left, key = with_row_key(toxicity.keep_clean(docs, model))
    left = in_order([{**r.asDict(), "key": r[key]} for r in left.collect()])
    assert not any("idiot" in (r["text"] or "") for r in left) and len(left) > 170
    want = repeats_by_hand(near_by_hand(lines_by_hand(left)))
    pieces = {}
    for r in P.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(np.frombuffer(r.ids, "<u4").tolist())
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = [(r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in want]
    assert sum(len(x) for _, x in ids) == sum(len(x) for xs in pieces.values() for x in xs)
    once = [(i, x) for i, x in ids if sum(j == i and len(y) == len(x) for j, y in ids) == 1]
    assert once and all([t for p in pieces[i, len(x)] for t in p] == x for i, x in once)


def test_intermediate_folders_go(spark, keyed, tmp_path):
    docs = frame(spark, keyed)
    stages = dict(P.STAGES)
    before = str(tmp_path / "a")
    stages["near-dedup"](spark, docs, None).write.parquet(before)
    left = list(P._LEFT)
    again = spark.read.parquet(before)
    stages["repeated passages"](spark, again, None).agg(F.count("*")).collect()
    assert left and not set(left) & set(P._LEFT)
    assert again.count()
