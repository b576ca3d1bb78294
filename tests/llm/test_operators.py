"""Each operator against a brute-force version, and on nulls, empty texts, repeated rows, ties and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bottom_k, bpe, brown, imatch, jpeg, line_dedup, media, packing, suffix_dedup, token_store, toxicity
from tidemark.llm.common import shared_dir
from tidemark.llm.tokens import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = [(None, "null id", 1), (5, None, 1), (4, "", 1), (7, "same same\nsame", 2), (7, "same same\nsame", 2), (7, "other text", 3), (9, "x" * 70000, 4), (11, " \n\t ", 5), (12, "Ünï <|endoftext|> 日本", 6)]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [words(rng, rng.randint(0, 90)) + ("\n" + words(rng, 12)) * rng.randint(0, 3) for _ in range(60)]
    for _ in range(40):  # copies, near copies, shared passages
        base = rng.choice(out).split(" ")
        if base and rng.random() < 0.7:
            base[rng.randrange(len(base))] = "new"
        out.append(" ".join(base) + (" " + out[0][:200] if rng.random() < 0.3 else ""))
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


OPERATORS = {
    "packing": lambda d: packing.pack_documents(d, BYTE),
    "repeats": suffix_dedup.remove_repeats,
    "media": lambda d: media.media_column(d),
    "brown": brown.score_documents,
    "lines": line_dedup.line_decisions,
    "near": bottom_k.near_duplicates,
    "fingerprints": imatch.fingerprints,
    "bpe": lambda d: bpe.encode_texts(d, WORD),
    "store": lambda d: token_store.read_token_shards(d.sparkSession, token_store.write_token_shards(d, shared_dir(d.sparkSession), BYTE)),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic")))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, n_bytes int").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    got = OPERATORS[name](odd).collect()
    if name == "lines":
        assert len(got) == len({i for i, *_ in ODD})
    elif name != "packing":
        assert len(got) == len(ODD)
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_packing(docs, texts):
    enc = __import__("tokenizers").Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(docs, BYTE).collect()
    for i, t in texts.items():
        got = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == [*enc.encode(t, add_special_tokens=False).ids, 0]
    seqs = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seqs.get(r.sequence_id, 0)
        seqs[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in seqs.values())


def test_plan_covers_every_token_once():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(0, 3000) for _ in range(rng.randint(0, 30))]
        seen = Counter()
        for _, pieces in packing.plan_sequences(sizes):
            for d, a, n in pieces:
                seen.update((d, x) for x in range(a, a + n))
        assert len(seen) == sum(sizes) and set(seen.values()) <= {1}


def test_repeats(docs, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    least = {}
    for i in sorted(raw, reverse=True):
        least.update({raw[i][a : a + 50]: i for a in range(len(raw[i]) - 49)})
    for r in suffix_dedup.remove_repeats(docs).collect():
        t = raw[r.doc_id]
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < r.doc_id:
                gone[a : a + 50] = b"\1" * 50
        assert bytes(r.kept) == bytes(c for c, g in zip(t, gone, strict=True) if not g)
        assert r.n_removed == sum(gone) and r.n_spans == len(re.findall(b"\1+", bytes(gone)))


def test_media_round_trip():
    for n in (0, 1, 576, 577, 40000):
        raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        size, payload, rgb = media.read(media.store(raw))
        assert size == n and payload.tobytes() == raw + b"\xff" * (len(payload) - n) and len(payload) % 576 == 0
        assert rgb.shape[2] == 3


def test_jpeg_reads_symbol_by_symbol_alike(monkeypatch):
    image = media.store(b"some text " * 200)
    fast = jpeg.Decoder(image)
    for name in ("_ac_first_fixed", "_ac_more_fixed"):
        monkeypatch.setattr(jpeg.Decoder, name, lambda *a: False)
    slow = jpeg.Decoder(image)
    assert all((a.coefs == b.coefs).all() for a, b in zip(fast.comps, slow.comps, strict=True))


def test_brown(docs, texts):
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for r in brown.score_documents(docs).collect():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_lines(spark, most):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 30))) for _ in range(12)]
    out = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            x = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x)) : rng.randrange(len(x)) + 1] = rng.choice(["", "q", "zz"])
            lines.append("".join(x)[:40])
        out.append((i, "\n".join(lines)))
    first, late = {}, set()
    for i, t in out:
        for p, x in enumerate(t.split("\n")):
            if x:
                first.setdefault(x, (i, p))
    links = Counter()
    xs = [x for x in first if len(x) >= 20]
    for k, a in enumerate(xs):
        for b in xs[k + 1 :]:
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                links.update((a, b))
                late.add(max(a, b, key=first.get))
    got = {r.doc_id: r for r in line_dedup.line_decisions(spark.createDataFrame(out, "doc_id long, text string"), max_edits=most).collect()}
    for i, t in out:
        lines = t.split("\n")
        assert list(got[i].removed) == [p for p, x in enumerate(lines) if x and (first[x] != (i, p) or x in late)]
        assert got[i].n_links == sum(links[x] for x in set(lines)) and got[i].n_lines == len(lines)


def grown_lines(rng):
    """(documents, distinct lines' first places, all close pairs): lines of 20 to 400 characters with words replaced, by brute force."""
    pool = [words(rng, n) for n in (8, 9, 14, 20, 30, 60, 90)]
    out = []
    for i in range(30):
        lines = []
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(pool).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["", "new", "q"])
            lines.append(" ".join(w))
        out.append((i, "\n".join(lines)))
    first = {}
    for i, t in out:
        for p, x in enumerate(t.split("\n")):
            if x:
                first.setdefault(x, (i, p))
    xs = [x for x in first if len(x) >= 20]
    close = []
    for k, a in enumerate(xs):
        for b in xs[k + 1 :]:
            most = max(1, min(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                close.append((a, b))
    return out, first, close


def test_lines_by_length(spark):
    out, first, close = grown_lines(random.Random(11))
    assert sum(distance(a, b) > 2 for a, b in close) > 20  # more edits than any number fixed for short lines
    links, late = Counter(x for pair in close for x in pair), {max(pair, key=first.get) for pair in close}
    got = {r.doc_id: r for r in line_dedup.line_decisions(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    for i, t in out:
        lines = t.split("\n")
        assert got[i].n_links == sum(links[x] for x in set(lines))
        assert list(got[i].removed) == [p for p, x in enumerate(lines) if x and (first[x] != (i, p) or x in late)]


def test_one_earlier_line_is_enough(spark, monkeypatch):
    out, first, close = grown_lines(random.Random(13))
    monkeypatch.setattr(line_dedup, "TIMES_SENT", 1)  # several rounds
    late = {max(pair, key=first.get) for pair in close}
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_decisions(df, every=False).collect()}
    for i, t in out:
        assert got[i].n_links is None
        assert list(got[i].removed) == [p for p, x in enumerate(t.split("\n")) if x and (first[x] != (i, p) or x in late)]
    _, links = line_dedup.line_links(df, every=False)
    assert links.count() < len(close) and links.select("late").distinct().count() == len(late)


def test_line_classes(spark, tmp_path):
    out, _, close = grown_lines(random.Random(12))
    out += [(None, out[0][1]), (50, "short"), (51, "short"), (52, "")]
    held = {i: {x for x in t.split("\n") if len(x) >= 20} for i, t in out}
    near = {*close, *((b, a) for a, b in close)}
    low = lambda i: (i is not None, i or 0)
    label = {i: i for i in held}
    while True:
        after = {i: min((label[k] for k in held if k == i or any(x == y or (x, y) in near for x in held[i] for y in held[k])), key=low) for i in held}
        if after == label:
            break
        label = after
    spark.createDataFrame(out, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == label and 1 < len(set(label.values())) < len(label) and got[50] == 50


def grown_group(rng):
    """Copies of one text with few to many edits, so that many lie on either side of the threshold."""
    base = words(rng, 80).split(" ")
    out = {}
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(["new", "old", "odd"])
        out[i] = " ".join(w[: rng.randint(60, 80)])
    return out


@pytest.mark.parametrize("group", [False, True])
def test_near_duplicates(spark, docs, texts, group):
    if group:
        texts = grown_group(random.Random(8))
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bottom_k.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    if group:
        assert 1 < len({find(i) for i in sets}) < 150


def test_near_duplicates_keep_pairs_that_a_sketch_underrates(spark):
    common, a, b, more = list(range(26)), list(range(100, 119)), list(range(200, 219)), list(range(300, 319))
    classes = spark.createDataFrame([(1, 1000, common + a + more), (2, 1000, common + b + more)], "cid long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert bottom_k._estimated(pairs, classes).count() == 1  # 26 of the 64 least of the union agree


def test_fingerprints(docs, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - cut] + after[:cut]
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        for j in order:
            if texts[j] == t:
                assert got[j].fingerprint == got[i].fingerprint


def test_word_bpe():
    from tokenizers import Tokenizer

    rng, theirs, ours = random.Random(3), Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    some = ["".join(rng.choice("abcdeΣσİß 19'\n<|x.,!́é日\x1c　") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", "a" * 3000 + "<|startoftext|>"]
    for t, ids, text in zip(some, *ours.encode(some), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and text == theirs.decode(want, skip_special_tokens=False)


def test_token_store(spark, docs, texts):
    from tokenizers import Tokenizer

    enc, path = Tokenizer.from_file(BYTE), shared_dir(spark)
    token_store.write_token_shards(docs, path, BYTE, rows_per_shard=10)
    at = 0
    for r in sorted(token_store.read_token_shards(spark, path).collect(), key=lambda r: r.doc_id):
        want = [*enc.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (at, want)
        at += len(want)
    asked = spark.createDataFrame([(3,), (77,), (5000,)], "doc_id long")
    assert {r.doc_id for r in token_store.lookup_ids(spark, path, asked).collect()} == {3, 77}


def test_perfect_index():
    keys = np.random.default_rng(0).permutation(10**6)[:5000]
    index = token_store.PerfectIndex.from_bytes(token_store.PerfectIndex.build(keys, np.stack([keys, keys * 2], axis=1)).to_bytes())
    assert sorted(index.place(keys)) == list(range(5000))
    found, values = index.lookup(keys)
    assert found.all() and (values[:, 0] == keys).all()
    assert not index.lookup(np.arange(2 * 10**6, 2 * 10**6 + 1000))[0].any()


def test_toxicity(spark):
    rng = random.Random(5)
    out = [(i, words(rng, 60) + (" idiot scum" if i % 5 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(out, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(df, toxicity.fit(df, labels)).collect()}
    held = range(200, 400)
    assert sum(got[i] for i in held if i % 5 == 0) >= 36 and not any(got[i] for i in held if i % 5)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = shared_dir(spark)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() and (docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1)


def test_sha(spark):
    d = spark.createDataFrame([("a b",)], "text string")
    assert bpe.encode_texts(d, WORD).select(F.sha2("decoded", 256)).head()[0] == hashlib.sha256(b"a</w> b</w>").hexdigest()
