"""LM scoring (operator 4): Brown class-based bigrams.

Words are counted over all training documents by the block exchange (blocks.py), each block sending its distinct words.
Classes begin with the most frequent words and, for all others, their last letters, as the units of an exchange clustering on the
driver: each unit moves to the class that raises the likelihood of class bigrams most, until a sweep moves none. Then every
other word moves, by all its own neighbours, to the class in which they are likeliest: sweeps over the corpus, in which a
bucket has the neighbours' classes of its words, until the likelihood of class bigrams hardly rises. Only words that no training
document has are classed by their last letters. A text's probability is the product over its tokens of

    P(class | class before) * P(word | class)

both smoothed: transitions towards the classes' own frequencies, emissions by adding `add` to every word's count and one
unknown word in each class. What reaches the driver has a fixed bound: the bigram counts of units and of classes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answered, buckets_for, cut_by_bucket, per_block, per_bucket, squeezed, to_blocks, unsqueezed
from .common import NULL_ID, U64, delete_folder, scratch, table, written
from .suffixes import distinct_slices

FREQUENT, ENDINGS, CLASSES = 1000, 256, 64
#: Sweeps over the corpus end when one raises the likelihood by less than this share.
RISE = 1e-3
#: Words whose neighbours a bucket has side by side; stands for the class of a word that no training document has.
_WORDS, _NONE = 1 << 14, 65535
ADD, TRUST = 0.5, 100.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SLICE = 1 << 20
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SENT = "bucket int, blk long, packed binary"
END = U64(0)  # the hash of the end token: no word has it


def held_out(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id's decimal digits (of nothing for null) modulo 7 is 2."""
    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % 7 == 2 for i in ids.tolist()], bool)


def word_ids(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit digests of words, never END's. Two of w different words share one with a chance of w * w / 2 ** 65."""
    one, of, _ = distinct_slices(data, first, n)
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a : a + k], digest_size=8).digest() for a, k in zip(first[one].tolist(), n[one].tolist(), strict=True))
    h = np.frombuffer(digests, "<u8").astype(U64)
    h[h == END] = U64(1)
    return h[of]


class Words:
    """The tokens of a block: hash and ending of each, document by document, each document's end last."""

    def __init__(self, block: Block):
        if len(block.parts) > 1:  # of a table of with_tokens()
            self.uniq, ending, of = block.parts
            self.uniq_ending, self.of, self.n = ending.astype(np.int64), of.astype(np.int64), block.lens
        else:
            self._read(block)
        self.ends = np.cumsum(self.n) - 1
        self.is_end = np.zeros(len(self.of), bool)
        self.is_end[self.ends] = True
        self.train = ~held_out(block.ids)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def _read(self, block: Block) -> None:
        hashes, endings, docs = [], [], []
        at = 0
        while at < len(block.lens):
            to = max(at + 1, int(np.searchsorted(block.ends, block.starts[at] + _SLICE, side="right")))
            a, b = int(block.starts[at]), int(block.ends[to - 1])
            data = _LOWER[block.data[a:b]]
            inside = np.zeros(len(data) + 2, bool)
            inside[1:-1] = ~_SPACE[data]
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            first, last = edge[::2], edge[1::2]
            # a word that runs over the edge of a document is two
            cuts = block.starts[at + 1 : to] - a
            inner = cuts[(cuts > 0) & (cuts < len(data))]
            inner = np.unique(inner[inside[inner] & inside[inner + 1]])
            first, last = np.sort(np.r_[first, inner]), np.sort(np.r_[last, inner])
            n = last - first
            h = word_ids(data, first, n)
            tail = data[last - 1].astype(np.int64) * 257 + np.where(n > 1, data[np.maximum(last - 2, 0)], 0)
            hashes.append(h)
            endings.append((tail * 40503 >> 4) % ENDINGS)
            docs.append(np.searchsorted(block.ends, first + a, side="right"))
            at = to
        h, ending, doc = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, U64), (endings, np.int64), (docs, np.int64)))
        self.n = np.bincount(doc, minlength=len(block.lens)) + 1 if len(block.lens) else np.zeros(0, np.int64)
        total = int(self.n.sum())
        self.hash, self.ending = np.full(total, END), np.zeros(total, np.int64)
        word = np.ones(total, bool)
        word[np.cumsum(self.n) - 1] = False
        self.hash[word], self.ending[word] = h, ending
        self.uniq, index, self.of = np.unique(self.hash, return_index=True, return_inverse=True)
        self.uniq_ending = self.ending[index]

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.of, weights=self.train[self.doc], minlength=len(self.uniq)).astype(np.int64)


def with_tokens(blocks: DataFrame) -> DataFrame:
    """Blocks of text as blocks of tokens: hashes and endings of the distinct words, and the number of each token's word."""

    def run(block: Block):
        w = Words(block)
        yield block.blk, block.ids.tobytes(), w.n.tobytes(), squeezed(w.uniq, w.uniq_ending.astype(np.uint8), w.of.astype(np.uint32))

    return written(per_block(blocks, run, "blk long, ids binary, lens binary, data binary"), codec="none")


def _send_counts(n_buckets: int):
    def run(block: Block):
        w = Words(block)
        counts, cut = w.train_counts(), cut_by_bucket(w.uniq, n_buckets)
        for k in range(n_buckets):
            s = slice(cut[k], cut[k + 1])
            if s.stop > s.start:
                yield k, block.blk, squeezed(np.diff(w.uniq[s], prepend=U64(0)), counts[s].astype(np.uint32), w.uniq_ending[s].astype(np.uint8))

    return run


def _sum_counts(rows):
    """Answers every block its words' counts; under block -1: the bucket's distinct words and tokens by ending, and its most
    frequent words."""
    got = [(blk, *unsqueezed(p)) for blk, p in rows]
    hashes = [np.cumsum(d, dtype=U64) for _, d, _, _ in got]
    uniq, index, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(of, weights=np.concatenate([c for _, _, c, _ in got]).astype(np.float64), minlength=len(uniq)).astype(np.int64)
    ending = np.concatenate([e for *_, e in got])[index].astype(np.int64)
    at = 0
    for (blk, *_), h in zip(got, hashes, strict=True):
        yield blk, squeezed(total[of[at : at + len(h)]])
        at += len(h)
    word = (total > 0) & (uniq != END)
    top = np.lexsort((uniq, -total))
    top = top[word[top]][:FREQUENT]
    ends = int(total[uniq == END].sum())
    yield -1, squeezed(np.bincount(ending[word], minlength=ENDINGS), np.bincount(ending[word], weights=total[word], minlength=ENDINGS).astype(np.int64), uniq[top], total[top], ending[top], np.array([ends]))


def exchange(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit: unit 0 (the end) is alone in class 0; the others move, one by one, to the class among the rest
    with the highest likelihood of class bigrams. counts[a, b]: how often b follows a."""
    n = len(counts)
    size = counts.sum(axis=0) + counts.sum(axis=1)
    cls = np.zeros(n, np.int64)
    by_size = np.lexsort((np.arange(n), -size))
    by_size = by_size[by_size != 0]
    room = max(1, min(classes, n) - 1)
    cls[by_size] = 1 + np.arange(n - 1) % room
    c = room + 1
    member = np.zeros((n, c))
    member[np.arange(n), cls] = 1
    grid = member.T @ counts @ member

    def phi(x):
        return x * np.log(np.maximum(x, 1e-300))

    moved, before, likelihood = 1, -np.inf, _likelihood(grid)
    # a sweep that rounding alone calls a rise is the last, so that no classes come twice
    while moved and likelihood > before:
        moved = 0
        for u in by_size.tolist():
            old = int(cls[u])
            if not size[u]:
                continue
            # np.bincount gives the counts of the unit's neighbours by class
            out = np.bincount(cls, weights=counts[u], minlength=c)
            into = np.bincount(cls, weights=counts[:, u], minlength=c)
            own = counts[u, u]
            out[old] -= own
            into[old] -= own
            grid[old] -= out
            grid[:, old] -= into
            grid[old, old] -= own
            rows, cols = phi(grid + out) - phi(grid), phi(grid + into[:, None]) - phi(grid)
            diag = np.arange(c)
            gain = rows.sum(axis=1) - rows[diag, diag] + cols.sum(axis=0) - cols[diag, diag]
            here = grid[diag, diag]
            gain += phi(here + out + into + own) - phi(here)
            # the unit's neighbours follow or precede it in any class
            left, right = grid.sum(axis=1) + into, grid.sum(axis=0) + out
            gain -= phi(left + out.sum() + own) - phi(left) + phi(right + into.sum() + own) - phi(right)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9 * (1 + abs(gain[old])):
                new = old
            grid[new] += out
            grid[:, new] += into
            grid[new, new] += own
            cls[u] = new
            moved += new != old
        before, likelihood = likelihood, _likelihood(grid)
    return cls


class Model:
    """Class of each unit, and the logarithms that scores are made of: grid[c, d] counts class d after c; class_tokens and class_words
    are each class's training tokens and distinct words."""

    def __init__(self, frequent: np.ndarray, cls: np.ndarray, grid: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, n: int, v: int, add: float = ADD, trust: float = TRUST):
        self.frequent, self.cls, self.n, self.v, self.add = frequent, cls, n, v, add
        prior = (class_tokens + 1) / (class_tokens.sum() + len(grid))
        self.step = np.log10((grid + trust * prior) / (grid.sum(axis=1, keepdims=True) + trust))
        self.room = np.log10(class_tokens + add * (class_words + 1))

    def score(self, w: Words, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P of each token; count: each token's training count; cls: each token's class."""
        before = np.r_[0, cls[:-1]]  # a document follows an end
        return self.step[before, cls] + np.log10(count + self.add) - self.room[cls]


def _units(frequent: np.ndarray, w: Words) -> np.ndarray:
    """Of each distinct word. 0: the end; then the frequent words in the order of their hashes; then the endings of all other words."""
    unit = 1 + len(frequent) + w.uniq_ending
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, w.uniq), len(frequent) - 1)
        unit = np.where(frequent[at] == w.uniq, 1 + at, unit)
    unit[w.uniq == END] = 0
    return unit


def _classes(frequent: np.ndarray, cls: np.ndarray, w: Words, cut: np.ndarray, got: dict) -> np.ndarray:
    """The class of each distinct word: the unit's for the end and frequent words; for others what their buckets say, and where they
    say nothing the ending's."""
    unit, own = _units(frequent, w), np.full(len(w.uniq), _NONE)
    for k, p in got.items():
        own[cut[k] : cut[k + 1]] = unsqueezed(p)[0]
    return np.where((unit > len(frequent)) & (own != _NONE), own, cls[unit])


def _bigrams(w: Words, kind: np.ndarray, size: int):
    """(bucket, packed): counts of pairs of neighbouring tokens' kinds."""
    pair, n = np.unique((np.r_[0, kind[:-1]] * size + kind)[w.train[w.doc]], return_counts=True)
    if len(pair):
        cut = np.searchsorted(pair, np.arange(0, 33) * (size * size // 32 + 1))
        for k in range(32):
            s = slice(cut[k], cut[k + 1])
            if s.stop > s.start:
                yield k, squeezed(pair[s], n[s])


def _sum_bigrams(rows):
    got = [unsqueezed(p) for _, p in rows]
    pair, of = np.unique(np.concatenate([p for p, _ in got]), return_inverse=True)
    yield -1, squeezed(pair, np.bincount(of, weights=np.concatenate([n for _, n in got]).astype(np.float64)).astype(np.int64))


def _collected(sent: DataFrame, size: int) -> np.ndarray:
    counts = np.zeros(size * size)
    for r in per_bucket(sent, _sum_bigrams).select("packed").collect():
        pair, k = unsqueezed(r.packed)
        counts[pair] = k
    return counts.reshape(size, size)


def _neighbours(w: Words, kind: np.ndarray, asked: np.ndarray, cut: np.ndarray, classes: int):
    """(bucket, packed): to each bucket its words, and for each asked one how often each class comes before and after it in training
    documents; beyond these buckets, class bigrams. kind: each distinct word's class."""
    kind = kind[w.of]
    at = np.flatnonzero((w.train[w.doc]) & asked[w.of])
    before, after = np.r_[0, kind[:-1]][at], classes + np.r_[kind[1:], 0][at]
    at, n = np.unique(np.r_[w.of[at] * (2 * classes) + before, w.of[at] * (2 * classes) + after], return_counts=True)
    word, side = np.divmod(at, 2 * classes)
    per = np.bincount(word, minlength=len(w.uniq)).astype(np.uint32)
    edge = np.searchsorted(word, cut)
    for k in range(len(cut) - 1):
        s, e = slice(cut[k], cut[k + 1]), slice(edge[k], edge[k + 1])
        if s.stop > s.start:
            yield k, squeezed(np.diff(w.uniq[s], prepend=U64(0)), per[s], side[e].astype(np.uint16), n[e].astype(np.uint32))
    for k, p in _bigrams(w, kind, classes):
        yield len(cut) - 1 + k, p


def _sweep(blocks: DataFrame, classed: DataFrame | None, frequent: np.ndarray, cls: np.ndarray, n_buckets: int, classes: int) -> DataFrame:
    """What _neighbours gives of each block, by the classes so far; at first those of units, for which no block is dealt."""

    def run(block: Block, got: dict):
        w = Words(block)
        cut = cut_by_bucket(w.uniq, n_buckets)
        # frequent words and the end don't move: nothing is asked about them
        return [(k, block.blk, p) for k, p in _neighbours(w, _classes(frequent, cls, w, cut, got), _units(frequent, w) > len(frequent), cut, classes)]

    if classed is None:
        return written(per_block(blocks, lambda block: run(block, {}), SENT), codec="none")
    return written(answered(blocks, classed.where("blk <> -1"), lambda block, got: pd.DataFrame(run(block, got), columns=["bucket", "blk", "packed"]), SENT), codec="none")


def _best_classes(grid: np.ndarray):
    """Answers every block the classes of its words: the class that makes a word's neighbours likeliest, given the class bigrams;
    under block -1: the bucket's distinct words by class."""
    c = len(grid)
    some = grid + 0.1
    fit = np.log(some / np.outer(some.sum(axis=1), some.sum(axis=0)) * some.sum())
    gain = np.concatenate([fit, fit.T])  # rows: the class before, the class after; columns: the word's class
    gain[:, 0] = -np.inf  # the end's

    def run(rows):
        got = [(blk, *unsqueezed(p)) for blk, p in rows]
        hashes = [np.cumsum(d, dtype=U64) for _, d, *_ in got]
        uniq, of = np.unique(np.concatenate(hashes), return_inverse=True)
        per, side, n = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in (2, 3, 4))
        word = np.repeat(of, per)
        order = np.argsort(word, kind="stable")
        word, side, n = word[order], side[order], n[order].astype(np.float64)
        best = np.full(len(uniq), _NONE, np.uint16)
        for at in range(0, len(uniq), _WORDS):
            to = min(at + _WORDS, len(uniq))
            s = slice(*np.searchsorted(word, [at, to]))
            counts = np.bincount((word[s] - at) * (2 * c) + side[s], weights=n[s], minlength=(to - at) * 2 * c).reshape(to - at, 2 * c)
            known = counts.any(axis=1)
            # finite columns only: nothing times minus infinity is no number
            best[at:to][known] = 1 + np.argmax(counts[known] @ gain[:, 1:], axis=1)
        at = 0
        for (blk, *_), h in zip(got, hashes, strict=True):
            yield blk, squeezed(best[of[at : at + len(h)]])
            at += len(h)
        yield -1, squeezed(np.bincount(best[best != _NONE], minlength=c))

    return run


def _likelihood(grid: np.ndarray) -> float:
    """Of class bigrams, but for what doesn't depend on classes."""
    phi = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return phi(grid) - phi(grid.sum(axis=0)) - phi(grid.sum(axis=1))


def fit(blocks: DataFrame, counted: DataFrame, n_buckets: int, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of the training documents, and the classes of all words that aren't frequent (bucket, blk, packed), in the order of
    each block's. What reaches the driver has a fixed size: sums by ending, FREQUENT words, bigrams of at most 1 + FREQUENT +
    ENDINGS units, and class bigrams."""

    def spread(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                words, tokens, h, n, ending, ends = unsqueezed(p)
                kind = np.r_[np.zeros(ENDINGS, np.int32), np.ones(len(h), np.int32), [2]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[np.arange(ENDINGS), ending, [0]].astype(np.int64)), pa.array(np.r_[words, h.view(np.int64), [0]].astype(np.int64)), pa.array(np.r_[tokens, n, ends].astype(np.int64))], names=["kind", "ending", "a", "b"])

    facts = written(counted.where("blk = -1").select("packed").mapInArrow(spread, "kind int, ending long, a long, b long"))
    sums = facts.where("kind <> 1").groupBy("kind", "ending").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    top = facts.where("kind = 1").orderBy(F.desc("b"), "a").limit(FREQUENT).collect()
    words, tokens = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    ends = 0
    for r in sums:
        if r.kind == 2:
            ends = r.b
        else:
            words[r.ending], tokens[r.ending] = r.a, r.b
    n, v = int(tokens.sum() + ends), int(words.sum() + (ends > 0))
    top = sorted((np.int64(r.a).view(U64), r.b) for r in top)
    frequent = np.array([h for h, _ in top], U64)
    size = 1 + len(frequent) + ENDINGS
    bigrams = _collected(per_block(blocks, lambda block: _unit_bigrams(frequent, block), SENT), size)
    cls = exchange(bigrams, classes)
    c = int(cls.max()) + 1
    member = np.zeros((size, c))
    member[np.arange(size), cls] = 1
    grid, classed = member.T @ bigrams @ member, None
    spark, likelihood = blocks.sparkSession, _likelihood(grid)
    with scratch() as made_here:
        sent = _sweep(blocks, None, frequent, cls, n_buckets, c)
        while True:
            moved = written(per_bucket(sent.where(F.col("bucket") < n_buckets), _best_classes(grid)), codec="none")
            delete_folder(spark, made_here.pop(-2))
            sent = _sweep(blocks, moved, frequent, cls, n_buckets, c)
            after = _collected(sent.where(F.col("bucket") >= n_buckets), c)
            rose, likelihood = _likelihood(after) - likelihood, _likelihood(after)
            if classed is not None and rose <= 0:
                break  # the classes before were better
            classed, grid = moved, after
            if rose < RISE * abs(likelihood):
                break
        delete_folder(spark, made_here.pop())
    # each token but a document's last is followed by one, each but its first follows one: columns count all tokens
    others = sum(unsqueezed(bytes(r.packed))[0] for r in classed.where("blk = -1").select("packed").collect())
    class_words = others + np.bincount(cls[: 1 + len(frequent)], weights=np.r_[ends > 0, np.ones(len(frequent))], minlength=c)
    return Model(frequent, cls, grid, grid.sum(axis=0), class_words, n, v), classed.where("blk <> -1")


def _unit_bigrams(frequent: np.ndarray, block: Block):
    w = Words(block)
    for k, p in _bigrams(w, _units(frequent, w)[w.of], 1 + len(frequent) + ENDINGS):
        yield k, block.blk, p


def score_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES) -> DataFrame:
    """One row per row of df, with its score under a model of all documents that aren't held out.

    A null or empty text is its end alone; a null id counts as an empty id text, so it trains; repeated rows count as often
    as they occur; without training documents every token is unknown; an empty table gives no rows; other columns are
    ignored."""
    with scratch() as made_here:
        texts = to_blocks(df, doc_id, text)
    n_buckets = buckets_for(texts)
    blocks = with_tokens(texts)
    delete_folder(df.sparkSession, made_here[0])
    counted = written(per_bucket(per_block(blocks, _send_counts(n_buckets), SENT), _sum_counts), codec="none")
    model, classed = fit(blocks, counted, n_buckets, classes)

    def score(block: Block, got: dict) -> pd.DataFrame:
        w = Words(block)
        cut, count = cut_by_bucket(w.uniq, n_buckets), np.zeros(len(w.uniq), np.int64)
        for k, p in got.items():
            if k < n_buckets:
                count[cut[k] : cut[k + 1]] = unsqueezed(p)[0]
        cls = _classes(model.frequent, model.cls, w, cut, {k - n_buckets: p for k, p in got.items() if k >= n_buckets})
        c = count[w.of]
        begin = w.ends - w.n + 1
        base = np.log10((c + 1) / (model.n + 1 * (model.v + 1)))
        ids = pd.array([None if i == NULL_ID else i for i in block.ids.tolist()], "Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": ~w.train, "n_tokens": w.n, "n_known": np.add.reduceat((c > 0).astype(np.int64), begin), "train_tokens": np.full(len(ids), model.n), "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(model.score(w, c, cls[w.of]), begin)})

    both = counted.where("blk <> -1").unionByName(classed.withColumn("bucket", (F.col("bucket") + n_buckets).cast("int")))
    return answered(blocks, both, score, OUT)


def op4_brown_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
