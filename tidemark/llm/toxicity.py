"""Toxicity (operator 9): cumulative-link ordinal regression over sparse text features.

Features are hashed words (lower case, ASCII punctuation as space) and their first three to five bytes, present or not. One
weight vector is shared by all ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). Labels tell toxic from other
documents; the toxic half with a higher density of telling features is graded 2, the other 1, clean documents 0. The result is
the expected severity, from 0 to 2, and whether a grade above 0 is likelier than REJECT. Weights are never negative: features are
evidence for toxicity, so nothing in a text excuses it.

The fit takes a bounded sample (MOST_LABELS labelled rows, the least by a hash of their id), on the driver; scoring covers
every document and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, int64s, mixed, offsets_and_bytes, sliced, table
from .suffixes import PrefixHash

MOST_LABELS = 8000
FEATURES = 1 << 20
#: P(grade > 0) from which a document counts as toxic: without evidence it is about 0.02.
REJECT = 0.1
LEAST_DOCS, LEAST_GAIN = 4, 12.0
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 20
SCHEMA = "doc_id long, severity double, toxic boolean"


def features(offs: np.ndarray, data: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document's number, feature), distinct and ascending, of documents' bytes; keep: which features to give."""
    out = []
    at, n_docs = 0, len(offs) - 1
    while at < n_docs:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + _SLICE, side="right")) - 1)
        a, b = int(offs[at]), int(offs[to])
        body = _LOWER[data[a:b]]
        inside = np.zeros(len(body) + 2, bool)
        inside[1:-1] = _WORD[body]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        cuts = offs[at + 1 : to] - a
        inner = cuts[(cuts > 0) & (cuts < len(body))]
        inner = np.unique(inner[inside[inner] & inside[inner + 1]])
        first, last = np.sort(np.r_[first, inner]), np.sort(np.r_[last, inner])
        doc = np.searchsorted(offs, first + a, side="right") - 1
        hashes, size = PrefixHash(body), last - first
        for width in (0, 3, 4, 5):
            n = size if not width else np.minimum(size, width)
            ok = size >= width if width else slice(None)
            h = mixed(hashes.of(first[ok], n[ok]) ^ U64((width + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(FEATURES - 1)
            f, d = h.astype(np.int64), doc[ok]
            if keep is not None:
                some = keep[f]
                f, d = f[some], d[some]
            out.append(np.unique(d * FEATURES + f))
        at = to
    both = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return both // FEATURES, both % FEATURES


class OrdinalModel:
    """weights by feature (0 for most) and ascending thresholds, one fewer than grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.used = weights != 0

    def above(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for each document and threshold."""
        x = np.bincount(doc, weights=self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, steps: int = 1000, rate: float = 0.1, decay: float = 0.2) -> OrdinalModel:
    """The model of labelled documents. Without documents of both kinds nothing is toxic."""
    n, n_toxic = len(toxic), int(toxic.sum())
    if not 0 < n_toxic < n:
        return OrdinalModel(np.zeros(FEATURES), np.array([4.0, 8.0]))
    hit = np.bincount(feature, weights=toxic[doc], minlength=FEATURES)
    miss = np.bincount(feature, minlength=FEATURES) - hit
    want = (hit + miss) * n_toxic / n
    gain = np.where(hit > want, (hit - want) ** 2 / np.maximum(want, 1e-9), 0)
    picked = (hit >= LEAST_DOCS) & (gain >= LEAST_GAIN) & (hit / n_toxic > 4 * miss / (n - n_toxic))
    ids = np.flatnonzero(picked)
    if not len(ids):
        return OrdinalModel(np.zeros(FEATURES), np.array([4.0, 8.0]))
    place = np.full(FEATURES, -1)
    place[ids] = np.arange(len(ids))
    total = np.bincount(doc, minlength=n)
    some = picked[feature]
    d, f = doc[some], place[feature[some]]
    density = np.bincount(d, minlength=n) / np.maximum(total, 1)
    grade = np.where(toxic, 1 + (density > np.median(density[toxic])), 0)
    w, theta, spread = np.zeros(len(ids)), 2.0, 2.0
    moment, square = np.zeros(len(ids) + 2), np.zeros(len(ids) + 2)
    for t in range(1, steps + 1):  # gradient steps on the whole sample, each weight at its own pace
        x = np.bincount(d, weights=w[f], minlength=n)
        cut = np.array([theta, theta + np.exp(spread)])
        p = 1 / (1 + np.exp(-np.clip(cut[None, :] - x[:, None], -40, 40)))  # P(grade <= k)
        s = p * (1 - p)
        low = np.where(grade == 0, 0, np.where(grade == 1, p[:, 0], p[:, 1]))
        high = np.where(grade == 0, p[:, 0], np.where(grade == 1, p[:, 1], 1))
        like = np.maximum(high - low, 1e-9)
        s_low = np.where(grade == 0, 0, np.where(grade == 1, s[:, 0], s[:, 1]))
        s_high = np.where(grade == 0, s[:, 0], np.where(grade == 1, s[:, 1], 0))
        # of the mean negative log likelihood
        by_x = (s_high - s_low) / like / n
        by_cut0 = -(np.where(grade == 0, s[:, 0], 0) - np.where(grade == 1, s[:, 0], 0)) / like / n
        by_cut1 = -(np.where(grade == 1, s[:, 1], 0) - np.where(grade == 2, s[:, 1], 0)) / like / n
        g = np.r_[np.bincount(f, weights=by_x[d], minlength=len(ids)) + decay * w / len(ids), by_cut0.sum() + by_cut1.sum(), by_cut1.sum() * np.exp(spread)]
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, theta, spread = np.maximum(w - step[:-2], 0), theta - step[-2], spread - step[-1]  # evidence for toxicity only
    weights = np.zeros(FEATURES)
    weights[ids] = w
    return OrdinalModel(weights, np.array([theta, theta + np.exp(spread)]))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = MOST_LABELS) -> OrdinalModel:
    """From labels (rows with a null are left out; of several for one document the highest counts)."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(toxic) > 0).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def encode(batches):
        for b in sliced(batches, 4 << 20):
            offs, data = offsets_and_bytes(b.column(1))
            d, f = features(offs, data)
            f = f.astype("<u4")
            cut = np.searchsorted(d, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "toxic", "features"])

    # the sample has at most `most` rows
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").mapInArrow(encode, "doc_id long, toxic boolean, features binary")
    got = sorted(((r.doc_id, r.toxic, bytes(r.features)) for r in rows.orderBy("doc_id").limit(most).collect()), key=lambda r: (r[0], r[2]))
    fs = [np.frombuffer(f, "<u4").astype(np.int64) for *_, f in got]
    doc = np.repeat(np.arange(len(fs)), [len(f) for f in fs])
    return fit_ordinal(doc, np.concatenate([np.zeros(0, np.int64), *fs]), np.array([t for _, t, _ in got], bool))


def score_toxicity(df: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, six decimals) and toxic for each row of df.

    A null or empty text has no features and the severity of the thresholds alone; null ids stay null; repeated rows get equal
    results; an empty table gives an empty one; other columns are ignored."""

    def run(batches):
        for b in sliced(batches, 4 << 20):
            offs, data = offsets_and_bytes(b.column(1))
            above = model.above(*features(offs, data, model.used), b.num_rows)
            ids = int64s(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(np.round(above.sum(axis=1), 6)), pa.array(above[:, 0] > REJECT)], names=["doc_id", "severity", "toxic"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_clean(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text isn't toxic: a null or empty text never is; repeated rows stay or go together; an empty
    table gives an empty one."""
    at = df.columns.index(text)

    def run(batches):
        for b in sliced(batches, 4 << 20, at):
            offs, data = offsets_and_bytes(b.column(at))
            above = model.above(*features(offs, data, model.used), b.num_rows)
            yield b.filter(pa.array(above[:, 0] <= REJECT))

    return df.mapInArrow(run, df.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


__all__ = ["OrdinalModel", "features", "fit", "fit_ordinal", "keep_clean", "op9_toxicity", "score_toxicity"]
