"""BPE encoding and decoding (operator 10): a segment tree over the ranks of adjacent pairs.

A word's symbols are leaves; leaf i holds the rank of the pair of symbol i and the next live one, combined with i, so that
the root's minimum is the leftmost pair of lowest rank. A merge kills one symbol and updates three leaves, each in
logarithmic time, until the root holds no mergeable pair. The trees of all distinct words of a batch of one width are
worked in step: each round makes one merge in every word that has one left.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, table
from .tokens import tokenizer_path

BATCH_BYTES = 8 << 20
#: White space as the tokenizers library's patterns understand it (Unicode property White_Space). Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
_NONE = np.int64(1) << 62


class SegmentTreeMerger:
    """Merges symbol sequences by ranked pairs. pairs: (left id, right id, merged id), lowest rank first."""

    def __init__(self, pairs):
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], _NONE)
        self.made = np.array([m for _, _, m in pairs], np.int64)
        self.order = np.append(self.order, 0)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for one that doesn't merge; ids below 0 stand for nothing."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: np.ndarray) -> np.ndarray:
        """words: one row of symbol ids each, padded with -1 at the end to a power of two. Merged in place; -1 for dead symbols."""
        n, width = words.shape
        tree = np.full((n, 2 * width), _NONE)
        rank = self.ranks(words[:, :-1].ravel(), words[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int64)
        leaf = np.arange(width - 1)
        tree[:, width : 2 * width - 1] = np.where(rank < 0, _NONE, rank * width + leaf)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        ahead = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            r, i = np.divmod(root, width)
            k = after[live, i]  # dies
            nxt = after[live, k]
            words[live, i] = self.made[r]
            words[live, k] = -1
            after[live, i] = nxt
            inside = nxt < width
            ahead[live[inside], nxt[inside]] = i[inside]
            prev = ahead[live, i]
            right = np.where(inside, words[live, np.minimum(nxt, width - 1)], -1)
            left = np.where(prev >= 0, words[live, np.maximum(prev, 0)], -1)
            new = self.ranks(np.concatenate([words[live, i], left]), np.concatenate([right, words[live, i]]))
            own, before = new[: len(live)], new[len(live) :]
            tree[live, width + i] = np.where(own < 0, _NONE, own * width + i)
            tree[live, width + k] = _NONE
            p = np.maximum(prev, 0)
            tree[live, width + p] = np.where(prev < 0, tree[live, width + p], np.where(before < 0, _NONE, before * width + prev))
            for node in (i, k, p):
                node = (width + node) >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < _NONE]
        return words


class WordBPE:
    """Encodes and decodes as the tokenizers library does with the given file (lower case, white space dropped, word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merger = SegmentTreeMerger([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        # printable bytes stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + self.end] for b in range(256)], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", SPACE))
        self.space = regex.compile(f"[{SPACE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def normal(self, text: str) -> str:
        """NFC, then lower case code point by code point."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words (without white space), by widths of powers of two."""
        out, by_width = [[]] * len(words), {}
        raw = [w.encode() for w in words]
        for i, w in enumerate(raw):
            if w:
                by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, which in by_width.items():
            for at in range(0, len(which), rows := max(1, (1 << 20) // width)):
                some = which[at : at + rows]
                lens = np.array([len(raw[i]) for i in some])
                grid = np.full((len(some), width), -1, np.int64)
                inside = np.arange(width) < lens[:, None]
                grid[inside] = self.inner[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]
                grid[np.arange(len(some)), lens - 1] = self.last[[raw[i][-1] for i in some]]
                grid = self.merger.merge(grid)
                kept = grid >= 0
                flat, ends = grid[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
                begin = 0
                for i, end in zip(some, ends, strict=True):
                    out[i], begin = flat[begin:end], end
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """For each text its ids, and what the ids decode to (tokens joined by a space, special tokens included)."""
        chunks, known, per = {}, {}, []
        for t in texts:
            parts = self.cut.split(t) if self.cut and "<|" in t else [t]
            row = []
            for p in parts:
                if p in self.special:
                    row.append(chunks.setdefault((p,), len(chunks)))
                elif p:
                    row += [chunks.setdefault(c, len(chunks)) for c in self._chunks(self.normal(p))]
            per.append(row)
        found = [None if isinstance(c, tuple) else self.word.findall(c) for c in chunks]
        for ws in found:
            for w in ws or ():
                known.setdefault(w, len(known))
        ids = self.word_ids(list(known))
        chunk_ids = [[self.special[c[0]]] if ws is None else [i for w in ws for i in ids[known[w]]] for c, ws in zip(chunks, found, strict=True)]
        chunk_text = [" ".join([self.tokens[i] for i in x]) for x in chunk_ids]
        lens = np.array([len(x) for x in chunk_ids], np.int64)
        flat = np.array([i for x in chunk_ids for i in x], np.int32)
        starts = np.cumsum(lens) - lens
        out = []
        for row in per:
            c = np.array(row, np.int64)
            n = lens[c]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(row) else 0
            out.append(flat[np.arange(total) + np.repeat(starts[c] - (ends - n), n)] if total else flat[:0])
        return out, [" ".join([chunk_text[i] for i in row if chunk_text[i]]) for row in per]

    def _chunks(self, text: str) -> list[str]:
        # str.split takes four separators for white space that the library does not
        return self.space.split(text.strip(" ")) if regex.search("[\x1c-\x1f]", text) else text.split()


def encode_texts(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The columns of df, then ids (array of int) and decoded (string); columns of df with these names give way.

    A null or empty text has no ids and decodes to the empty string; rows are independent of each other, so repeated rows
    give equal results; an empty table gives an empty one."""
    rest = [c for c in df.columns if c not in ("ids", "decoded", text)]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(0).alias("rest"), F.col(text).cast("string").alias("text"))

    def run(batches):
        bpe = WordBPE(tokenizer)
        for b in sliced(batches, BATCH_BYTES):
            ids, decoded = bpe.encode(["" if x is None else x for x in b.column(1).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(decoded, pa.string())], names=["rest", "text", "ids", "decoded"])

    kind = src.schema["rest"].dataType.simpleString()
    out = src.mapInArrow(run, f"rest {kind}, text string, ids array<int>, decoded string")
    return out.select(*[F.col("rest").getField(c).alias(c) for c in rest], F.col("text").alias(text), "ids", "decoded")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_texts(docs, tokenizer_path("word_bpe_49k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digest(ids) -> str:
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
