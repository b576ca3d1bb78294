"""Byte-level BPE ids of many texts: equal pieces of text are encoded once by the tokenizers library.

Pieces meet by hashes; each is compared byte by byte with the one whose ids it takes, so a collision costs time, never ids."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

from .common import U64, offsets_and_bytes, ragged
from .suffixes import distinct_slices, same_bytes

#: Between two non-space characters, a token begins at a single space and never crosses it. Texts where that may not hold go to the library whole.
_WHOLE = re.compile(r" (?=\s|$)|<\|")
_WHOLE_ASCII = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", "<|")
_CHUNK = 200
#: Pieces remembered from batch to batch; beyond, the memory starts anew.
KNOWN_PIECES = 1_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _goes_whole(text: str) -> bool:
    if text.isascii():
        return text.endswith(" ") or any(x in text for x in _WHOLE_ASCII)
    return _WHOLE.search(text) is not None


@functools.lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One encoder a worker process: what it has learnt serves the tasks that follow."""
    return ByteLevelEncoder(path)


class ByteLevelEncoder:
    """encode() gives what Tokenizer.encode_batch(texts, add_special_tokens=False) gives, as flat arrays.

    Pieces that were met before are looked up by a 64-bit hash and compared with the bytes kept; their ids lie side by side in
    one array, their bytes in another."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size()
        self._forget()
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)

    def _forget(self) -> None:
        self.known = np.zeros(0, U64)  # ascending; starts and lens alike
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of the bytes
        self.used, self.flat = 0, np.zeros(0, np.uint32)
        self.kept, self.body = 0, np.zeros(0, np.uint8)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids and the ids' counts by text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        offs, data = offsets_and_bytes(pa.array(texts, pa.large_string()))
        heads = [t if _goes_whole(t) else t.split(" ", 1)[0] for t in texts]
        spaces = np.flatnonzero(data == 32)
        whole = np.array([len(h) == len(t) for h, t in zip(heads, texts, strict=True)])
        doc = np.searchsorted(offs, spaces, side="right") - 1
        spaces, doc = spaces[~whole[doc]], doc[~whole[doc]]
        # each text: its head, then pieces that begin with their space
        per = np.bincount(doc, minlength=len(texts))
        end = np.r_[spaces[1:], len(data)]
        end = np.minimum(end, offs[doc + 1])
        n = end - spaces
        one, of, uniq = distinct_slices(data, spaces, n)
        first, size = spaces[one], n[one]
        slot = self._slots(uniq, data, first, size)
        new = np.flatnonzero(slot < 0)
        if len(self.known) and len(self.known) + len(new) > KNOWN_PIECES:
            self._forget()
            new = np.arange(len(uniq))
        if len(new):
            new = new[np.unique(uniq[new], return_index=True)[1]]  # of pieces whose hashes collide the first is kept
            new = new[~self._has(uniq[new])]
            self._learn(uniq[new], data, first[new], size[new])
            slot = self._slots(uniq, data, first, size)
        apart = np.flatnonzero(slot < 0)  # their hashes are another piece's: encoded each time
        raw = memoryview(data)
        others = self._ids([str(raw[a : a + k], "utf-8") for a, k in zip(first[apart].tolist(), size[apart].tolist(), strict=True)]) if len(apart) else []
        k = np.where(slot >= 0, self.lens[slot] if len(self.lens) else 0, 0).astype(np.int64)
        begin_of = np.where(slot >= 0, self.starts[slot] if len(self.starts) else 0, 0)
        pool = self.flat
        if len(apart):
            k[apart] = [len(e) for e in others]
            begin_of[apart] = len(pool) + np.cumsum(k[apart]) - k[apart]
            pool = np.concatenate([pool, np.array([i for e in others for i in e], np.uint32)])
        # this batch's pieces side by side, then the heads of its texts
        first = self._ids(heads)
        flat = np.concatenate([pool[ragged(begin_of, k)], np.array([i for e in first for i in e], np.uint32)])
        lens = np.concatenate([k, np.array([len(e) for e in first], np.int64)])
        starts = np.cumsum(lens) - lens
        begin = np.cumsum(per + 1) - per - 1
        codes = np.empty(len(spaces) + len(texts), np.int64)
        inner = np.ones(len(codes), bool)
        inner[begin] = False
        codes[inner], codes[begin] = of, len(uniq) + np.arange(len(texts))
        n = lens[codes]
        return flat[ragged(starts[codes], n)], np.add.reduceat(n, begin)

    def _has(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes a known piece has. Only these are looked up: a set of all known ones costs more than encoding does."""
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] == hashes

    def _slots(self, uniq: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where each distinct piece is known, or -1."""
        slot = np.full(len(uniq), -1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, uniq), len(self.known) - 1)
            hit = np.flatnonzero((self.known[at] == uniq) & (self.size[at] == size))
            hit = hit[same_bytes(data, first[hit], self.at[at[hit]], size[hit], other=self.body)]
            slot[hit] = at[hit]
        return slot

    def _learn(self, hashes: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Pieces that begin with their space, in the order of their hashes."""
        raw = memoryview(data)
        fresh = [str(raw[a : a + k], "utf-8") for a, k in zip(first.tolist(), size.tolist(), strict=True)]
        parts, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(fresh), _CHUNK):
            some = fresh[i : i + _CHUNK]
            ids = np.array(self._ids(["".join(some)])[0], np.uint32)
            ends = np.cumsum(self.width[ids])
            want = np.cumsum(size[i : i + _CHUNK])
            cut = np.searchsorted(ends, want)
            if len(ends) != cut[-1] + 1 or not np.array_equal(ends[cut], want):  # a token across two pieces: none is known
                each = self._ids(some)
                ids, cut = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each]) - 1
            parts.append(ids)
            lens.append(np.diff(np.concatenate([[0], cut + 1])))
        parts, lens = np.concatenate(parts), np.concatenate(lens)
        at = np.searchsorted(self.known, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(lens) - lens)
        self.lens = np.insert(self.lens, at, lens)
        self.at = np.insert(self.at, at, self.kept + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.known = np.insert(self.known, at, hashes)
        self.flat, self.used = _grown(self.flat, self.used, parts)
        self.body, self.kept = _grown(self.body, self.kept, data[ragged(first, size)])


def _grown(pool: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """more behind the used part of pool, which has room to grow."""
    need = used + len(more)
    if need > len(pool):
        pool = np.concatenate([pool, np.zeros(max(need - len(pool), len(pool) // 2), pool.dtype)])
    pool[used:need] = more
    return pool, need
