"""Token-ID output (operator 6): shards of raw id payloads with a minimal perfect hash index each.

A shard is one row of a Parquet data set (its files are committed by Spark, so lost executors leave none half written):

    shard int, n_docs long, n_ids long, keys binary, payload binary, index binary

payload holds the ids of the shard's documents in ascending document order, little-endian unsigned 16-bit where the
vocabulary allows, else 32-bit. keys are the distinct document ids (little-endian int64). index maps a key to its place in
constant time: levels of bit arrays, each holding the keys that collide with none there; a key's place is the number of
bits set before its own. At that place lie a stored 32-bit fingerprint (a foreign key is told apart), the offset of the
key's first id, and the key's numbers of rows and of ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U64, int64s, mixed, shared_dir, sliced, table
from .tokens import byte_level_encoder, tokenizer_path

BATCH_BYTES = 2 << 20
ROWS_PER_SHARD = 1024
MOST_SHARDS = 50_000
SHARD_SCHEMA = "shard int, n_docs long, n_ids long, keys binary, payload binary, index binary"
_GAMMA = 2
_MAGIC = b"TIDS"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mixed((keys.astype(np.int64).view(U64) ^ U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).copy())


class PerfectIndex:
    """A minimal perfect hash over distinct int64 keys with a fingerprint and a value row for each."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, values: np.ndarray):
        self.levels, self.prints, self.values = levels, prints, values
        self.before, total = [], 0
        for bits in levels:
            self.before.append(np.cumsum(bits) - bits + total)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectIndex:
        levels, left = [], np.asarray(keys, np.int64)
        while len(left):
            size = max(8, _GAMMA * len(left))
            at = (_hash(left, len(levels)) % U64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits.astype(np.uint8))
            left = left[~bits[at]]
        index = cls(levels, np.zeros(len(keys), np.uint32), np.zeros((len(keys), values.shape[1]), np.int64))
        place = index.place(keys)
        index.prints[place] = _prints(keys)
        index.values[place] = values
        return index

    def place(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level holds; else a place, that of another key for most foreign ones."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, bits in enumerate(self.levels):
            at = (_hash(keys[left], seed) % U64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = self.before[seed][at[hit]]
            left = left[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values): a key whose fingerprint differs from the stored one isn't found."""
        keys = np.asarray(keys, np.int64)
        place = self.place(keys)
        found = place >= 0
        if not len(self.prints):
            return found, np.zeros((len(keys), self.values.shape[1]), np.int64)
        found &= self.prints[place] == _prints(keys)
        return found, self.values[place]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.prints), self.values.shape[1], *map(len, self.levels)], "<i8")
        return b"".join([_MAGIC, head.tobytes(), *(np.packbits(x).tobytes() for x in self.levels), self.prints.astype("<u4").tobytes(), self.values.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectIndex:
        if raw[:4] != _MAGIC:
            raise ValueError("not an index")
        n_levels, n, width = np.frombuffer(raw, "<i8", 3, 4).tolist()
        sizes = np.frombuffer(raw, "<i8", n_levels, 28).tolist()
        at, levels = 28 + 8 * n_levels, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size))
            at += (size + 7) // 8
        prints = np.frombuffer(raw, "<u4", n, at)
        return cls(levels, prints, np.frombuffer(raw, "<i8", n * width, at + 4 * n).reshape(n, width))


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(np.asarray(keys, np.int64), 0x5EED) >> U64(32)).astype(np.uint32)


def shard_bounds(df: DataFrame, doc_id: str = "doc_id", rows_per_shard: int = ROWS_PER_SHARD) -> list[int]:
    """Ids at which a new shard begins; MOST_SHARDS at most, whatever the size of the table."""
    ids = df.select(F.col(doc_id).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    n = ids.count()
    shards = min(MOST_SHARDS, -(-n // rows_per_shard))
    if shards < 2:
        return []
    at = ids.approxQuantile("doc_id", [k / shards for k in range(1, shards)], max(1e-5, 0.05 / shards))
    return sorted({int(x) for x in at})


def write_token_shards(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, rows_per_shard: int = ROWS_PER_SHARD) -> str:
    """Encodes every text, appends end_id, and writes the shards in ascending order of documents to path.

    A null text is empty (the end only). Null ids come first, under one key; repeated ids are one key with several rows, in
    the order of their ids' bytes. An empty table gives a data set without shards. Other columns are ignored."""
    bounds = np.array(shard_bounds(df, doc_id, rows_per_shard), np.int64)

    def encode(batches):
        enc = byte_level_encoder(tokenizer)
        kind = "<u2" if len(enc.width) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for b in sliced(batches, BATCH_BYTES):
            flat, counts = enc.encode(["" if x is None else x for x in b.column(1).to_pylist()])
            flat, keys = flat.astype(kind), int64s(b.column(0))
            ends, end = np.cumsum(counts), np.array([end_id], kind).tobytes()
            raw, size = memoryview(flat.tobytes()), flat.itemsize
            ids = [bytes(raw[size * (e - c) : size * e]) + end for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, keys, side="right").astype(np.int32)), pa.array(keys), pa.array(np.full(len(keys), size, np.int32)), pa.array(ids, pa.binary())], names=["shard", "key", "width", "ids"])

    def shard(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "ids"], kind="stable")
        width = int(pdf["width"].iloc[0])
        sizes = pdf["ids"].str.len().to_numpy(np.int64) // width
        keys, first, rows = np.unique(pdf["key"].to_numpy(np.int64), return_index=True, return_counts=True)
        begin = np.cumsum(sizes) - sizes
        values = np.stack([begin[first], rows, np.add.reduceat(sizes, first)], axis=1)
        payload = width.to_bytes(1, "little") + b"".join(pdf["ids"])
        # a key with several rows: their single counts follow the payload, in order
        counts = sizes[np.repeat(rows > 1, rows)].astype("<i8").tobytes()
        index = PerfectIndex.build(keys, values).to_bytes()
        return pd.DataFrame({"shard": [key[0]], "n_docs": [len(pdf)], "n_ids": [int(sizes.sum())], "keys": [keys.astype("<i8").tobytes()], "payload": [payload + counts], "index": [index]})

    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = src.mapInArrow(encode, "shard int, key long, width int, ids binary")
    ids.groupBy("shard").applyInPandas(shard, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


class Shard:
    """A shard in memory: keyed access to its documents' ids."""

    def __init__(self, n_ids: int, keys: bytes, payload: bytes, index: bytes):
        width = payload[0]
        self.ids = np.frombuffer(payload, f"<u{width}", n_ids, 1)
        self.keys = np.frombuffer(keys, "<i8")
        self.index = PerfectIndex.from_bytes(index)
        self.repeats = np.frombuffer(payload, "<i8", offset=1 + width * n_ids)
        self._rows = None

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of each key found: number of the key in keys, offset of the first id, number of ids."""
        found, values = self.index.lookup(keys)
        which, out = np.flatnonzero(found), ([], [], [])
        values = values[which]
        one = values[:, 1] == 1
        out = [which[one], values[one, 0], values[one, 2]]
        if not one.all():
            several, _ = self.index.lookup(self.keys)[1], None
            order = np.argsort(several[:, 0], kind="stable")
            multi = several[order][several[order][:, 1] > 1]
            at = dict(zip(multi[:, 0].tolist(), (np.cumsum(multi[:, 1]) - multi[:, 1]).tolist(), strict=True))
            for k, (begin, rows, _) in zip(which[~one].tolist(), values[~one].tolist(), strict=True):
                sizes = self.repeats[at[begin] : at[begin] + rows]
                out[0] = np.append(out[0], [k] * rows)
                out[1] = np.append(out[1], begin + np.cumsum(sizes) - sizes)
                out[2] = np.append(out[2], sizes)
        return tuple(out)


def read_token_shards(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document, from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian uint32) and, unless with_ids is false, these ids. Every key goes through its shard's index."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = sorted((r.shard, r.n_ids) for r in shards.select("shard", "n_ids").collect())  # MOST_SHARDS rows at most
    before, total = {}, 0
    for s, n in sizes:
        before[s], total = total, total + n

    def run(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                shard = Shard(row["n_ids"], row["keys"], row["payload"], row["index"])
                which, begin, n = shard.spans(shard.keys)
                order = np.argsort(begin, kind="stable")
                which, begin, n = which[order], begin[order], n[order]
                raw = memoryview(shard.ids.astype("<u4").tobytes())
                own = shard.keys[which]
                ids = [raw[4 * s : 4 * (s + k)] for s, k in zip(begin.tolist(), n.tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(before[row["shard"]] + begin), pa.array(n), crc, *([pa.array(ids, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return shards.select("shard", "n_ids", "keys", "payload", "index").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def lookup_ids(spark, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: the ids of each key of a DataFrame; keys that the shards don't hold give no row."""
    heads = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # a shard's first key bounds its range; MOST_SHARDS rows at most
    first = sorted((int(np.frombuffer(r["keys"], "<i8", 1)[0]), r["shard"]) for r in heads.select("shard", F.substring("keys", 1, 8).alias("keys")).collect())
    lows, names = np.array([x for x, _ in first], np.int64), np.array([s for _, s in first], np.int32)

    def route(batches):
        for b in batches:
            ks = int64s(b.column(0))
            at = np.searchsorted(lows, ks, side="right") - 1
            ok = at >= 0
            yield pa.RecordBatch.from_arrays([pa.array(names[at[ok]] if len(names) else np.zeros(0, np.int32)), pa.array(ks[ok])], names=["shard", "key"])

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"doc_id": [], "n_tokens": [], "ids": []}
        for row in right.to_dict("records") if len(left) else []:
            shard, ks = Shard(row["n_ids"], row["keys"], row["payload"], row["index"]), left["key"].to_numpy(np.int64)
            for w, s, n in zip(*shard.spans(ks), strict=True):
                out["doc_id"].append(None if ks[w] == NULL_ID else int(ks[w]))
                out["n_tokens"].append(int(n))
                out["ids"].append(shard.ids[s : s + n].astype("<u4").tobytes())
        return pd.DataFrame({"doc_id": pd.array(out["doc_id"], "Int64"), "n_tokens": pd.array(out["n_tokens"], "Int64"), "ids": out["ids"]})

    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().mapInArrow(route, "shard int, key long")
    return asked.groupBy("shard").cogroup(heads.groupBy("shard")).applyInPandas(probe, "doc_id long, n_tokens long, ids binary")


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    path = write_token_shards(table(spark, sf_dir, "documents"), shared_dir(spark), tokenizer_path("byte_bpe_50k.json"))
    return read_token_shards(spark, path, with_ids=False)


__all__ = ["PerfectIndex", "Shard", "lookup_ids", "op6_token_store", "read_token_shards", "shard_bounds", "write_token_shards"]
