"""Blocks of documents, and an exchange of packed arrays between blocks and hash buckets.

Operators that need corpus-wide facts about every word or byte string of a document (counts, the first document with it)
work in rounds: each block sends its *distinct* hashes, packed, to hash buckets; each bucket answers each block. What a
common word or passage costs a bucket is therefore one entry a block, never one a row. A block is one row of a table in
the shared folder, so every round sees the same blocks, also after an executor was lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, int64s, offsets_and_bytes, sliced, written

BLOCK_BYTES = 8 << 20
SCHEMA = "blk long, n_docs long, ids binary, lens binary, data binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed string; their types and lengths go ahead."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def unsqueezed(packed: bytes) -> list[np.ndarray]:
    body = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for item in body[4:at].decode().split(";"):
        kind, n = item.split(",")
        out.append(np.frombuffer(body, kind, int(n), at))
        at += out[-1].nbytes
    return out


def to_blocks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """One row per about size bytes of text, in the shared folder. A null id is NULL_ID, a null text is empty."""

    def pack(batches):
        part, seq, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0

        def block():
            lens = np.concatenate([np.diff(o) for _, o, _ in held])
            ids = np.concatenate([i for i, _, _ in held])
            data = squeezed(np.concatenate([d for _, _, d in held]))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["blk", "n_docs", "ids", "lens", "data"])

        for b in sliced(batches, size):
            offs, data = offsets_and_bytes(b.column(1))
            if held and held_bytes + len(data) > size:
                yield block()
                seq, held, held_bytes = seq + 1, [], 0
            held.append((int64s(b.column(0)), offs, data))
            held_bytes += len(data)
        if held:
            yield block()

    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(src.mapInArrow(pack, SCHEMA), codec="none")


class Block:
    """A row of a block table, unpacked."""

    parts = ()  # all arrays of its data

    def __init__(self, blk, ids, lens, data):
        self.blk = int(blk)
        self.ids = np.frombuffer(ids, np.int64)
        self.lens = np.frombuffer(lens, np.int64)
        self.parts = unsqueezed(data)
        self.data = self.parts[0]
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens

    def texts(self):
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def per_block(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """fn(Block) gives tuples in the order of schema."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            cols = [b.column(c) for c in ("blk", "ids", "lens", "data")]
            for i in range(b.num_rows):
                rows = list(fn(Block(*(c[i].as_py() for c in cols))))
                if rows:
                    yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(names, zip(*rows, strict=True), strict=True)}, schema=want)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))
    # one block a batch: a block is tens of MB
    return blocks.mapInArrow(run, schema)


def buckets_for(blocks: DataFrame, bytes_per_bucket: int = 8 << 20, least: int = 128) -> int:
    """A power of two that grows with the data, so that what one bucket holds doesn't."""
    total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    return 1 << max(least.bit_length() - 1, int(total // bytes_per_bucket).bit_length())


def cut_by_bucket(sorted_hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted 64-bit hashes (one more than buckets)."""
    shift = U64(64 - (n_buckets.bit_length() - 1))
    edges = np.arange(1, n_buckets, dtype=U64) << shift if n_buckets > 1 else np.zeros(0, U64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def per_bucket(sent: DataFrame, fn) -> DataFrame:
    """sent: (bucket, blk, packed). fn(list of (blk, packed)) yields (blk, packed) answers; a bucket's rows are at most one a block."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", kind="stable")
        rows = [(key[0], b, p) for b, p in fn(list(zip(pdf["blk"], pdf["packed"], strict=True)))]
        return pd.DataFrame(rows, columns=["bucket", "blk", "packed"])

    return sent.groupBy("bucket").applyInPandas(run, "bucket int, blk long, packed binary")


def answered(blocks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(Block, answers as dict bucket -> packed) gives a pandas frame, block by block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = dict(zip(right["bucket"], right["packed"], strict=True))
        out = [fn(Block(*row), got) for row in left[["blk", "ids", "lens", "data"]].itertuples(index=False)]
        return out[0] if len(out) == 1 else pd.concat(out) if out else pd.DataFrame({x.split()[0]: [] for x in schema.split(",")})

    return blocks.groupBy("blk").cogroup(answers.groupBy("blk")).applyInPandas(run, schema)
