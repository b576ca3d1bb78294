"""Packing (operator 1): hierarchical multi-length packing of token ids into fixed windows without padding.

Whole windows are cut off each document. What is left of it is routed to the shortest context-size tier that holds it and
opens a window of that tier; the window's gap is filled with the longest left-over of a shorter tier that fits, and where
none fits, with a cut from the shortest left-over, so that windows end full. The last window of a batch, for which nothing
is left, is cut at powers of two. Every sequence has therefore a power-of-two length of at most the window: no padding.

Windows of one tier are dealt to step groups of equal token counts, balanced by attention cost (sum of squared piece
lengths). Packing needs no exchange: each task packs what it reads, batch by batch, in bounded memory.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int64s, sliced, table
from .tokens import byte_level_encoder, tokenizer_path

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 32 * 1024
BATCH_BYTES = 2 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids_crc32 long"


def plan_sequences(doc_tokens, window: int = 1024, tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, [(document's number, start, length), ...]) for each sequence; window and tiers are powers of two.

    Every token lies in exactly one piece. Documents without tokens get none."""
    tiers = sorted({t for t in tiers if t < window} | {window})
    out, rest = [], []
    for doc, n in enumerate(doc_tokens):
        full = n - n % window
        out += [(window, [(doc, at, window)]) for at in range(0, full, window)]
        if n > full:
            rest.append((n - full, doc, full))
    rest.sort()
    while rest:
        n, doc, at = rest.pop()  # the longest left-over: every other one fits its tier or a shorter one
        tier = next(t for t in tiers if t >= n)
        pieces, gap = [(doc, at, n)], tier - n
        while gap and rest:
            i = bisect.bisect_right(rest, (gap, 1 << 62, 0)) - 1
            if i >= 0:
                m, d, a = rest.pop(i)
                pieces.append((d, a, m))
            else:
                m, d, a = rest.pop(0)
                pieces.append((d, a, gap))
                bisect.insort(rest, (m - gap, d, a + gap))
                m = gap
            gap -= m
        if not gap:
            out.append((tier, pieces))
            continue
        left = tier - gap  # nothing more to fill with: powers of two
        pieces.reverse()
        while left:
            size = 1 << (left.bit_length() - 1)
            seq, need = [], size
            while need:
                d, a, m = pieces.pop()
                take = min(m, need)
                seq.append((d, a, take))
                if m > take:
                    pieces.append((d, a + take, m - take))
                need -= take
            out.append((size, seq))
            left -= size
    return out


def step_groups(sequences, step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group's number for each sequence: groups of one tier with step_tokens tokens each (the last of a tier: fewer), near in attention cost."""
    groups, base, by_tier = [0] * len(sequences), 0, {}
    for i, (tier, pieces) in enumerate(sequences):
        by_tier.setdefault(tier, []).append((sum(m * m for _, _, m in pieces), i))
    for tier in sorted(by_tier, reverse=True):
        seqs = sorted(by_tier[tier], key=lambda x: (-x[0], x[1]))
        each = max(1, step_tokens // tier)
        n = -(-len(seqs) // each)
        for k, (_, i) in enumerate(seqs):  # there and back over the groups, so that each gets dear and cheap ones
            turn, at = divmod(k, n)
            groups[i] = base + (n - 1 - at if turn % 2 else at)
        base += n
    return groups


def pack_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, tiers=TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece, with a checksum of its ids and, unless with_ids is false, the ids (little-endian uint32). A document is its ids, then end_id.

    A null text is empty (one id, the end); a null doc_id stays null; repeated rows are packed as often as they occur; an
    empty table gives no rows; other columns of df are ignored."""

    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches):
        enc, part, seq0, group0 = byte_level_encoder(tokenizer), TaskContext.get().partitionId() << 40, 0, 0
        for b in sliced(batches, BATCH_BYTES):
            flat, counts = enc.encode(["" if x is None else x for x in b.column(1).to_pylist()])
            counts = counts + 1
            ends = np.cumsum(counts)
            ids = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = flat
            seqs = plan_sequences(counts.tolist(), window, tiers)
            groups = step_groups(seqs, step_tokens)
            docs, ats, lens = (np.array(x, np.int64) for x in zip(*(p for _, ps in seqs for p in ps), strict=True))
            per = np.array([len(ps) for _, ps in seqs], np.int64)
            which = np.repeat(np.arange(len(seqs)), per)
            first = (np.cumsum(per) - per)[which]
            run_up = np.cumsum(lens) - lens
            offset = run_up - run_up[first]
            begin = (ends - counts)[docs] + ats
            raw = memoryview(ids.tobytes())
            own = int64s(b.column(0))[docs]
            pieces = [raw[4 * s : 4 * (s + n)] for s, n in zip(begin.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, mask=np.asarray(b.column(0).is_null())[docs]), pa.array(ats), pa.array(lens), pa.array(counts[docs]), pa.array(part + seq0 + which), pa.array(offset), pa.array(np.array([t for t, _ in seqs], np.int32)[which]), pa.array(part + group0 + np.array(groups, np.int64)[which]), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), *([pa.array(pieces, pa.binary())] if with_ids else [])],
                names=[x.split()[0] for x in schema.split(", ")],
            )
            seq0 += len(seqs)
            group0 += max(groups) + 1

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
