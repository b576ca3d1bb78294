"""MinHash near-dedup (operator 7): bottom-k sketches from one hash function.

A document's sketch holds the SKETCH smallest hashes of its distinct five-word shingles (all of them where there are fewer).
Documents with equal sets are one class from the start. Inverted lists of retained values generate candidates; only a class's
rarest values are listed: so many that two classes as similar as asked for share a listed one (exactly where sketches hold the
whole set; else but for a chance below 1e-10, that of fewer than LEAST_SHARED common values among SKETCH). The sketch of the
union estimates the similarity and drops hopeless pairs; exact Jaccard on full sets confirms links.

Lists are worked in rounds, so that no group emits all its pairs. First each class meets the head of its lists (the best one
only): the class with the fewest values of its own. What links join is one component. Classes whose lists still hold other
components stay open: their sketches are deepened to the whole set, on which the number of values that a class has left in its
order bounds an overlap exactly. Each open class meets the best head of a deep list, and the last round pairs, within deep
lists, those classes of different components that the bound lets through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block
from .brown import Words
from .common import NULL_ID, U64, int64s, mixed, offsets_and_bytes, sliced, table, trimmed, written

WORDS, SKETCH, LEAST_SHARED, WHOLE = 5, 64, 24, 48
#: At a similarity of 0.75 fewer than 23 of 64 values of a union sketch agree with a chance below 1e-11.
LEAST_ESTIMATE = 23 / 64


def shingle_sets(ids: np.ndarray, offs: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles' hashes, ascending, of each text. Fewer words than five are one shingle; no words are none."""
    block = Block.__new__(Block)
    block.blk, block.ids, block.lens, block.data = 0, ids, np.diff(offs), data
    block.ends, block.starts = offs[1:], offs[:-1]
    w = Words(block)
    with np.errstate(over="ignore"):
        out = []
        h = w.hash
        size = max(0, len(h) - WORDS + 1)
        roll = np.zeros(size, U64)
        for k in range(WORDS):
            roll = roll * U64(0x9E3779B97F4A7C15) + h[k : k + size]
        roll = mixed(roll).view(np.int64)
        begin = 0
        for end in (w.ends).tolist():  # the end token's place
            n = end - begin
            if n >= WORDS:
                out.append(np.unique(roll[begin : end - WORDS + 1]))
            elif n:
                one = np.array([n], U64)
                for x in h[begin:end]:
                    one = one * U64(0x9E3779B97F4A7C15) + x
                out.append(mixed(one ^ U64(0x5851F42D4C957F2D)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
            begin = end + 1
    return out


def _sketch_table(df: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches, 1 << 20):
            ids = int64s(b.column(0))
            sets = shingle_sets(ids, *offsets_and_bytes(b.column(1)))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digest], pa.int64()), pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digest], pa.int64()), pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))], names=["id", "n", "cid", "cid2", "sketch"])

    return written(df.mapInArrow(trimmed(run), "id long, n long, cid long, cid2 long, sketch array<long>"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of undirected links (a, b): label is the least node of the component. Stars grow and shrink in turn; each
    node's least neighbour comes from a partial aggregate, so a hub costs no task all its links."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(after)
        # done when every node points at one label and labels point nowhere
        facts = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        edges = after
        if tuple(facts) == tuple(before):
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that the sketch of the union doesn't rule out."""
    a = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    share = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    return both.where(share >= LEAST_ESTIMATE).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("cid").alias(c), F.col("elements").alias(f"e{c}")) for c in "ab")
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "ea", "eb").mapInArrow(trimmed(run), "a long, b long"))


def _to_heads(lists: DataFrame) -> DataFrame:
    """Each class of lists (v, cid, label, own) with one class of another label: the head that most of its lists have. The head
    of a list is its class with the least own, the number of values that it has to itself."""
    heads = lists.groupBy("v").agg(F.min(F.struct("own", "cid", "label")).alias("head"))
    met = lists.join(heads, "v").where("label <> head.label").groupBy(F.col("cid").alias("a"), F.col("head.cid").alias("b")).count()
    return met.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def _deep_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(v, cid, label, n, own, left) of classes (cid, elements, label): the values by which a class can meet one of another label.

    Values that meet another label are ordered by how few classes have them, after those that don't (own). left counts a
    class's values from this one on: where it is the first that two classes share, their overlap is no more than either's."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                each = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
                sizes = np.array([len(x) for x in each], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, sizes)) for x in (np.asarray(b.column(0)), np.asarray(b.column(1)), sizes)] + [pa.array(np.concatenate(each))], names=["cid", "label", "n", "v"])

    entries = written(sets.select("cid", "label", "elements").mapInArrow(trimmed(run), "cid long, label long, n long, v long"))
    lists = entries.groupBy("v").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v", "df")
    per = Window.partitionBy("cid")
    ranked = entries.join(lists, "v").withColumns({"rank": F.row_number().over(per.orderBy("df", "v")), "known": F.count("*").over(per)})
    left = ranked.select("v", "cid", "label", "n", (F.col("n") - F.col("known")).alias("own"), (F.col("known") - F.col("rank") + 1).alias("left"))
    return written(left.where(F.lit(100) * F.col("left") >= F.lit(percent) * F.col("n")))


def _deep_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels within deep lists that can be similar enough. The smaller class of a pair needs a shorter part of its
    order than the larger one."""
    x, y = (lists.select("v", F.col("cid").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("label", "n", "left")]) for c in "ab")
    x = x.where(F.lit(100 + percent) * F.col("left_a") >= F.lit(2 * percent) * F.col("n_a"))
    fits = F.lit(100 + percent) * F.least("left_a", "left_b") >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))
    met = x.join(y, "v").where(fits & F.expr("label_a <> label_b AND (n_a < n_b OR (n_a = n_b AND a < b))"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """lists with the components' labels; a class without links is its own."""
    return lists.drop("label").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the least id reachable) and kept (doc_id = component_id).

    Documents are linked where 100 * |common| >= percent * |union| of their shingle sets; percent is 75 at least. A null or
    wordless text has an empty set and is alone; a null id is smaller than all others; rows with one id and different texts
    are told apart by their sets; equal sets are one class, whatever their number; an empty table gives no rows; other
    columns are ignored."""
    if percent < 75:
        raise ValueError("listed values suffice for 75 percent and more only")
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = _sketch_table(src)
    classes = written(base.where("n > 0").groupBy("cid", "cid2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")))
    entries = classes.select("cid", "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    per = Window.partitionBy("cid")
    ranked = entries.join(shared, "v").withColumns({"rank": F.row_number().over(per.orderBy("df", "v")), "known": F.count("*").over(per)})
    held = F.least("n", F.lit(SKETCH))
    needed = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * percent / 100)).otherwise(LEAST_SHARED)
    # values that nobody shares are the rarest of all
    own = held - F.col("known")
    listed = ranked.where(own + F.col("rank") <= held - needed + 1).select("v", "cid", F.col("cid").alias("label"), own.alias("own"))
    listed = written(listed)
    candidates = listed.select("cid").distinct()
    first = _estimated(_to_heads(listed), classes.join(candidates, "cid"))

    def elements(batches):
        for b in sliced(batches, 1 << 20):
            sets = shingle_sets(np.zeros(b.num_rows, np.int64), *offsets_and_bytes(b.column(1)))
            want = b.column(0).to_pylist()
            cids = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8 * 2).digest()[:8], "little", signed=True) for s in sets]
            ok = [c == w for c, w in zip(cids, want, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, k in zip(cids, ok, strict=True) if k], pa.int64()), pa.array([s.tobytes() for s, k in zip(sets, ok, strict=True) if k], pa.binary())], names=["cid", "elements"])

    reps = classes.join(candidates, "cid").select("cid", F.col("rep").alias("id"))
    full = src.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text").join(reps, "id").select("cid", "text").mapInArrow(trimmed(elements), "cid long, elements binary")
    sets = written(full.dropDuplicates(["cid"]))
    links = _confirmed(first, sets, percent)
    by = _labelled(listed, components(links))
    unsettled = by.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    still_open = by.join(unsettled, "v").groupBy("cid").agg(F.min("label").alias("label"))
    lists = _deep_lists(sets.join(still_open, "cid"), percent)
    some = classes.join(candidates, "cid")
    links = written(links.unionByName(_confirmed(_estimated(_to_heads(lists), some), sets, percent)))
    more = _confirmed(_estimated(_deep_pairs(_labelled(lists, components(links)), percent), some), sets, percent)
    label = components(links.unionByName(more))
    reps = classes.select("cid", "cid2", "rep").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component"))
    named = reps.join(least, "label").select("cid", "cid2", "component")
    out = base.select("id", "n", "cid", "cid2").join(named, ["cid", "cid2"], "left").withColumn("component", F.coalesce("component", "id"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
