"""Document fingerprints (operator 8): I-Match over randomised sub-lexicons, with DataFrame functions only.

The lexicon holds the terms within a band of document frequencies (so of inverse document frequency). A document's band terms
are sorted, distinct, and hashed once for each randomised subset of the lexicon; subsets get sparser, from the whole lexicon
to one term in 256, so that texts of any length have some that a change spares. Likeness is the share of equal hashes among
subsets that either text has terms of.

The lower end of the band bounds the lexicon: no more than (distinct terms a document) / LOW terms can be in so many documents.
It is found in two passes: counts by hash bucket first, then exact counts of the terms in buckets that can hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, made, table, written
from .token_store import shard_bounds

LOW, HIGH = 0.01, 0.25
#: One term in so many is in each subset: most subsets are so sparse that a long text has a term or two of each.
RATES = (1, 4, *[8] * 2, *[16] * 3, *[32] * 4, *[64] * 4, *[128] * 6, *[256] * 5)
BUCKETS = 1 << 16
ROWS_PER_RANGE, MOST_RANGES = 512, 4096


def terms(text: Column) -> Column:
    """Distinct lower-case terms: what white space and punctuation separate."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[\s\p{Punct}]+"), ""))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """Terms of texts that occur in a share of documents from low to high (and in two at least)."""
    n = docs.count()
    least, most = max(2.0, low * n), high * n
    each = docs.select(F.explode(terms(F.col("text"))).alias("term"))
    full = each.groupBy(_bucket(F.col("term")).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    buckets = [r.bucket for r in full.select("bucket").collect()]  # BUCKETS at most
    if not buckets:
        return []
    # documents frequent enough: at most (distinct terms a document) / low of them
    found = each.where(_bucket(F.col("term")).isin(buckets)).groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= max(most, least)))
    return sorted(r.term for r in found.select("term").collect())


def with_fingerprint(df: DataFrame, text: str, out: str, words: list[str]) -> DataFrame:
    """df with a fingerprint of a text column: hashes joined by '-', a dot for a subset without terms. The last is of all terms."""
    df = made(df, {"_t": F.array_sort(terms(F.col(text)))})
    band = F.filter("_t", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
    df = made(df, {"_b": band})

    def of(some: Column) -> Column:
        return F.when(F.size(some) == 0, F.lit(".")).otherwise(F.lower(F.hex(F.xxhash64(F.concat_ws(" ", some)))))

    def subset(i: int, rate: int) -> Column:
        return F.filter("_b", lambda t: F.pmod(F.xxhash64(F.lit(i), t), F.lit(rate)) == 0) if rate > 1 else F.col("_b")

    parts = [of(subset(i, rate)) for i, rate in enumerate(RATES)]
    return made(df, {out: F.concat_ws("-", *parts, of(F.col("_t")))}).drop("_t", "_b")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets that either text has terms of; texts without terms are alike."""
    pairs = F.filter(F.arrays_zip(F.split(a, "-").alias("x"), F.split(b, "-").alias("y")), lambda p: (p["x"] != ".") | (p["y"] != "."))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same / F.size(pairs))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << e for e in range(len(bounds).bit_length() - 1, -1, -1)]
    all_ = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(all_, n + s - 1) <= key), n + s).otherwise(n))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (key, text and columns) with next_<column>: those of the row with the next smaller key; after the last the first again.

    Rows are dealt to ranges of keys; each range also gets a copy of the row that comes after it."""
    n = max(ROWS_PER_RANGE, -(-df.count() // MOST_RANGES))
    bounds = shard_bounds(df, "key", n)
    dealt = df.withColumn("range", _range_of(F.col("key"), bounds))
    first = dealt.groupBy("range").agg(F.min_by(F.struct(*columns), F.struct(F.lit(-1) - F.col("key"), "text")).alias("row"))
    # a row for each range, MOST_RANGES at most
    down = Window.orderBy(F.desc("range"))
    after = first.select("range", F.coalesce(F.lead("row").over(down), F.first("row").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("row"))
    guests = after.select("range", F.lit(True).alias("guest"), F.lit(None).cast("long").alias("key"), *[F.col(f"row.{c}").alias(c) for c in columns])
    own = dealt.select("range", F.lit(False).alias("guest"), "key", *columns)
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    led = own.unionByName(guests).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("NOT guest").drop("guest", "range")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per row of df: doc_id, n_chars, edited (its last third replaced by the beginning of the next document in
    descending order of ids), both fingerprints, and the likeness of its own to the edited text's and to the next one's.

    A null text is empty; null ids come last and stay null; rows with equal ids are ordered by text; a single row is its own
    next one; an empty table gives no rows; other columns are ignored."""
    src = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = lexicon(src.select("text"), low, high)
    # written, since the ranges are made in several passes
    led = with_next(written(with_fingerprint(src, "text", "fingerprint", words)), ["text", "fingerprint"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = made(led, {"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))}).drop("text", "next_text")
    done = with_fingerprint(edited, "edited", "edited_fingerprint", words)
    return done.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_imatch(spark, sf_dir: str) -> DataFrame:
    done = fingerprints(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
