"""Resolution of a snapshot: the nearest layer wins for each row, and deleted rows are hidden.

A change log has the columns snapshot_id, row_id, change_type and a table's own. Along a chain snapshot ids rise towards its
tip, so the nearest layer is the one with the highest id. Conditions on row_id pass below resolution into the scan; all
others must stay above it, or an older version would reappear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError

INSERT, UPDATE, DELETE = 1, 2, 3
#: Records of a log that one task has at once where they are dealt by rows.
TASK_ROWS = 1 << 18
BOOKKEEPING = ("snapshot_id", "change_type", "schema_version", "block_id", "item_ordinal")


def in_range(df: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Rows from start (0: the first) to before end (0: beyond the last)."""
    if start > 0 and end > 0 and start >= end:
        raise InvalidArgumentError(f"empty range [{start}, {end})")
    if start > 0:
        df = df.where(F.col("row_id") >= start)
    return df.where(F.col("row_id") < end) if end > 0 else df


def visible(log: DataFrame, chain: list[int], start: int = 0, end: int = 0, columns: list[str] | None = None, strategy: str = "window") -> DataFrame:
    """row_id and columns of the rows visible along a chain (target first).

    strategy: window (columns that aren't asked for are never read), or max_by (one aggregate; best when columns are few)."""
    own = columns if columns is not None else [c for c in log.columns if c != "row_id" and c not in BOOKKEEPING]
    rows = in_range(log.where(F.col("snapshot_id").isin(*chain)), start, end)
    if len(chain) == 1:
        return rows.where(F.col("change_type") != DELETE).select("row_id", *own)
    if strategy == "max_by":
        last = rows.groupBy("row_id").agg(F.max_by(F.struct("change_type", *own), "snapshot_id").alias("r"))
        return last.where(F.col("r.change_type") != DELETE).select("row_id", *[F.col(f"r.`{c}`").alias(c) for c in own])
    nearest = Window.partitionBy("row_id").orderBy(F.desc("snapshot_id"))
    # no table has a column of this name (types.RESERVED)
    return rows.withColumn("__nearest", F.row_number().over(nearest)).where((F.col("__nearest") == 1) & (F.col("change_type") != DELETE)).select("row_id", *own)


def overlaid(full: DataFrame, changes: DataFrame, small: bool, start: int = 0, end: int = 0, columns: list[str] | None = None) -> DataFrame:
    """visible() of a FULL layer and the changes above it, for which the FULL layer need not be shuffled: its rows that no change
    touches, and the changes' own nearest records. small: the changes' ids are few enough to send to every task, which the
    caller knows from the block directory."""
    own = columns if columns is not None else [c for c in full.columns if c != "row_id" and c not in BOOKKEEPING]
    over = in_range(changes, start, end)
    ids = over.select("row_id").distinct()
    kept = in_range(full, start, end).where(F.col("change_type") != DELETE).join(F.broadcast(ids) if small else ids, "row_id", "left_anti")
    nearest = Window.partitionBy("row_id").orderBy(F.desc("snapshot_id"))
    top = over.withColumn("__nearest", F.row_number().over(nearest)).where((F.col("__nearest") == 1) & (F.col("change_type") != DELETE))
    return kept.select("row_id", *own).unionByName(top.select("row_id", *own))


def live_ids(log: DataFrame, chain: list[int]) -> DataFrame:
    """row_id of visible rows, without reading any other column: one partial aggregate of packed longs."""
    packed = F.max(F.col("snapshot_id") * 4 + F.col("change_type")).alias("last")
    return log.where(F.col("snapshot_id").isin(*chain)).groupBy("row_id").agg(packed).where(F.col("last") % 4 != DELETE).select("row_id")


def dealt(log: DataFrame, records: int) -> DataFrame:
    """log, each row's records in one task, in so many tasks that a task's share doesn't grow with the log (of `records` in all,
    which the caller knows from the block directory). Aggregates by row then need no tables of a whole input split's rows."""
    return log.repartition(max(1, -(-records // TASK_ROWS)), "row_id")


def histories(log: DataFrame, records: int) -> DataFrame:
    """(history, n): n rows have the records history, an ascending array of snapshot_id * 4 + change_type. Rows have few different
    histories, and what a snapshot shows of a row depends on nothing else (see shown)."""
    packed = (F.col("snapshot_id") * 4 + F.col("change_type")).alias("packed")
    each = dealt(log.select("row_id", packed), records).groupBy("row_id").agg(F.sort_array(F.collect_list("packed")).alias("history"))
    return each.groupBy("history").agg(F.count("*").alias("n"))


def shown(history: str, chain: str) -> Column:
    """Whether a snapshot, whose chain is a column of snapshot ids, shows a row with a history."""
    last = F.array_max(F.filter(history, lambda x: F.array_contains(chain, F.shiftright(x, 2))))
    return F.coalesce(last % 4 != DELETE, F.lit(False))


def batch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (ordinal, row_id; repeated ids stay): each with its row, and found. A list of ids is small beside the table, but its
    size isn't known here, so the optimizer chooses the join."""
    return ids.join(rows.withColumn("found", F.lit(True)), "row_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def own_changes(log: DataFrame, snapshot: int, low: int, high: int) -> DataFrame:
    """The records of one snapshot in blocks [low, high), deletions included, as they were written."""
    if low >= high:
        raise InvalidArgumentError(f"empty block range [{low}, {high})")
    return log.where((F.col("snapshot_id") == snapshot) & (F.col("block_id") >= low) & (F.col("block_id") < high))


def block_directory(log: DataFrame, snapshot: int) -> DataFrame:
    return log.where(F.col("snapshot_id") == snapshot).groupBy("block_id").agg(F.count("*").alias("items"), F.min("row_id").alias("min_row_id"), (F.max("row_id") + 1).alias("max_row_id"))


def key_range(columns: list[str], low: list | None, high: list | None) -> Column:
    """Keys in [low, high), compared column by column from the left; conditions that scans understand."""

    def beyond(bound: list, last) -> Column:
        out = last(F.col(columns[-1]), bound[-1])
        for c, v in reversed(list(zip(columns[:-1], bound[:-1], strict=True))):
            strict = F.col(c) > v if last is _ge else F.col(c) < v
            out = strict | ((F.col(c) == v) & out)
        return out

    cond = F.lit(True)
    if low is not None:
        cond = beyond(low, _ge)
    return cond & beyond(high, _lt) if high is not None else cond


def _ge(c: Column, v) -> Column:
    return c >= v


def _lt(c: Column, v) -> Column:
    return c < v


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """row_id and change (insert, update, delete) from one visible state to another."""
    cols = [c for c in before.columns if c != "row_id"]
    a = before.select("row_id", F.struct(*cols).alias("a"))
    b = after.select("row_id", F.struct(*cols).alias("b"))
    both = a.join(b, "row_id", "full_outer")
    change = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.withColumn("change", change).where("change IS NOT NULL").select("row_id", "change")


def compared(log: DataFrame, before: list[int], after: list[int], columns: list[str], records: int) -> DataFrame:
    """diff() of the states that two chains make visible, from the layers of both: each record is dealt once, also where the
    chains share its layer, and sorted by row, so a task holds one row's records beside its sort."""

    def nearest(chain: list[int]) -> Column:
        return F.max_by(F.struct("change_type", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")), F.when(F.col("snapshot_id").isin(*chain), F.col("snapshot_id")))

    layers = log.where(F.col("snapshot_id").isin(*{*before, *after})).select("row_id", "snapshot_id", "change_type", *[F.col(f"`{c}`") for c in columns])
    both = dealt(layers, records).groupBy("row_id").agg(nearest(before).alias("a"), nearest(after).alias("b"))
    there = lambda x: F.coalesce(F.col(f"{x}.change_type") != DELETE, F.lit(False))
    change = F.when(there("a") & ~there("b"), "delete").when(~there("a") & there("b"), "insert").when(there("a") & there("b") & ~F.col("a.own").eqNullSafe(F.col("b.own")), "update")
    return both.withColumn("change", change).where("change IS NOT NULL").select("row_id", "change")


def reject_codes(changes: DataFrame, live: DataFrame, full: bool = False, strict: bool = True) -> DataFrame:
    """For each change (ordinal, row_id, change_type) the code of the first rule that it breaks: ok, invalid_row_id, duplicate
    (an accepted or refused-by-nothing earlier record has the row), full_only_insert, already_exists, not_found."""
    first = Window.partitionBy("row_id").orderBy("ordinal")
    known = changes.join(live.withColumn("live", F.lit(True)), "row_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    parent = F.lit(None).cast("string")
    if strict and not full:
        parent = F.when((F.col("change_type") == INSERT) & F.col("live"), "already_exists").when((F.col("change_type") != INSERT) & ~F.col("live"), "not_found")
    rule = F.when(F.col("row_id") <= 0, "invalid_row_id").when(F.lit(full) & (F.col("change_type") != INSERT), "full_only_insert").otherwise(parent)
    # only a record that breaks no rule takes the row; later ones are duplicates
    taken = F.min(F.when(F.col("rule").isNull(), F.col("ordinal"))).over(first.rowsBetween(Window.unboundedPreceding, -1))
    coded = known.withColumn("rule", rule).withColumn("taken", taken)
    code = F.when(F.col("rule") == "invalid_row_id", F.col("rule")).when(F.col("taken").isNotNull(), "duplicate").otherwise(F.coalesce("rule", F.lit("ok")))
    return coded.select("ordinal", "row_id", "change_type", code.alias("code"))
