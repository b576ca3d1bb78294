"""A version chain over the orders table, persisted as a store, and the queries over it with their SQL.

Snapshots: 1 FULL, 2 DELTA on 1, 3 DELTA on 2, 4 FULL (checkpoint of 3), 5 DELTA on 1 (a branch), 6 empty DELTA on 3.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..sources.store import Store
from ..types import Column

COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
#: For the oracles' SQL.
SNAPSHOTS = [(1, "FULL", 0), (2, "DELTA", 1), (3, "DELTA", 2), (4, "FULL", 0), (5, "DELTA", 1), (6, "DELTA", 3)]
BLOCK_ROWS = 1000
#: Opaque blobs that snapshots 1 and 3 carry.
META = {1: "base", 3: "patch-3"}
ORDERS = [Column("o_custkey", "int64"), Column("o_orderstatus", "string"), Column("o_totalprice", "float64"), Column("o_orderdate", "datetime")]
CUSTOMER = [Column("c_name", "string"), Column("c_acctbal", "float64")]
_STORES: dict[tuple[str, str], Store] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str, path: str, rows_per_block: int = BLOCK_ROWS) -> Store:
    """A new store at path with the chain of the orders in sf_dir."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders")

    def rows(when, value=price) -> DataFrame:
        at = F.struct(F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(0).cast("short").alias("ns")).alias("o_orderdate")
        return orders.where(when).select((k + 1).cast("long").alias("row_id"), F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderstatus"), value.cast("double").alias("o_totalprice"), at)

    store = Store.create(spark, path, rows_per_block=rows_per_block)
    tx = store.begin()
    tx.define_table("orders", ORDERS)
    tx.insert("orders", rows(k % 10 != 2))
    tx.set_meta(META[1].encode())
    base = tx.commit()
    tx = store.begin(base)
    tx.define_table("customer", CUSTOMER, "crm")
    tx.update("orders", rows(k % 10 == 0, price + 100))
    tx.delete("orders", rows(k % 10 == 1).select("row_id"))
    tx.insert("orders", rows(k % 10 == 2))
    second = tx.commit()
    tx = store.begin(second)
    tx.update("orders", rows(k % 20 == 0, price + 200))
    tx.delete("orders", rows(k % 10 == 3).select("row_id"))
    tx.set_meta(META[3].encode())
    third = tx.commit()
    store.checkpoint(third)
    tx = store.begin(base)
    tx.delete("orders", rows((k % 7 == 0) & (k % 10 != 2)).select("row_id"))
    tx.commit()
    store.begin(third).commit()
    store.close()
    return Store.open(spark, path, read_only=True)


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of sf_dir's chain: built below spark.checkpoint.dir (unset: a local temporary folder, as in tests) when a session
    first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.gettempdir()}/tidemark-stores"
        _STORES[key] = build(spark, sf_dir, f"{root.rstrip('/')}/chain-{uuid.uuid4().hex}")
    return _STORES[key]


def _plain(df: DataFrame) -> DataFrame:
    """The date as a plain timestamp, its nanoseconds being 0."""
    return df.withColumn("o_orderdate", F.col("o_orderdate.ts")) if "o_orderdate" in df.columns else df


def log(spark: SparkSession, sf_dir: str, snapshots: list[int] | None = None) -> DataFrame:
    """The change log of orders in the store."""
    s = store(spark, sf_dir)
    view = s.catalog
    return _plain(s._log(view, snapshots or sorted(view.snapshots), view.table(1, "orders")))


def chain(spark, sf_dir, snapshot: int) -> list[int]:
    return store(spark, sf_dir).catalog.chain(snapshot)


def scan(spark, sf_dir, snapshot: int, **more) -> DataFrame:
    return _plain(store(spark, sf_dir).scan(snapshot, "orders", **more))


def q_tables(snapshot: int, ns: str | None = None):
    def run(spark, d):
        s = store(spark, d)
        known = s.catalog.tables(snapshot)
        rows = [(t["id"], t["ns"], t["name"], a) for a, t in ((a, known[a]) for a in s.tables(snapshot, ns))]
        return spark.createDataFrame(rows, "table_id long, ns string, name string, address string")

    return run


def q_scan(snapshot: int):
    return lambda spark, d: scan(spark, d, snapshot)


def q_range(spark, d):
    return scan(spark, d, 3, start=500, end=1200)


def q_get(spark, d):
    return scan(spark, d, 3, start=101, end=102)


def _asked(spark):
    return spark.createDataFrame([(i, r) for i, r in enumerate([7, 3, 7, 2, 1, 12, 4, 900, 7])], "ordinal long, row_id long")


def _live(spark, d, snapshot: int) -> DataFrame:
    s, c = store(spark, d), chain(spark, d, snapshot)
    rows = log(spark, d, c).select("row_id", "snapshot_id", "change_type")
    return R.live_ids(R.dealt(rows, s._records(s.catalog, c, s.catalog.table(1, "orders"))), c)


def q_exists(spark, d):
    live = _live(spark, d, 3).withColumn("live", F.lit(True))
    return _asked(spark).join(live, "row_id", "left").select("ordinal", "row_id", F.coalesce("live", F.lit(False)).alias("found"))


def q_batch(spark, d):
    return R.batch(scan(spark, d, 3), _asked(spark)).select("ordinal", "row_id", "found", "o_custkey", "o_totalprice")


def q_blocks(spark, d):
    """The directory that the commit holds, not one made from the data."""
    rows = [(b["id"], b["items"], b["min"], b["max"]) for b in store(spark, d).blocks(2, "orders")]
    return spark.createDataFrame(rows, "block_id long, items long, min_row_id long, max_row_id long")


def q_scan_blocks(spark, d):
    return store(spark, d).scan_blocks(2, "orders", 0, 2).select("block_id", "row_id", "change_type", "o_totalprice")


def _histories(spark, d) -> DataFrame:
    """One scan of the log: how many rows have which records."""
    s = store(spark, d)
    view = s.catalog
    return R.histories(log(spark, d), s._records(view, view.snapshots, view.table(1, "orders")))


def q_count(spark, d):
    """One scan of the log for all snapshots."""
    s = store(spark, d)
    chains = spark.createDataFrame([(t, s.catalog.chain(t)) for t in sorted(s.catalog.snapshots)], "snapshot_id long, chain array<long>")
    return _histories(spark, d).crossJoin(F.broadcast(chains)).where(R.shown("history", "chain")).groupBy("snapshot_id").agg(F.sum("n").alias("n"))


def q_chain(spark, d):
    return spark.createDataFrame([(6, i, s) for i, s in enumerate(chain(spark, d, 6))], "snapshot_id long, step long, ancestor long")


def q_snapshots(spark, d):
    s = store(spark, d)
    rows = [(x.id, x.type, x.parent, len(s.catalog.chain(x.id)), sum(b["items"] for t in x.data.values() for b in t["blocks"])) for x in s.list_snapshots()]
    return spark.createDataFrame(rows, "snapshot_id long, type string, parent long, depth long, changes long")


def q_latest(spark, d):
    return spark.createDataFrame([(store(spark, d).catalog.latest,)], "latest long")


def q_schema(spark, d):
    return spark.createDataFrame([(i + 1, c.name, c.type) for i, c in enumerate(store(spark, d).schema(3, "orders"))], "column_id long, name string, type string")


def q_meta(spark, d):
    s = store(spark, d)
    rows = [(x, None if (m := s.meta(x)) is None else m.decode()) for x in sorted(s.catalog.snapshots)]
    return spark.createDataFrame(rows, "snapshot_id long, meta string")


def q_changes(spark, d):
    return log(spark, d).groupBy("snapshot_id", "change_type").agg(F.count("*").alias("n"))


def q_rejects(spark, d):
    """A crafted batch on snapshot 3: every rule is broken once."""
    rows = [(0, 0, 1), (1, 1, 1), (2, 2, 2), (3, 2, 1), (4, 2, 1), (5, 5, 3), (6, 5, 1), (7, 4, 3), (8, 10**9, 1)]
    return R.reject_codes(spark.createDataFrame(rows, "ordinal long, row_id long, change_type int"), _live(spark, d, 3))


def q_checkpoint(spark, d):
    return store(spark, d).diff(3, 4, "orders").agg(F.count("*").alias("differences"))


def q_verify(spark, d):
    """After a full verification of the store: per snapshot records, repeated rows, and rows that break a rule against their
    parent's state. One scan; the parents' states come from rows' histories."""
    s = store(spark, d)
    s.verify(full=True)
    parents = [(x.id, x.parent, s.catalog.chain(x.parent) if x.parent else []) for x in s.list_snapshots()]
    ids = F.broadcast(spark.createDataFrame(parents, "snapshot_id long, parent long, above array<long>"))
    own = F.filter("history", lambda x: F.shiftright(x, 2) == F.col("snapshot_id"))
    per = _histories(spark, d).crossJoin(ids).withColumn("own", own).where(F.size("own") > 0)
    broken = (F.col("parent") != 0) & ((F.array_max("own") % 4 == R.INSERT) == R.shown("history", "above"))
    facts = per.groupBy("snapshot_id").agg(F.sum(F.col("n") * F.size("own")).alias("records"), F.sum(F.col("n") * (F.size("own") - 1)).alias("repeated"), F.sum(F.when(broken, F.col("n")).otherwise(0)).alias("broken"))
    none = F.lit(0).cast("long")
    return ids.select("snapshot_id").join(facts, "snapshot_id", "left").select("snapshot_id", *[F.coalesce(c, none).alias(c) for c in ("records", "repeated", "broken")])


def q_stats(spark, d):
    x = store(spark, d).stats()
    return spark.createDataFrame([(x["snapshots"], x["tables"], x["blocks"], x["changes"], x["visible_rows"])], "snapshots long, tables long, blocks long, changes long, visible_rows long")


def q_revenue(spark, d):
    """Revenue by status as of snapshot 3."""
    return scan(spark, d, 3, columns=["o_orderstatus", "o_totalprice"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def q_join(spark, d):
    rows = scan(spark, d, 3, columns=["o_custkey", "o_totalprice"])
    who = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return rows.join(who, rows.o_custkey == who.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def q_topk(spark, d):
    return scan(spark, d, 3, columns=["o_totalprice"]).orderBy(F.desc("o_totalprice"), "row_id").limit(10)


def q_window(spark, d):
    rank = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "row_id")
    return scan(spark, d, 3, columns=["o_custkey", "o_totalprice"]).withColumn("rank", F.row_number().over(rank)).where("rank <= 2")


def q_diff(spark, d):
    return store(spark, d).diff(2, 5, "orders").groupBy("change").agg(F.count("*").alias("n"))


def q_key_range(spark, d):
    return scan(spark, d, 3, columns=["o_custkey", "o_totalprice"]).where(R.key_range(["o_custkey", "row_id"], [3, 400], [9, 100]))


def q_predicate(spark, d):
    """A condition on a value holds for the visible version only."""
    return scan(spark, d, 3, columns=["o_totalprice"]).where("o_totalprice < 150000")


QUERIES = {
    "scan_full": q_scan(1), "scan_delta": q_scan(3), "scan_branch": q_scan(5), "scan_checkpoint": q_scan(4), "scan_empty_delta": q_scan(6),
    "scan_max_by": lambda s, d: scan(s, d, 3, strategy="max_by"), "scan_range": q_range, "get_row": q_get, "exists_rows": q_exists, "read_batch_dups": q_batch, "scan_blocks": q_scan_blocks,
    "blocks_directory": q_blocks, "logical_row_count": q_count, "snapshot_chain": q_chain, "list_snapshots": q_snapshots, "latest_snapshot": q_latest,
    "tables_at": q_tables(3), "tables_in_ns": q_tables(3, "crm"), "schema_at": q_schema, "meta_inherited": q_meta, "change_counts": q_changes,
    "reject_codes": q_rejects, "checkpoint_equals_scan": q_checkpoint, "verify_report": q_verify, "stats": q_stats, "agg_by_status_as_of": q_revenue,
    "join_customer_as_of": q_join, "topk_as_of": q_topk, "window_rank_as_of": q_window, "snapshot_diff": q_diff, "key_range": q_key_range, "predicate_above_resolution": q_predicate,
}

# SQL: layers by NOT EXISTS for scans of snapshot 3, by a window elsewhere, so that a mistake isn't shared
_OWN = ", ".join(COLUMNS)
_NULLS = "NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE, NULL::TIMESTAMP"


def _own(price: str = "o_totalprice") -> str:
    return f"o_custkey, o_orderstatus, {price}, o_orderdate"


_LOG = f"""WITH RECURSIVE log(snapshot_id, row_id, change_type, {_OWN}) AS (
  SELECT 1, o_orderkey + 1, 1, {_own()} FROM orders WHERE o_orderkey % 10 <> 2
  UNION ALL SELECT 2, o_orderkey + 1, 2, {_own('o_totalprice + 100')} FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 2, o_orderkey + 1, 3, {_NULLS} FROM orders WHERE o_orderkey % 10 = 1
  UNION ALL SELECT 2, o_orderkey + 1, 1, {_own()} FROM orders WHERE o_orderkey % 10 = 2
  UNION ALL SELECT 3, o_orderkey + 1, 2, {_own('o_totalprice + 200')} FROM orders WHERE o_orderkey % 20 = 0
  UNION ALL SELECT 3, o_orderkey + 1, 3, {_NULLS} FROM orders WHERE o_orderkey % 10 = 3
  UNION ALL SELECT 4, o_orderkey + 1, 1, {_own('CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice + 200 WHEN o_orderkey % 10 = 0 THEN o_totalprice + 100 ELSE o_totalprice END')} FROM orders WHERE o_orderkey % 10 NOT IN (1, 3)
  UNION ALL SELECT 5, o_orderkey + 1, 3, {_NULLS} FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 10 <> 2),
snaps(snapshot_id, type, parent) AS (VALUES {', '.join(f"({s}, '{t}', {p})" for s, t, p in SNAPSHOTS)}),
chains(snapshot_id, step, ancestor) AS (SELECT snapshot_id, 0, snapshot_id FROM snaps UNION ALL SELECT c.snapshot_id, c.step + 1, s.parent FROM chains c JOIN snaps s ON s.snapshot_id = c.ancestor WHERE s.parent > 0),
vis AS (SELECT snapshot_id, row_id, {_OWN} FROM (SELECT c.snapshot_id, l.row_id, l.change_type, {', '.join('l.' + c for c in COLUMNS)},
  row_number() OVER (PARTITION BY c.snapshot_id, l.row_id ORDER BY c.step) AS n FROM chains c JOIN log l ON l.snapshot_id = c.ancestor) WHERE n = 1 AND change_type <> 3),
v3 AS (SELECT l.* FROM log l WHERE l.snapshot_id IN (1, 2, 3) AND l.change_type <> 3 AND NOT EXISTS (SELECT 1 FROM log n WHERE n.snapshot_id IN (1, 2, 3) AND n.snapshot_id > l.snapshot_id AND n.row_id = l.row_id)),
blocked AS (SELECT *, ((row_id - min(row_id) OVER ()) // (ceil((max(row_id) OVER () - min(row_id) OVER () + 1) / ceil(count(*) OVER () / {BLOCK_ROWS}.0))::BIGINT))::BIGINT AS block_id FROM log WHERE snapshot_id = 2),
made(snapshot_id, n) AS (SELECT snapshot_id, count(*) FROM log GROUP BY 1),
asked(ordinal, row_id) AS (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate([7, 3, 7, 2, 1, 12, 4, 900, 7]))})
"""


def _visible(s: int) -> str:
    return f"{_LOG} SELECT row_id, {_OWN} FROM vis WHERE snapshot_id = {s}"


def _pairs(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Tables as the chain defines them: id, namespace, name, address.
_TABLES = [(1, "user", "orders", "orders"), (2, "crm", "customer", "crm.customer")]
ORACLES = {
    "scan_full": _visible(1), "scan_branch": _visible(5), "scan_checkpoint": _visible(4), "scan_empty_delta": _visible(6), "scan_max_by": _visible(3),
    "scan_delta": f"{_LOG} SELECT row_id, {_OWN} FROM v3",
    "scan_range": f"{_LOG} SELECT row_id, {_OWN} FROM v3 WHERE row_id >= 500 AND row_id < 1200",
    "get_row": f"{_LOG} SELECT row_id, {_OWN} FROM v3 WHERE row_id = 101",
    "exists_rows": f"{_LOG} SELECT a.ordinal::BIGINT AS ordinal, a.row_id::BIGINT AS row_id, v.row_id IS NOT NULL AS found FROM asked a LEFT JOIN v3 v USING (row_id)",
    "read_batch_dups": f"{_LOG} SELECT a.ordinal::BIGINT AS ordinal, a.row_id::BIGINT AS row_id, v.row_id IS NOT NULL AS found, v.o_custkey, v.o_totalprice FROM asked a LEFT JOIN v3 v USING (row_id)",
    "scan_blocks": f"{_LOG} SELECT block_id, row_id, change_type, o_totalprice FROM blocked WHERE block_id < 2",
    "blocks_directory": f"{_LOG} SELECT block_id, count(*) AS items, min(row_id) AS min_row_id, max(row_id) + 1 AS max_row_id FROM blocked GROUP BY 1",
    "logical_row_count": f"{_LOG} SELECT snapshot_id::BIGINT AS snapshot_id, count(*) AS n FROM vis GROUP BY 1",
    "snapshot_chain": f"{_LOG} SELECT snapshot_id::BIGINT AS snapshot_id, step::BIGINT AS step, ancestor::BIGINT AS ancestor FROM chains WHERE snapshot_id = 6",
    "list_snapshots": f"{_LOG} SELECT s.snapshot_id::BIGINT AS snapshot_id, s.type, s.parent::BIGINT AS parent, (SELECT count(*) FROM chains c WHERE c.snapshot_id = s.snapshot_id) AS depth, (SELECT count(*) FROM log l WHERE l.snapshot_id = s.snapshot_id) AS changes FROM snaps s",
    "latest_snapshot": f"{_LOG} SELECT max(snapshot_id)::BIGINT AS latest FROM snaps",
    "tables_at": f"SELECT column0::BIGINT AS table_id, column1 AS ns, column2 AS name, column3 AS address FROM (VALUES {_pairs(_TABLES)}) t(column0, column1, column2, column3)",
    "tables_in_ns": f"SELECT column0::BIGINT AS table_id, column1 AS ns, column2 AS name, column3 AS address FROM (VALUES {_pairs(_TABLES)}) t(column0, column1, column2, column3) WHERE column1 = 'crm'",
    "schema_at": "SELECT row_number() OVER (ORDER BY CASE column_name WHEN 'o_custkey' THEN 1 WHEN 'o_orderstatus' THEN 2 WHEN 'o_totalprice' THEN 3 ELSE 4 END)::BIGINT AS column_id, column_name AS name, CASE WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'datetime' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'DOUBLE' THEN 'float64' WHEN column_type = 'BIGINT' THEN 'int64' END AS type FROM (DESCRIBE orders) WHERE column_name IN ('o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate')",
    "meta_inherited": f"{_LOG}, blobs(snapshot_id, meta) AS (VALUES {_pairs(META.items())}) SELECT s.snapshot_id::BIGINT AS snapshot_id, (SELECT b.meta FROM chains c JOIN blobs b ON b.snapshot_id = c.ancestor WHERE c.snapshot_id = s.snapshot_id ORDER BY c.step LIMIT 1) AS meta FROM snaps s",
    "change_counts": f"{_LOG} SELECT snapshot_id::BIGINT AS snapshot_id, change_type, count(*) AS n FROM log GROUP BY 1, 2",
    "reject_codes": "SELECT column0::BIGINT AS ordinal, column1::BIGINT AS row_id, column2 AS change_type, column3 AS code FROM (VALUES (0, 0, 1, 'invalid_row_id'), (1, 1, 1, 'already_exists'), (2, 2, 2, 'not_found'), (3, 2, 1, 'ok'), (4, 2, 1, 'duplicate'), (5, 5, 3, 'ok'), (6, 5, 1, 'duplicate'), (7, 4, 3, 'not_found'), (8, 1000000000, 1, 'ok')) t(column0, column1, column2, column3)",
    "checkpoint_equals_scan": f"{_LOG} SELECT count(*) AS differences FROM ((SELECT row_id, {_OWN} FROM v3 EXCEPT SELECT row_id, {_OWN} FROM vis WHERE snapshot_id = 4) UNION ALL (SELECT row_id, {_OWN} FROM vis WHERE snapshot_id = 4 EXCEPT SELECT row_id, {_OWN} FROM v3))",
    "verify_report": f"{_LOG} SELECT s.snapshot_id::BIGINT AS snapshot_id, (SELECT count(*) FROM log l WHERE l.snapshot_id = s.snapshot_id) AS records, (SELECT count(*) - count(DISTINCT row_id) FROM log l WHERE l.snapshot_id = s.snapshot_id) AS repeated, CASE WHEN s.parent = 0 THEN 0 ELSE (SELECT count(*) FROM log l LEFT JOIN vis v ON v.row_id = l.row_id AND v.snapshot_id = s.parent WHERE l.snapshot_id = s.snapshot_id AND (l.change_type = 1) = (v.row_id IS NOT NULL)) END::BIGINT AS broken FROM snaps s",
    "stats": f"{_LOG} SELECT (SELECT count(*) FROM snaps) AS snapshots, 2::BIGINT AS tables, (SELECT sum(ceil(n / {BLOCK_ROWS}.0))::BIGINT FROM made) AS blocks, (SELECT count(*) FROM log) AS changes, (SELECT count(*) FROM vis WHERE snapshot_id = 6) AS visible_rows",
    "agg_by_status_as_of": f"{_LOG} SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM v3 GROUP BY 1",
    "join_customer_as_of": f"{_LOG} SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM v3 JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "topk_as_of": f"{_LOG} SELECT row_id, o_totalprice FROM v3 ORDER BY o_totalprice DESC, row_id LIMIT 10",
    "window_rank_as_of": f"{_LOG} SELECT row_id, o_custkey, o_totalprice, rank::INT AS rank FROM (SELECT row_id, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, row_id) AS rank FROM v3) WHERE rank <= 2",
    "snapshot_diff": f"{_LOG}, a AS (SELECT * FROM vis WHERE snapshot_id = 2), b AS (SELECT * FROM vis WHERE snapshot_id = 5) SELECT CASE WHEN a.row_id IS NULL THEN 'insert' WHEN b.row_id IS NULL THEN 'delete' ELSE 'update' END AS change, count(*) AS n FROM a FULL JOIN b ON a.row_id = b.row_id WHERE a.row_id IS NULL OR b.row_id IS NULL OR a.o_totalprice <> b.o_totalprice GROUP BY 1",
    "key_range": f"{_LOG} SELECT row_id, o_custkey, o_totalprice FROM v3 WHERE (o_custkey > 3 OR o_custkey = 3 AND row_id >= 400) AND (o_custkey < 9 OR o_custkey = 9 AND row_id < 100)",
    "predicate_above_resolution": f"{_LOG} SELECT row_id, o_totalprice FROM v3 WHERE o_totalprice < 150000",
}
