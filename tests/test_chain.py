import duckdb
import pytest

from tidemark.operators import resolve
from tidemark.plans import chain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 4) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(chain.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = chain.QUERIES[name](spark, SF)
    want = duck.sql(chain.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_stats_counts_blocks_without_rows(spark, duck, tmp_path):
    duck.sql(f"COPY (SELECT * REPLACE (o_orderkey + i * 1000000 AS o_orderkey) FROM '{SF}/orders.parquet', range(3) r(i)) TO '{tmp_path}/orders.parquet'")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert len(chain.store(spark, str(tmp_path)).blocks(1, "orders")) < 5  # 4,050 rows
    for name in ("stats", "blocks_directory", "list_snapshots"):
        got, want = chain.QUERIES[name](spark, str(tmp_path)), c.sql(chain.ORACLES[name])
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["logical_row_count", "verify_report"])
def test_counts_deal_rows_before_they_aggregate(spark, duck, name, monkeypatch):
    """No task keeps a table of the rows of its whole input split, once for each snapshot: a task has TASK_ROWS records."""
    monkeypatch.setattr(resolve, "TASK_ROWS", 500)
    got = chain.QUERIES[name](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_NUM") :]
    assert "hashpartitioning(row_id" in plan and "Aggregate" not in below
    assert rows(got.columns, got.collect()) == rows(got.columns, duck.sql(chain.ORACLES[name]).project(", ".join(got.columns)).fetchall())


def test_histories_of_repeated_records_and_branches(spark):
    log = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 2, 3), (3, 3, 1), (3, 2, 1)], "row_id long, snapshot_id long, change_type int")
    got = {(tuple(r.history), r.n) for r in resolve.histories(log.unionByName(log.withColumn("row_id", log.row_id + 3)), 12).collect()}
    assert got == {((5, 5), 2), ((5, 11), 2), ((9, 13), 2)}


@pytest.mark.parametrize("name", ["snapshot_diff", "checkpoint_equals_scan"])
def test_diff_deals_each_record_once(spark, name, monkeypatch):
    """One shuffle of the layers and no join, whichever layers two snapshots share."""
    monkeypatch.setattr(resolve, "TASK_ROWS", 500)
    plan = chain.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(row_id") == 1 and plan.count("Scan parquet") == 1


def test_compared_agrees_with_diff(spark):
    """Every pair of chains; rows deleted, made again, changed to null and back, in one layer only, or in none."""
    log = spark.createDataFrame(
        [(1, 1, 1, "x"), (2, 1, 1, "x"), (2, 2, 3, None), (3, 1, 1, None), (3, 2, 2, "y"), (3, 3, 2, None), (4, 1, 1, "x"), (4, 2, 3, None), (4, 3, 1, "x"), (5, 2, 1, "x"), (5, 4, 1, "z"), (6, 4, 1, None), (7, 4, 3, None), (8, 3, 1, "x")],
        "row_id long, snapshot_id long, change_type int, v string",
    )
    chains = [[1], [2, 1], [3, 2, 1], [4, 1], [4]]
    for a in chains:
        for b in chains:
            want = resolve.diff(resolve.visible(log, a), resolve.visible(log, b))
            assert sorted(map(tuple, resolve.compared(log, a, b, ["v"], 14).collect())) == sorted(map(tuple, want.collect()))
