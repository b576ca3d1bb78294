"""A micro-batch sink: each batch becomes one DELTA snapshot, once. And the change log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import LATEST, Store
from ..types import Column, spark_schema


def delta_sink(store: Store, address: str, query: str):
    """For foreachBatch: rows are changes as Tx.apply takes them. The query and its batch's number lie in a field of the commit,
    apart from users' blobs, so a batch that is sent again is known whatever other commits came between."""

    def write(batch: DataFrame, number: int) -> None:
        if store.catalog.batch(query) >= number:
            return
        tx = store.begin(LATEST)
        try:
            tx.apply(address, batch)
            tx.sink = {"query": query, "batch": number}
            tx.commit()
        except Exception:
            if tx.state == "open":
                tx.rollback()
            raise

    return write


def change_stream(store: Store, address: str, snapshot: int = LATEST) -> DataFrame:
    """The changes of one table, as a stream that goes on with each commit: row_id, change_type, the table's columns, block_id,
    item_ordinal and snapshot_id. Only whole data files count, which a commit's folder gets by rename; a commit that is never
    made leaves none once a writer opens the store again."""
    view = store.catalog
    table = view.table(view.latest if snapshot == LATEST else snapshot, address)
    schema = spark_schema([Column(**c) for c in table["columns"]]).add("row_id", "long").add("change_type", "integer").add("block_id", "long").add("item_ordinal", "long").add("snapshot_id", "long")
    return store.spark.readStream.schema(schema).parquet(f"{store.path.rstrip('/')}/log/*/{table['id']}/data")
