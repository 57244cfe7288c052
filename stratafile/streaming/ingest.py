"""A stream of file rows into the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..schema import conform, struct
from ..store import Store


def file_rows(spark, path: str) -> DataFrame:
    """A stream of file rows from JSON lines that land in a folder."""
    return spark.readStream.schema(struct("files")).json(path)


def upsert_stream(rows: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts each micro-batch. A batch that is run twice gives the same table, as files are known by drive and path."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_files(conform(batch, "files"))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
