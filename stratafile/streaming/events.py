"""A stream of file events with late data: of each file the newest event counts, whatever order they come in.

Events are (drive_id, path, event_time, deleted, ...columns of the file). State is kept for each file, the time of its newest event and whether that was a deletion; an event that isn't newer is dropped, so an older one
never overrides, and a deletion stays deleted when older events come after it. Of events of the same time a deletion wins, then the larger size, then the later text of the row. What passes is upserted or
marked as removed, a micro-batch at a time.

State of files that are there is kept, as it is what late events are compared with; that of deleted ones goes once the watermark has passed the deletion by `keep`: events later than that are dropped by the watermark itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import conform, struct
from ..store import Store, set_from, upsert_files

#: What an event has beside the columns of a file.
EVENT = "event_time timestamp, deleted boolean"


def schema() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct("files")) + f", {EVENT}"


def events(spark, path: str) -> DataFrame:
    """A stream of events from JSON lines that land in a folder."""
    return spark.readStream.schema(schema()).json(path)


def newest(rows: DataFrame, late: str = "7 days", keep_ms: int = 0) -> DataFrame:
    """The events that are newer than all events of their file before, in order; late: how far behind the newest an event may come."""
    names = [f.name for f in rows.schema]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        gone = state.get[1] if state.exists else False
        best = None
        for batch in batches:
            batch = batch.assign(_gone=batch["deleted"].fillna(False).astype(bool), _size=batch["size_bytes"].fillna(-1), _text=batch[[c for c in names if c not in ("event_time",)]].astype(str).agg("|".join, axis=1))
            top = batch.sort_values(["event_time", "_gone", "_size", "_text"]).iloc[[-1]]
            if best is None or tuple(top[["event_time", "_gone", "_size", "_text"]].iloc[0]) > tuple(best[["event_time", "_gone", "_size", "_text"]].iloc[0]):
                best = top
        if best is None:
            return
        at, dead = int(best["event_time"].iloc[0].value // 1000), bool(best["_gone"].iloc[0])
        if known is not None and (at < known or at == known and (gone or not dead)):
            return
        state.update((at, dead))
        if dead:
            state.setTimeoutTimestamp(max(at // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield best[names]

    watched = rows.where("event_time is not null and drive_id is not null and path is not null").withWatermark("event_time", late)
    return watched.groupBy("drive_id", "path").applyInPandasWithState(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), "at long, gone boolean", "append", GroupStateTimeout.EventTimeTimeout)


def applied(files: DataFrame, batch: DataFrame) -> DataFrame:
    """The files table after a micro-batch of newest events: one for each file."""
    out = upsert_files(files, conform(batch.where("not coalesce(deleted, false)"), "files"))
    # a file that was deleted and comes back is there again
    back = batch.where("not coalesce(deleted, false)").select("drive_id", "path", F.coalesce("status", F.lit("indexed")).alias("_status"))
    out = out.join(back, ["drive_id", "path"], "left").withColumn("status", F.when((F.col("status") == "source_removed") & F.col("_status").isNotNull(), F.col("_status")).otherwise(F.col("status"))).select(*files.columns)
    gone = out.join(batch.where("deleted").select("drive_id", "path"), ["drive_id", "path"], "left_semi").select("id", F.lit("source_removed").alias("status"))
    return set_from(out, gone)


def apply_events(rows: DataFrame, store: Store, checkpoint: str, late: str = "7 days", **trigger) -> StreamingQuery:
    """Applies a stream of events to the catalogue's files. A micro-batch that is run twice gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.update("files", lambda old: applied(old, batch))

    return newest(rows, late).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
