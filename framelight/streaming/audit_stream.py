"""Keeps the master table up to date with audit rows that arrive as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from framelight.sinks.master import upsert_master
from framelight.sinks.versions import Conflict, Versions


def upsert_stream(rows: DataFrame, root: str, checkpoint: str, mode: str = "replace_page", stream: str = "master", attempts: int = 5) -> StreamingQuery:
    """Every batch commits a version of the master table under root (sinks.versions) in which only the buckets of its pages are new. A version notes the last batch
    of each ``stream``, so a batch that runs again after a failure counts once; where another writer commits first, the batch starts again from its version."""

    def step(batch: DataFrame, number: int) -> None:
        store = Versions(batch.sparkSession, root)
        for attempt in range(attempts):
            with store.change() as change:
                if change.notes.get(stream, -1) >= number:
                    return
                upsert_master(change, batch, mode)
                change.notes[stream] = number
                try:
                    change.commit()
                    return
                except Conflict:
                    if attempt == attempts - 1:
                        raise

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
