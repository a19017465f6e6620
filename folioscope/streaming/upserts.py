"""Streams that keep one row a key in a snapshot table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.chunks import upsert
from ..session import cut
from ..sources.versions import Versions

#: Snapshots that stay: the current one, and the one before it for readers that have just begun.
KEPT = 2


def merge_batch(table: Versions, key: list[str], order: list[str], last: bool = True) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: the batch merged into the newest snapshot and committed as the snapshot of its batch id.

    A batch that was committed is skipped when it is replayed; one that was not is merged into the snapshot before it, so its
    rows count once. ``last``: new rows replace old ones of their key; otherwise they only fill in. Within a batch the last row (filling
    in: the first) by ``order`` counts.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        done = [n for n in table.complete() if n < batch_id + 1]
        if batch_id + 1 in table.complete() or any(n > batch_id + 1 for n in table.complete()):
            return
        old = table.read(done[-1]) if done else table.read()
        table.write(cut(upsert(old, batch.select(*table.schema.names), key, last=last, order=order)), batch_id + 1)
        for n in done[: 1 - KEPT]:
            table.drop(n)

    return merge


def run_upserts(stream: DataFrame, table: Versions, key: list[str], order: list[str], state: str, last: bool = True) -> DataFrame:
    """Merge a stream into ``table`` until its source is drained; the snapshot. ``state`` is the stream's checkpoint folder."""
    query = stream.writeStream.foreachBatch(merge_batch(table, key, order, last)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    done = table.complete()
    return table.read(done[-1]) if done else table.read()
