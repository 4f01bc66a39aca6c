"""Training on a stream: each micro-batch is one training batch against the last committed version of the parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.model import Network
from lodestone.sources.params import Store

Prepared = tuple[DataFrame, DataFrame, DataFrame]


def train_stream(stream: DataFrame, net: Network, prepare: Callable[[DataFrame], Prepared], store: Store, checkpoint: str, name: str = "network") -> StreamingQuery:
    """Starts a query that makes a step of each micro-batch; prepare gives its (x, targets, records).

    Parameters, step count and the micro-batch's number are one version. Each micro-batch first loads the last version, so a restart goes on
    from it, and one that is run again after its commit is told by its number and left out. Empty ones commit nothing and have no effect."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        if store.version(name) >= 0 and net.load(store, name).get("batch_id", -1) >= batch_id:
            return
        if rows.isEmpty():
            return
        x, targets, records = prepare(rows)
        loss = net.step(x, targets, records, records.count()).first()
        net.save(store, name, batch_id=batch_id, n=int(loss.n), loss=float(loss.loss))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
