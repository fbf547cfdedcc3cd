"""Status moves followed as a stream, with each key's status as the stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonearm.operators.moves import MIRROR, MOVE, judged

_COLUMNS = ["key", "seq", "before", "after", "path", "at", "reason"]


def judged_stream(events: DataFrame, legal: dict = MIRROR) -> DataFrame:
    """A stream of ``events(key, seq, status, path, at)`` with ``before`` and ``reason``, as :func:`tonearm.operators.moves.moves` tells for tables.

    The state is one word for each key. Events of a key are taken in the order of ``seq`` within a batch; one that comes in a later batch is later.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        rows = sorted((r for pdf in parts for r in zip(*(pdf[c].tolist() for c in ("key", "seq", "status", "path", "at")))), key=lambda r: (r[1], r[2] or ""))
        status = state.get[0] if state.exists else None
        out = list(judged(status, rows, legal))
        status = next((r[3] for r in reversed(out) if r[-1] == "moved"), status)
        if status is not None:
            state.update((status,))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"at": "datetime64[us]"})

    return events.groupBy("key").applyInPandasWithState(update, MOVE, "status string", "append", GroupStateTimeout.NoTimeout)


def follow_moves(spark: SparkSession, events: DataFrame, home: str, legal: dict = MIRROR) -> DataFrame:
    """Reads a stream to its end and returns all judged moves; a batch that is run again writes its own folder again."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/moves/batch={number}")

    judged_stream(events, legal).writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{MOVE}, batch int").parquet(f"{home}/moves").drop("batch")
