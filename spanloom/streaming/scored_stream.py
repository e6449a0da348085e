"""Word predictions over a stream of scored windows: stateless, so a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.scoring import merged_over_windows


def merge_stream(scores: DataFrame, n_labels: int, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch of window scores; all windows of a text must arrive in one batch.

    Batches are written under their number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        merged_over_windows(batch, n_labels).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
