"""Structured Streaming form of batch ingestion (A1 -> A2 -> A3).

Upload files (CSV with the raw-upload columns) land in ``in_dir``. Each
micro-batch goes to ``ledger.ingest_epoch`` through ``foreachBatch``: the stored
table remembers the last epoch of the stream, so a replayed micro-batch adds
nothing, and the rows of a batch that is spread over several files wait until
``quiet`` triggers pass without one, so it is judged whole. The stream's name is its
checkpoint location (a shared folder), whose epochs it counts. This
is the streaming counterpart of the bulk-upload endpoint; the reference
itself has no streaming operator.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..sources.ledger import close_stream, ingest_epoch


class IngestRun:
    """A started ingest query. A run over what is there (``once``) judges the batches
    that are still open when it has ended."""

    def __init__(self, query, finish=None):
        self.query, self._finish = query, finish

    def awaitTermination(self, timeout: float | None = None) -> bool:
        ended = self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination() or True
        if ended and self._finish:
            self._finish()
            self._finish = None
        return ended

    def stop(self) -> None:
        self.query.stop()

    def __getattr__(self, name: str):
        return getattr(self.query, name)


def start_ingest(
    spark: SparkSession,
    in_dir: str,
    table_path: str,
    checkpoint: str,
    as_of: dt.date | None = None,
    rejected_path: str | None = None,
    files_per_trigger: int = 100,
    once: bool = False,
    quiet: int = 1,
) -> IngestRun:
    """Start the ingest query. ``as_of`` defaults to the processing date of each micro-batch."""
    stream = (
        spark.readStream.schema(S.RAW_UPLOAD)
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(in_dir)
    )

    def _batch(df: DataFrame, epoch_id: int) -> None:
        ingest_epoch(df, table_path, as_of or dt.date.today(), checkpoint, epoch_id, quiet, rejected_path)

    w = stream.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    end = (lambda: close_stream(spark, table_path, as_of or dt.date.today(), checkpoint, rejected_path)) if once else None
    return IngestRun(w.start(), end)
