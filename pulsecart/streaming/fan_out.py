"""Several outputs from one stream, with one pass over each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from pulsecart.sinks.markers import Markers

Frames = dict[str, DataFrame]


def fan_out(
    spark: SparkSession,
    path: str,
    outputs: Mapping[str, Callable[[Frames, int], None]],
    derive: Callable[[DataFrame], Frames] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that hands one batch to all outputs in their order.

    ``derive`` names the frames that outputs share, such as the rows before and after a filter; without
    it there is one, ``rows``. Each is kept while the batch lasts, so none is computed twice. Kept rows may
    go to disk, and those of a lost executor are computed again from the batch.

    A marker below ``path`` records each output that is done with a batch. When a batch is repeated, after a
    crash between two outputs, only the outputs without a marker run. An output that failed between its
    last write and its marker runs again, so it must take a repeated batch, as a keyed table does. Outputs
    that change what ``derive`` reads come last: then a repeated batch derives the same frames.
    """
    done = Markers(spark, f"{path}/done")

    def sink(batch: DataFrame, batch_id: int) -> None:
        missing = [n for n in outputs if not done.has(f"{n}/{batch_id:012d}")]
        if not missing:
            return
        frames = derive(batch) if derive else {"rows": batch}
        for frame in frames.values():
            frame.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in missing:
                outputs[name](frames, batch_id)
                done.put(f"{name}/{batch_id:012d}")
        finally:
            for frame in frames.values():
                frame.unpersist()

    return sink
