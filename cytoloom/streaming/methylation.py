"""Running methylation counts over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.methylation import MethylationOptions, site_counts


def running_sites(observations: DataFrame, options: MethylationOptions = MethylationOptions()) -> DataFrame:
    """Counts of each site so far; the same aggregation as in a batch, kept as state a site.

    Overlaps must have been collapsed where fragments are known (upstream, a fragment at a time), since
    which observation wins is only known when both are there.
    """
    return site_counts(observations, options)


def start(observations: DataFrame, sink, checkpoint: str, options: MethylationOptions = MethylationOptions(), **trigger) -> StreamingQuery:
    """Hand each batch of changed sites to ``sink(df, batch_id)``; ``checkpoint`` makes it resume."""
    rows = running_sites(observations, options)
    return rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
