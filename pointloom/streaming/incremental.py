"""The mergeable aggregates kept up to date from a stream of splats: bounding box, bucket histogram, counters.

Minima, maxima, counts and sums merge in any order, so each is a streaming aggregation in update or complete mode; a batch scan of
the same rows gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointloom.operators.splats import bounding_box, finite, with_boxes


def running_box(splats: DataFrame) -> DataFrame:
    return bounding_box(finite(splats))


def running_histogram(splats: DataFrame, spacing: float, bucket: int) -> DataFrame:
    """Splats by the lower bucket of their boxes."""
    return with_boxes(finite(splats), None, spacing, bucket).groupBy("lo_x", "lo_y", "lo_z").agg(F.count("*").alias("n"))


def start(aggregated: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep a table in memory complete."""
    return aggregated.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
