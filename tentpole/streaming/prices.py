"""Price history over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_prices(stream: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """First and last price of each key and window from (key, price, ts): ``key``, ``window_start``, ``first``, ``current``, ``n``.

    Rows later than ``late`` are not counted, so state is kept for no longer.
    Runs alike on a batch table.
    """
    timed = stream.withWatermark("ts", late) if stream.isStreaming else stream
    out = timed.where("price IS NOT NULL").groupBy("key", F.window("ts", width)).agg(F.min_by("price", "ts").alias("first"), F.max_by("price", "ts").alias("current"), F.count(F.lit(1)).alias("n"))
    return out.select("key", F.col("window.start").alias("window_start"), "first", "current", "n")
