"""Streaming variants, beyond the batch operators: stateless steps, sessions by a fixed gap, windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.model import STEPS

#: Recipe steps that look at one row at a time, and so hold on a stream as they are.
STATELESS = {"add_to_points", "subtract_from_points", "multiply_points_by", "divide_points_by", "log_transform_points", "rotate_points", "translate_points", "crop_points", "get_track"}


def apply_stateless(stream: DataFrame, name: str, **parameters) -> DataFrame:
    if name not in STATELESS:
        raise ValueError(f"{name!r} needs more than one row at a time")
    return STEPS[name][1](stream, **parameters)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", by: str = "track") -> DataFrame:
    """(track, start, end, n, mean): readings without a gap; late ones are waited for until the watermark."""
    s = stream.withWatermark(time, late).groupBy(F.col(by), F.session_window(time, gap)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return s.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")


def window_stats(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: str = "track") -> DataFrame:
    """(track, start, end, n, min, max, mean, stdev) over tumbling or sliding windows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(F.col(by), w.alias("w"))
    s = g.agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "min", "max", "mean", "stdev")
