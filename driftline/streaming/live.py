"""Streams of reports and value batches under the rules of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.functions.text import speed_status
from driftline.operators.validate import accepted, validate_values

MOTION_STATE = "t long, x double, y double, distance double"
MOTION_ROW = "key long, t timestamp, x double, y double, speed double, distance double, late boolean"
BATCH_ROW = (
    "value_id long, property_id long, datetimes array<timestamp>, values array<string>, "
    "interpolation string, taken boolean, last_time timestamp"
)


def dedup_stream(reports: DataFrame, delay: str = "10 minutes", key: str = "mmsi", time: str = "t") -> DataFrame:
    """First report of each (ship, time) to arrive within the watermark.

    The batch rule picks one copy by value; on a stream the first one wins, and copies
    that come later than ``delay`` are not recognised.
    """
    return reports.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, time])


def _micros(times: pd.Series) -> np.ndarray:
    stamps = pd.to_datetime(times)
    if stamps.dt.tz is not None:
        stamps = stamps.dt.tz_convert("UTC").dt.tz_localize(None)
    return stamps.to_numpy(dtype="datetime64[us]").astype("int64")


def _follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Motion of one object from its last known point; arrays, no loop over rows."""
    rows = pd.concat(list(chunks), ignore_index=True)
    us = _micros(rows["t"])
    order = np.argsort(us, kind="stable")
    rows, us = rows.iloc[order].reset_index(drop=True), us[order]
    last, x0, y0, total = state.get if state.exists else (None, np.nan, np.nan, 0.0)
    # A report no later than the one before it is late.
    before = np.concatenate([[np.iinfo("int64").min if last is None else last], us[:-1]])
    late = us <= np.maximum.accumulate(before)
    good = ~late
    x, y = rows["x"].to_numpy("float64")[good], rows["y"].to_numpy("float64")[good]
    t = us[good]
    step = np.hypot(np.diff(x, prepend=x0), np.diff(y, prepend=y0))
    seconds = np.diff(t, prepend=t[:1] if last is None else [last]) / 1e6
    known = ~np.isnan(step)
    distance = total + np.cumsum(np.where(known, step, 0.0))
    speed = np.full(len(t), np.nan)
    np.divide(step, seconds, out=speed, where=known & (seconds > 0))
    out = rows.assign(key=key[0], speed=np.nan, distance=np.nan, late=late)
    out.loc[good, "speed"] = speed
    out.loc[good, "distance"] = distance
    if len(t):
        state.update((int(t[-1]), float(x[-1]), float(y[-1]), float(distance[-1])))
    yield out[["key", "t", "x", "y", "speed", "distance", "late"]]


def live_motion(reports: DataFrame, key: str = "mmsi") -> DataFrame:
    """Speed since the last report, distance so far and status of every object.

    Input ``key, t, x, y``. Reports of a micro-batch are put in time order; one that is
    not later than the object's last is flagged ``late`` and changes nothing.
    """
    rows = reports.select(F.col(key).cast("long").alias("key"), "t", "x", "y")
    motion = rows.groupBy("key").applyInPandasWithState(
        _follow, MOTION_ROW, MOTION_STATE, "append", GroupStateTimeout.NoTimeout
    )
    clean = motion.withColumns({c: F.nullif(c, F.lit(float("nan"))) for c in ("speed", "distance")})
    status = F.when(F.col("speed").isNotNull(), speed_status(F.col("speed")))
    return clean.withColumn("status", status).withColumnRenamed("key", key)


def _continue(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take the batches of one property that start after everything before them."""
    rows = pd.concat(list(chunks), ignore_index=True)
    start, end = _micros(rows["start"]), _micros(rows["end"])
    order = np.lexsort((rows["value_id"].to_numpy(), start))
    rows, start, end = rows.iloc[order].reset_index(drop=True), start[order], end[order]
    none = np.iinfo("int64").min
    last = state.get[0] if state.exists else none
    before, taken = np.empty(len(rows), "int64"), np.zeros(len(rows), bool)
    for i, (s, e) in enumerate(zip(start, end)):
        before[i], taken[i] = last, s > last
        last = max(last, e) if taken[i] else last
    known = before != none
    last_time = pd.Series(np.where(known, before, 0).astype("datetime64[us]")).where(known)
    if taken.any():
        state.update((int(last),))
    yield rows.assign(taken=taken, last_time=last_time)[
        ["value_id", "property_id", "datetimes", "values", "interpolation", "taken", "last_time"]
    ]


def continuous_batches(batches: DataFrame) -> DataFrame:
    """Well-formed value batches with ``taken`` by the continuity rule of ``append_values``."""
    rows = accepted(validate_values(batches)).select(
        "value_id", "property_id", "datetimes", "values", "interpolation",
        F.try_element_at("datetimes", F.lit(1)).alias("start"),
        F.try_element_at("datetimes", F.lit(-1)).alias("end"),
    )
    return rows.groupBy("property_id").applyInPandasWithState(
        _continue, BATCH_ROW, "last long", "append", GroupStateTimeout.NoTimeout
    )
