"""Checks of incoming documents as columns of error texts, and of query arguments."""

from __future__ import annotations

import datetime as dt
from math import isfinite
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import Envelope, envelope
from driftline.functions.text import INTERPOLATIONS, ITEM_TYPE, PROPERTY_TYPES, slug

# Page sizes, and below the error texts of the interface.
MAX_PAGE = 10_000
DEFAULT_PAGE = 10


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))


def validate_collections(docs: DataFrame, replace: bool = False) -> DataFrame:
    """Add ``errors``, ``id`` and the default ``itemType``; documents as in the schema.

    On replace no title is needed, no id is made, and an update frequency is ignored.
    """
    bad_type = F.col("itemType").isNotNull() & (F.col("itemType") != ITEM_TYPE)
    rules = [(bad_type, "itemType must be 'movingfeature'")]
    if replace:
        return docs.withColumn("errors", _errors(*rules)).withColumn("updateFrequency", F.lit(None).cast("int"))
    rules.insert(0, (F.col("title").isNull(), "Missing required field: title"))
    return docs.withColumns(
        {
            "errors": _errors(*rules),
            "id": slug(F.col("title")),
            "itemType": F.coalesce("itemType", F.lit(ITEM_TYPE)),
        }
    )


def validate_properties(docs: DataFrame) -> DataFrame:
    known = F.col("type").isin(*PROPERTY_TYPES)
    return docs.withColumn(
        "errors",
        _errors(
            (F.col("name").isNull(), "Missing required field: name"),
            (F.col("type").isNull(), "Missing required field: type"),
            (F.col("type").isNotNull() & ~known, "Invalid property type"),
        ),
    )


def validate_values(docs: DataFrame) -> DataFrame:
    """Value batches; an empty list of times is an error too."""
    times, values, kind = F.col("datetimes"), F.col("values"), F.col("interpolation")
    return docs.withColumn(
        "errors",
        _errors(
            (times.isNull(), "Missing required field: datetimes"),
            (values.isNull(), "Missing required field: values"),
            (times.isNotNull() & values.isNotNull() & (F.size(times) != F.size(values)),
             "datetimes and values must have the same length"),
            (times.isNotNull() & (F.size(times) == 0), "datetimes must not be empty"),
            (kind.isNotNull() & ~kind.isin(*INTERPOLATIONS), "Invalid interpolation"),
        ),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def _moment(text: str) -> dt.datetime:
    """The time that a text names, in UTC where it has no zone."""
    try:
        found = dt.datetime.fromisoformat(text)
    except ValueError:
        raise ValueError("Invalid datetime parameter") from None
    return found if found.tzinfo else found.replace(tzinfo=dt.timezone.utc)


class ItemQuery(NamedTuple):
    """Checked arguments of an items query; ``start``/``end`` are None where open."""

    limit: int | None
    box: Envelope | None
    timed: bool
    start: str | None
    end: str | None
    sub_trajectory: bool
    leaf: bool


def item_query(
    limit: int | str | None = DEFAULT_PAGE,
    bbox: str | None = None,
    datetime: str | None = None,
    sub_trajectory: bool = False,
    leaf: bool = False,
) -> ItemQuery:
    """Check the arguments before any plan is built; raises ``ValueError``.

    A limit beyond ``MAX_PAGE`` is refused, not lowered; None asks for all features.
    """
    rows = None
    if limit is not None:
        try:
            rows = int(limit)
        except (TypeError, ValueError):
            raise ValueError("Invalid limit parameter") from None
        if not 0 <= rows <= MAX_PAGE:
            raise ValueError("Invalid limit parameter")
    if sub_trajectory and leaf:
        raise ValueError("subTrajectory cannot be used with leaf")
    box = None
    if bbox:
        try:
            numbers = [float(part) for part in bbox.split(",")]
        except ValueError:
            raise ValueError("Invalid bbox coordinates") from None
        if len(numbers) != 4 or not all(map(isfinite, numbers)):
            raise ValueError("Invalid bbox format - must be 4 numbers")
        box = envelope(*numbers)
    start = end = None
    bounded = False
    if datetime:
        parts = [p.strip() for p in datetime.split("/")]
        if len(parts) > 2:
            raise ValueError("Invalid datetime parameter")
        if len(parts) == 1:
            start = end = parts[0]
        else:
            start, end = (None if p in ("", "..") else p for p in parts)
            bounded = start is not None and end is not None
        times = [_moment(t) for t in (start, end) if t is not None]
        if times != sorted(times):
            raise ValueError("Invalid datetime parameter")
    if sub_trajectory and not bounded:
        raise ValueError("subTrajectory requires a bounded datetime interval")
    return ItemQuery(rows, box, start is not None or end is not None, start, end, sub_trajectory, leaf)
