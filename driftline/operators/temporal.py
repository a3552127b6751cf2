"""Temporal algebra over the long form ``(geom_id, t, x, y)``.

Every function takes all trajectories at once and is lazy. ``key`` names the columns
that identify a trajectory. Times are unique per trajectory (see ``dedup_reports``).
Intervals are closed at both ends. Instants may have a column ``interpolation``, the same
on all rows of a trajectory: Linear, Step or Discrete paths then go through one plan, each
by its own rules. Without the column, or where it is NULL, motion is linear.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import geojson_shape, interpolate, planar_distance, round_to, seconds_between
from driftline.functions.text import MS_TO_KNOTS, speed_status
from driftline.operators.sequence import CHUNK, neighbours, pack, with_chunk

KEY = ("geom_id",)
KIND = "interpolation"
POSITION = ("x", "y")

# Digits at which two values count as equal, or at which a result is given.
LENGTH_DIGITS = 6
SPEED_DIGITS = 9
ACCELERATION_DIGITS = 12


def _kind_columns(df: DataFrame) -> list[str]:
    return [KIND] if KIND in df.columns else []


def kind_of(df: DataFrame) -> Column:
    """Interpolation of each row."""
    return F.coalesce(KIND, F.lit("Linear")) if KIND in df.columns else F.lit("Linear")


def _points(instants: DataFrame, key: Sequence[str]) -> DataFrame:
    return with_chunk(instants, [*key, "t", "x", "y", *_kind_columns(instants)])


def _step_length(before: Column, here: Column) -> Column:
    return planar_distance(before["x"], before["y"], here["x"], here["y"])


def _off_line(fields: Sequence[str], prev: str = "prev", following: str = "next") -> Column:
    """The row is not where its neighbours' straight motion would put it."""
    share = F.try_divide(
        seconds_between(F.col(f"{prev}.t"), F.col("t")), seconds_between(F.col(f"{prev}.t"), F.col(f"{following}.t"))
    )
    off = F.lit(False)
    for f in fields:
        before, after = F.col(f"{prev}.{f}"), F.col(f"{following}.{f}")
        gap = F.abs(before + (after - before) * share - F.col(f))
        off = off | (gap > F.greatest(F.lit(1e-9), F.abs(F.col(f)) * 1e-12))
    return off


def is_turn(
    fields: Sequence[str], interpolation: str | Column = "Linear", prev: str = "prev", following: str = "next"
) -> Column:
    """The row stays after normalisation, by the structs of the rows before and after it."""
    ends = F.col(prev).isNull() | F.col(following).isNull()
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"{prev}.{f}") != F.col(f))
    linear = ends | _off_line(fields, prev, following)
    if isinstance(interpolation, str):
        return {"Discrete": F.lit(True), "Step": ends | changed}.get(interpolation, linear)
    return (
        F.when(interpolation == "Discrete", F.lit(True)).when(interpolation == "Step", ends | changed).otherwise(linear)
    )


def _turns(df: DataFrame, fields: Sequence[str] = POSITION) -> Column:
    return is_turn(fields, kind_of(df) if KIND in df.columns else "Linear")


def normalise(
    instants: DataFrame,
    key: Sequence[str] = KEY,
    fields: Sequence[str] = POSITION,
    interpolation: str | None = None,
    **chunking,
) -> DataFrame:
    """Drop instants that the interpolation gives back anyway; ends always stay.

    ``interpolation`` overrides that of the rows.
    """
    rows = neighbours(instants, key, fields, **chunking)
    turn = is_turn(fields, interpolation) if interpolation else _turns(instants, fields)
    return rows.filter(turn).select(*instants.columns)


def velocity_curve(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Speed per second of the normalised path: a step function that ends in its last value.

    Motion is straight and even between normalised instants, so the raw segment after
    an instant has the speed of the normalised one, and one look at the direct
    neighbours is enough. An instant stays when its speed differs from that before. Step
    and Discrete paths have no speed and give no rows.
    """
    return _speed_rows(instants, key, **chunking).select(*key, "t", "speed")


def _speed_rows(instants: DataFrame, key: Sequence[str], **chunking) -> DataFrame:
    moving = instants.filter(kind_of(instants) == "Linear") if KIND in instants.columns else instants
    rows = neighbours(_points(moving, key), key, POSITION, **chunking)
    here = F.struct("t", "x", "y")

    def speed(a: Column, b: Column) -> Column:
        return round_to(F.try_divide(_step_length(a, b), seconds_between(a["t"], b["t"])), SPEED_DIGITS)

    first, last = F.col("prev").isNull(), F.col("next").isNull()
    after, before = speed(here, F.col("next")), speed(F.col("prev"), here)
    changes = first | last | (_off_line(POSITION) & (before != after))
    return rows.filter(~(first & last) & changes).select(
        *key, CHUNK, "t", F.coalesce(after, before).alias("speed")
    )


def distance_curve(
    instants: DataFrame, key: Sequence[str] = KEY, digits: int = LENGTH_DIGITS, **chunking
) -> DataFrame:
    """Distance travelled up to each normalised instant; Step and Discrete paths travel none."""
    points = _points(instants, key)
    rows = neighbours(points, key, POSITION, step=_step_length, total="distance", **chunking)
    travelled = F.when(kind_of(points) == "Linear", F.col("distance")).otherwise(0.0)
    return rows.filter(_turns(points)).select(*key, "t", round_to(travelled, digits).alias("distance"))


def acceleration_curve(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Change of the speed curve per second, stamped at the later instant; 0 at the first."""
    speeds = neighbours(_speed_rows(instants, key, **chunking), key, ["speed"], **chunking)
    slope = F.try_divide(F.col("speed") - F.col("prev.speed"), seconds_between(F.col("prev.t"), F.col("t")))
    return speeds.select(
        *key, "t", round_to(F.coalesce(slope, F.lit(0.0)), ACCELERATION_DIGITS).alias("acceleration")
    )


def trip_length(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Length of each path; a single instant has length 0, and so has a Step or Discrete path."""
    points = _points(instants, key)
    rows = neighbours(points, key, POSITION, **chunking)
    step = F.coalesce(_step_length(F.struct("x", "y"), F.col("next")), F.lit(0.0))
    if KIND in points.columns:
        step = F.when(kind_of(points) == "Linear", step).otherwise(0.0)
    return rows.groupBy(*key).agg(F.sum(step).alias("length"))


def _time_mean(value: Column, following: Column, seconds: Column, linear: bool) -> Column:
    level = (value + following) / 2 if linear else value
    return F.coalesce(F.try_divide(F.sum(level * seconds), F.sum(seconds)), F.min(value))


def time_weighted_avg(
    instants: DataFrame,
    value: str = "v",
    key: Sequence[str] = KEY,
    interpolation: str = "Linear",
    **chunking,
) -> DataFrame:
    """Mean of a temporal number weighted by time; a lone instant gives its own value."""
    known = with_chunk(instants, [*key, "t", value]).filter(F.col(value).isNotNull())
    rows = neighbours(known, key, [value], **chunking)
    seconds = seconds_between(F.col("t"), F.col("next.t"))
    mean = _time_mean(F.col(value), F.col(f"next.{value}"), seconds, interpolation == "Linear")
    return rows.groupBy(*key).agg(mean.alias("twavg"))


def speed_agreement(
    instants: DataFrame, reported: str = "sog", key: Sequence[str] = KEY, **chunking
) -> DataFrame:
    """Time-weighted means of the reported and of the travelled speed, and the length.

    ``reported`` must be known on every row, as it is after ``domain_filter``; both
    means then share one pass. The mean of the travelled speed is length over time; it
    is NULL for a lone instant, which has no speed.
    """
    rows = neighbours(with_chunk(instants, [*key, "t", "x", "y", reported]), key, ["x", "y", reported], **chunking)
    seconds = seconds_between(F.col("t"), F.col("next.t"))
    step = _step_length(F.struct("x", "y"), F.col("next"))
    return rows.groupBy(*key).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("length"),
        _time_mean(F.col(reported), F.col(f"next.{reported}"), seconds, True).alias("twavg_reported"),
        F.try_divide(F.sum(step), F.sum(seconds)).alias("twavg_speed"),
    )


def extent(instants: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Box in space and time of each trajectory; partial sums before the exchange."""
    return instants.groupBy(*key).agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"),
        F.max("x").alias("xmax"), F.max("y").alias("ymax"),
        F.min("t").alias("tmin"), F.max("t").alias("tmax"),
        F.count("*").alias("n_instants"),
    )


def extent_or_given(given: DataFrame, computed: DataFrame, key: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Supplied box and lifespan where present, computed ones else."""
    names = ["xmin", "ymin", "xmax", "ymax", "tmin", "tmax"]
    box = [n for n in names if n[0] != "t"]
    has_box = F.col("given.xmin").isNotNull()
    has_time = F.col("given.tmin").isNotNull()
    return (
        given.alias("given")
        .join(computed.alias("computed"), list(key), "left")
        .select(
            *key,
            *[
                F.when(has_box if n in box else has_time, F.col(f"given.{n}"))
                .otherwise(F.col(f"computed.{n}"))
                .alias(n)
                for n in names
            ],
        )
    )


def subtrajectory(
    instants: DataFrame,
    start: datetime | str,
    end: datetime | str,
    key: Sequence[str] = KEY,
    interpolation: str | None = None,
) -> DataFrame:
    """Path within the closed interval, with interpolated ends; empty cuts give no rows.

    At a bound between two instants a Linear path has the place on the way, a Step path
    that of the instant before, and a Discrete path none. ``interpolation`` overrides that
    of the rows.

    No window and no sort of the instants: inner instants pass as they are, and the
    four instants around the two bounds come from one aggregate with partial sums.
    """
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    shown = [*key, "t", "x", "y", *_kind_columns(instants)]
    points = instants.select(*shown)
    inner = points.filter(F.col("t").between(a, b))
    if interpolation == "Discrete":
        return inner
    kind = F.lit(interpolation) if interpolation else F.coalesce(F.col("_kind"), F.lit("Linear"))
    here, t = F.struct("t", "x", "y"), F.col("t")
    around = points.groupBy(*key).agg(
        F.max(F.when(t < a, here)).alias("before_a"),
        F.min(F.when(t >= a, here)).alias("from_a"),
        F.max(F.when(t <= b, here)).alias("to_b"),
        F.min(F.when(t > b, here)).alias("after_b"),
        F.max(KIND if KIND in points.columns else F.lit(None).cast("string")).alias("_kind"),
    )

    def cut(left: str, right: str, at: Column) -> Column:
        """Position at ``at`` when it lies strictly between two instants."""
        between = F.col(left).isNotNull() & F.col(right).isNotNull()
        between = between & (F.col(f"{left}.t") < at) & (F.col(f"{right}.t") > at)
        stayed = F.struct(at.alias("t"), F.col(f"{left}.x").alias("x"), F.col(f"{left}.y").alias("y"))
        place = F.when(kind == "Step", stayed).otherwise(interpolate(F.col(left), F.col(right), at))
        return F.when(between & (kind != "Discrete"), place)

    bounds = F.array_distinct(F.array_compact(F.array(cut("before_a", "from_a", a), cut("to_b", "after_b", b))))
    ends = around.select(*key, F.col("_kind").alias(KIND), F.explode(bounds).alias("p")).select(*key, KIND, "p.t", "p.x", "p.y")
    return inner.unionByName(ends.select(*shown))


def leaf(instants: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Last instant of each trajectory, as a discrete one."""
    return (
        instants.groupBy(*key)
        .agg(F.max(F.struct("t", "x", "y")).alias("last"))
        .select(*key, "last.t", "last.x", "last.y", F.lit("Discrete").alias("interpolation"))
    )


def path_marks(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Instants with three flags from one pass: ``turn``, ``bend``, ``last``.

    ``turn``: stays after normalisation. ``bend``: is a vertex of the shape, a turn away
    from the position before it. ``last``: ends the trajectory.
    """
    points = _points(instants, key)
    rows = neighbours(points, key, POSITION, **chunking)
    turn = _turns(points)
    moved = F.col("prev").isNull() | (F.col("prev.x") != F.col("x")) | (F.col("prev.y") != F.col("y"))
    return rows.select(
        *key, CHUNK, "t", "x", "y", *_kind_columns(points),
        turn.alias("turn"), (turn & moved).alias("bend"), F.col("next").isNull().alias("last"),
    )


def shape_points(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Vertices of the path: normalised instants that do not repeat the position before."""
    return path_marks(instants, key, **chunking).filter("bend").select(*key, "t", "x", "y")


def _most_kind(df: DataFrame) -> list[Column]:
    return [F.max(KIND).alias(KIND)] if KIND in df.columns else []


def trajectory_shape(instants: DataFrame, key: Sequence[str] = KEY, discrete: bool = False, **chunking) -> DataFrame:
    """GeoJSON of each path: a line for Linear ones, a MultiPoint for Step and Discrete ones, or a Point.

    A very long path comes in ``part`` slices of time. A later slice of a line begins with
    the vertex that ended the one before (``joined``), so the slices together are the
    whole line.
    """
    if discrete:
        instants = instants.withColumn(KIND, F.lit("Discrete"))
    marks = path_marks(instants, key, **chunking).filter("bend")
    packed = pack(marks, key, {"points": F.struct("t", "x", "y")}, _most_kind(marks), join_ends=kind_of(marks) == "Linear", **chunking)
    geometry = geojson_shape(F.col("points"), kind_of(packed) != "Linear")
    return packed.select(*key, "part", F.size("points").alias("n_points"), F.col("joined.points").alias("joined"), geometry.alias("geometry"))


def feature_line(instants: DataFrame, feature: str = "feature_id", key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """One line per feature: the shapes of its trajectories one after another.

    Very large features come in ``part`` slices along that order, joined like those of a path.
    """
    points = path_marks(_points(instants, [feature, *key]), [feature, *key], **chunking).filter("bend").drop(CHUNK)
    packed = pack(points, [feature], {"points": F.struct(*key, "t", "x", "y")}, order=[*key, "t"], **chunking)
    return packed.select(
        feature, "part", F.size("points").alias("n_points"), F.col("joined.points").alias("joined"),
        geojson_shape(F.col("points")).alias("geometry"),
    )


def speed_summary(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Greatest and least speed in m/s and knots."""
    agg = velocity_curve(instants, key, **chunking).groupBy(*key).agg(
        F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed")
    )
    return agg.select(
        *key, "max_speed", "min_speed",
        (F.col("max_speed") * MS_TO_KNOTS).alias("max_knots"),
        (F.col("min_speed") * MS_TO_KNOTS).alias("min_knots"),
    )


def speed_states(instants: DataFrame, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Speed curve with the status of each value."""
    return velocity_curve(instants, key, **chunking).withColumn("status", speed_status(F.col("speed")))


def speed_violations(instants: DataFrame, limit: float, key: Sequence[str] = KEY, **chunking) -> DataFrame:
    """Per trajectory: number of speed values over ``limit``, the first such time and the peak."""
    over = F.col("speed") > F.lit(limit)
    return velocity_curve(instants, key, **chunking).groupBy(*key).agg(
        F.coalesce(F.bool_or(over), F.lit(False)).alias("violates"),
        F.count_if(over).alias("n_over"),
        F.min(F.when(over, F.col("t"))).alias("first_over"),
        F.max("speed").alias("max_speed"),
    )


def unpack_instants(packed: DataFrame, key: Sequence[str] = KEY, column: str = "instants") -> DataFrame:
    """Long form of packed ``array<struct<t,x,y>>`` rows; an instant that two slices share comes once."""
    points = F.col(column)
    if "joined" in packed.columns:
        points = F.when(F.col(f"joined.{column}"), F.slice(points, F.lit(2), F.size(points))).otherwise(points)
    return packed.select(*key, F.inline(points))


def pack_instants(instants: DataFrame, key: Sequence[str] = KEY, join_ends: bool = True, **chunking) -> DataFrame:
    """Ordered arrays of instants, in ``part`` slices of time where a path is very long.

    A later slice of a Linear or Step path begins with the last instant before it.
    """
    points = _points(instants, key)
    goes_on = kind_of(points) != "Discrete" if join_ends else False
    return pack(points, key, {"instants": F.struct("t", "x", "y")}, _most_kind(points), join_ends=goes_on, **chunking)
