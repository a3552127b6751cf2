"""Skew-safe building blocks for ordered sequences.

A plain ``Window.partitionBy(key).orderBy(t)`` puts all rows of one key into one task,
which fails when one object holds a large share of all reports. Here a key with very
many rows is cut into *chunks*, ranges of its order. Windows run per (key, chunk), so
ordinary keys pay nothing more than the plain window, and what must cross the border of
a chunk travels as one row per chunk. Results equal those of the plain window.

Chunks are also the slices in which arrays of a key are built: no row holds an unbounded
array, and a slice of a path begins with the vertex that ended the one before, so no leg
is lost between two.

What is broadcast: the keys with more than ``CHUNK_ROWS`` rows, at most rows /
``CHUNK_ROWS``, and their cuts, one value for each so many rows: 32 MB of times for 2e12
reports. All else is left to Spark's own choice of join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "chunk"
CHUNK_ROWS = 500_000
#: Rows drawn for each chunk to find its ends.
SAMPLES = 32


def _matches(key: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k) == F.col(prefix + k) for k in key]


def _cut_points(rows: DataFrame, key: Sequence[str], max_rows: int) -> DataFrame:
    """Large keys with the places (``_at``) that cut their rows into parts of about equal number.

    A count finds the large keys. Of their rows those are drawn whose hash says so, about
    ``SAMPLES`` for each part, and every so-manieth of these in order is a cut. Neither
    count nor draw depends on the order in which tasks end, so every branch of a plan and
    every retry sees the same cuts, wherever the rows crowd together.
    """
    large = (
        rows.groupBy(*key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > max_rows)
        .select(*[F.col(k).alias(f"_h_{k}") for k in key])
    )
    one_in = max(1, max_rows // SAMPLES)
    drawn = rows if one_in == 1 else rows.filter(F.pmod(F.xxhash64(*key, "_at"), F.lit(one_in)) == 0)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_at"))
    return (
        drawn.join(F.broadcast(large), _matches(key, "_h_"))
        .select(*key, "_at", place.alias("_place"))
        .filter(F.col("_place") % (max_rows // one_in) == 0)
        .groupBy(*[F.col(k).alias(f"_h_{k}") for k in key])
        .agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    )


def _passed(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are at or before ``value``, by halving."""

    def halve(between: Column, _: Column) -> Column:
        middle = F.floor((between["lo"] + between["hi"]) / 2).cast("int")
        below = F.coalesce((between["lo"] < between["hi"]) & (F.get(cuts, middle) <= value), F.lit(False))
        return F.struct(
            F.when(below, middle + 1).otherwise(between["lo"]).alias("lo"),
            F.when(below, between["hi"]).otherwise(middle).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.when(cuts.isNotNull(), F.aggregate(steps, start, halve, lambda between: between["lo"]))


def assign_chunks(
    df: DataFrame,
    key: Sequence[str],
    order: str | Sequence[str] = "t",
    max_rows: int | None = None,
    name: str = CHUNK,
) -> DataFrame:
    """Add ``name``: NULL for ordinary keys, for large ones a number from 0 that grows along ``order``.

    A key with more than ``max_rows`` rows is cut into chunks of about so many. Rows that
    are equal in ``order`` share a chunk. A frame that already has the column is returned
    unchanged.
    """
    if name in df.columns:
        return df
    order = [order] if isinstance(order, str) else list(order)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rows = df.withColumn("_at", place)
    cuts = _cut_points(rows.select(*key, "_at"), key, max_rows or CHUNK_ROWS)
    chunk = _passed(F.col("_cuts"), F.col("_at"))
    return rows.join(F.broadcast(cuts), _matches(key, "_h_"), "left").select(*df.columns, chunk.alias(name))


def _by_chunk(df: DataFrame, key: Sequence[str], aggregates: Sequence[Column], shown: Sequence[Column]) -> DataFrame:
    """One row per chunk of the large keys: ``aggregates`` of its rows, then ``shown``, which may look across chunks."""
    return (
        df.filter(F.col(CHUNK).isNotNull())
        .groupBy(*key, CHUNK)
        .agg(*aggregates)
        .select(*[F.col(k).alias(f"_e_{k}") for k in (*key, CHUNK)], *shown)
    )


def _with_chunk_rows(df: DataFrame, key: Sequence[str], chunk_rows: DataFrame) -> DataFrame:
    """``df`` with the columns of its chunk. It lies by (key, chunk) already, so nothing of it moves."""
    return df.join(chunk_rows, [*_matches(key, "_e_"), F.col(CHUNK) == F.col(f"_e_{CHUNK}")], "left")


def neighbours(
    df: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    time: str = "t",
    step: Callable[[Column, Column], Column] | None = None,
    total: str = "total",
    **chunking,
) -> DataFrame:
    """Add ``prev`` and ``next``: structs of ``time`` and ``fields`` of the rows beside.

    With ``step(prev, here)`` also adds ``total``, the running sum of the steps along
    the key, 0 at its first row. Times must be unique per key.

    One exchange and one sort of the data. One row for each chunk of a large key carries
    the instants beside it and the sum of the steps before it.
    """
    df = assign_chunks(df, key, time, **chunking)
    here = F.struct(F.col(time), *[F.col(f) for f in fields])
    inside = Window.partitionBy(*key, CHUNK).orderBy(time)
    across = Window.partitionBy(*key).orderBy(CHUNK)
    local = df.withColumns({"_prev": F.lag(here).over(inside), "_next": F.lead(here).over(inside)})
    ends = [F.min(here).alias("_first"), F.max(here).alias("_last")]
    before, after = F.lag("_last").over(across), F.lead("_first").over(across)
    shown = [before.alias("_before"), after.alias("_after")]
    added = []
    if step is None:
        chunks = _by_chunk(df, key, ends, shown)
    else:
        gain = F.coalesce(step(F.col("_prev"), here), F.lit(0.0))
        chunks = _by_chunk(local, key, [*ends, F.sum(gain).alias("_sum")], [*shown, "_first", "_sum"])
        front = F.coalesce(step(F.col("_before"), F.col("_first")), F.lit(0.0))
        earlier = Window.partitionBy(*[f"_e_{k}" for k in key]).orderBy(f"_e_{CHUNK}").rowsBetween(Window.unboundedPreceding, -1)
        base = front + F.coalesce(F.sum(F.col("_sum") + front).over(earlier), F.lit(0.0))
        chunks = chunks.select(*[f"_e_{k}" for k in (*key, CHUNK)], "_before", "_after", base.alias("_base"))
        local = local.withColumn("_local", F.sum(gain).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        added = [(F.col("_local") + F.coalesce("_base", F.lit(0.0))).alias(total)]
    return _with_chunk_rows(local, key, chunks).select(
        *df.columns,
        F.coalesce("_prev", "_before").alias("prev"),
        F.coalesce("_next", "_after").alias("next"),
        *added,
    )


def known_neighbours(
    df: DataFrame, key: Sequence[str], sequences: Mapping[str, Sequence[str]], time: str = "t", **chunking
) -> DataFrame:
    """Add ``prev_<name>`` and ``next_<name>`` for several sequences that share their rows.

    A sequence is the rows on which its fields are known; what lies between is passed
    over. All sequences share one exchange, one sort and one window.
    """
    df = assign_chunks(df, key, time, **chunking)
    inside = f"OVER (PARTITION BY {', '.join([*key, CHUNK])} ORDER BY {time})"
    across = f"OVER (PARTITION BY {', '.join(key)} ORDER BY {CHUNK})"
    here = {}
    for name, fields in sequences.items():
        known = F.lit(True)
        for f in fields:
            known = known & F.col(f).isNotNull()
        here[f"_here_{name}"] = F.when(known, F.struct(F.col(time), *[F.col(f) for f in fields]))
    rows = df.withColumns(here)
    beside = {}
    for name in sequences:
        beside[f"_prev_{name}"] = F.expr(f"lag(_here_{name}) IGNORE NULLS {inside}")
        beside[f"_next_{name}"] = F.expr(f"lead(_here_{name}) IGNORE NULLS {inside}")
    ends, shown = [], []
    for name in sequences:
        ends += [F.min(f"_here_{name}").alias(f"_first_{name}"), F.max(f"_here_{name}").alias(f"_last_{name}")]
        shown.append(F.expr(f"lag(_last_{name}) IGNORE NULLS {across}").alias(f"_before_{name}"))
        shown.append(F.expr(f"lead(_first_{name}) IGNORE NULLS {across}").alias(f"_after_{name}"))
    joined = _with_chunk_rows(rows.withColumns(beside), key, _by_chunk(rows, key, ends, shown))
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_prev_{n}", f"_before_{n}").alias(f"prev_{n}") for n in sequences],
        *[F.coalesce(f"_next_{n}", f"_after_{n}").alias(f"next_{n}") for n in sequences],
    )


def running_max_before(
    df: DataFrame,
    key: Sequence[str],
    time: str,
    value: str,
    name: str,
    ties: Sequence[str] = (),
    **chunking,
) -> DataFrame:
    """Add ``name``: the greatest ``value`` of the key's earlier rows, NULL at the first."""
    df = assign_chunks(df, key, time, **chunking)
    inside = Window.partitionBy(*key, CHUNK).orderBy(time, *ties)
    across = Window.partitionBy(*key).orderBy(CHUNK)
    top = F.max("_top").over(across.rowsBetween(Window.unboundedPreceding, -1))
    chunks = _by_chunk(df, key, [F.max(value).alias("_top")], [top.alias("_base")])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return _with_chunk_rows(df.withColumn("_local", F.max(value).over(earlier)), key, chunks).select(
        *[c for c in df.columns if c != CHUNK], F.greatest("_local", "_base").alias(name)
    )


def with_chunk(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns, and the chunk where the frame has one already."""
    extra = [CHUNK] if CHUNK in df.columns and CHUNK not in columns else []
    return df.select(*columns, *extra)


def collect_parts(
    df: DataFrame,
    key: Sequence[str],
    aggregates: Sequence[Column],
    order: str | Sequence[str],
    max_items: int | None = None,
) -> DataFrame:
    """``groupBy(key).agg(aggregates)`` in slices of ``order`` where a key has more than ``max_items`` rows.

    Adds ``part_no``, from 0 along the order, and ``first_item``, the number of the key's
    rows in earlier parts; both are 0 for ordinary keys.
    """
    tagged = assign_chunks(df, key, order, max_items)
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _by_chunk(tagged, key, [F.count("*").alias("_n")], [F.sum("_n").over(before).alias("_before")])
    packed = tagged.groupBy(*key, CHUNK).agg(*aggregates)
    return _with_chunk_rows(packed, key, offsets).select(
        *[c for c in packed.columns if c != CHUNK],
        F.coalesce(CHUNK, F.lit(0)).alias("part_no"),
        F.coalesce("_before", F.lit(0)).cast("int").alias("first_item"),
    )


def pack(
    df: DataFrame,
    key: Sequence[str],
    arrays: Mapping[str, Column],
    more: Sequence[Column] = (),
    order: str | Sequence[str] = "t",
    join_ends: bool | Column | Mapping[str, Column] = True,
    **chunking,
) -> DataFrame:
    """Ordered arrays of each key, in ``part`` slices of its order; an ordinary key is one row with part 0.

    ``arrays`` names structs that begin with what they are ordered by; rows on which one
    is NULL are left out of that array. ``more`` are further aggregates of each slice.

    With ``join_ends`` (or where it holds, as a condition on ``more``, of all arrays or by
    the array's name) an array of a later slice begins with the last item before it, and ``joined`` (a struct of the same names)
    is true: the first item then belongs to the slice before, and only the way from it to
    the next item to this one.
    """
    df = assign_chunks(df, key, order, **chunking)
    lists = [F.sort_array(F.collect_list(c)).alias(name) for name, c in arrays.items()]
    packed = df.groupBy(*key, CHUNK).agg(*lists, *more)
    part = F.coalesce(CHUNK, F.lit(0)).cast("long").alias("part")
    others = [c for c in packed.columns if c != CHUNK and c not in key and c not in arrays]
    if join_ends is False:
        return packed.select(*key, part, *arrays, *others)
    earlier = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.max(c).alias(f"_last_{name}") for name, c in arrays.items()]
    # The last item before a slice is the greatest so far, also where a slice has none.
    shown = [F.max(f"_last_{name}").over(earlier).alias(f"_before_{name}") for name in arrays]
    rows = _with_chunk_rows(packed, key, _by_chunk(df, key, ends, shown))
    goes_on = join_ends if isinstance(join_ends, Mapping) else dict.fromkeys(arrays, F.lit(True) if join_ends is True else join_ends)
    joint = {name: goes_on[name] & F.col(f"_before_{name}").isNotNull() & (F.size(name) > 0) for name in arrays}
    return rows.select(
        *key, part,
        *[F.when(joint[n], F.concat(F.array(f"_before_{n}"), F.col(n))).otherwise(F.col(n)).alias(n) for n in arrays],
        *others,
        F.struct(*[joint[n].alias(n) for n in arrays]).alias("joined"),
    )
