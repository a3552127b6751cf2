"""Join of many trajectories with many rectangular regions through a grid.

Boxes are laid on a ladder of grids whose cells grow by a factor of 16. A box sits on
the first grid with cells at least as large as itself, so it covers at most four
cells there. A pair of boxes can only meet in a cell of the coarser of their two
grids, so each side is listed on its own grid and on the coarser ones: a fixed
number of rows per box. The last grid is one cell, so that holds however large a box is.
``box_pairs`` is an equi-join on the cell.

Visits of regions use the cells of the same ladder as tiles. Paths and boxes are dealt by tile, and meet
inside tasks (``contacts``): their pairs are many more than either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from driftline.functions.geo import envelope_columns
from driftline.operators import contacts
from driftline.operators.sequence import CHUNK, neighbours, with_chunk
from driftline.operators.temporal import KEY, POSITION
from driftline.session import cut_lineage

# Workers need not find this package.
cloudpickle.register_pickle_by_value(contacts)

LEVELS = 8
FACTOR = 16.0
EXTENT = ("xmin", "ymin", "xmax", "ymax")

#: Segments and boxes that meet in one group of a tile, boxes in one row of it, regions that share one row of a box.
SEGMENTS, BOXES, PACK, SHARED = 1 << 15, 1 << 16, 1 << 12, 1 << 10
#: Tasks for each core, as groups are unlike in work.
TASKS = 8
TILE = ("_grid", "_own", "_tx", "_ty")
GROUP = (*TILE, "_block", "_part")


def _own_level(finest: float) -> Column:
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    own: Column = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        own = F.when(size <= F.lit(finest * FACTOR**i), F.lit(i)).otherwise(own)
    return own


def _cell(value: Column, grid: Column, finest: float) -> Column:
    """Number of the cell of a grid that holds the value, along one axis."""
    width = F.lit(finest) * F.pow(F.lit(FACTOR), grid)
    return F.when(grid < LEVELS - 1, F.floor(value / width)).otherwise(F.lit(0).cast("long"))


def _cells(boxes: DataFrame, finest: float, met: Column | None = None) -> DataFrame:
    """Add ``level`` (own grid) and one row per covered ``(grid, cx, cy)``.

    ``met`` names the coarser grids worth listing; all of them without it.
    """
    grids = F.sequence(F.col("level"), F.lit(LEVELS - 1))
    listed = boxes.withColumn("level", _own_level(finest))
    if met is not None:
        listed = listed.withColumn("_met", met)
        grids = F.filter(grids, lambda g: (g == F.col("level")) | F.array_contains(F.col("_met"), g))
    listed = listed.withColumn("grid", F.explode(grids))
    for axis in ("x", "y"):
        low, high = (_cell(F.col(f"{axis}{end}"), F.col("grid"), finest) for end in ("min", "max"))
        listed = listed.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    return listed


def box_pairs(left: DataFrame, right: DataFrame, finest: float) -> DataFrame:
    """Pairs of overlapping boxes; columns of both sides, extents as ``l_*`` and ``r_*``.

    A pair is met on the coarser grid only, in the cell that holds the lower left
    corner of the overlap, so it comes out once and needs no distinct. The last grid
    takes everything larger than the one before it can hold; in metres that exceeds any map of the earth. The left
    side, the larger one, skips grids on which the right side has no box of its own.
    """
    extent = ("xmin", "ymin", "xmax", "ymax")
    in_use = right.agg(F.collect_set(_own_level(finest))).scalar()

    def side(boxes: DataFrame, prefix: str, met: Column | None) -> DataFrame:
        cells = _cells(boxes, finest, met)
        return cells.select(
            *[F.col(c) for c in boxes.columns if c not in extent],
            *[F.col(c).alias(f"{prefix}_{c}") for c in (*extent, "level", "grid", "cx", "cy")],
        )

    lo_x, lo_y = F.greatest("l_xmin", "r_xmin"), F.greatest("l_ymin", "r_ymin")
    met = side(left, "l", in_use).join(
        side(right, "r", None),
        [F.col(f"l_{c}") == F.col(f"r_{c}") for c in ("grid", "cx", "cy")]
        + [
            F.col("l_grid") == F.greatest("l_level", "r_level"),
            F.col("l_xmin") <= F.col("r_xmax"),
            F.col("l_xmax") >= F.col("r_xmin"),
            F.col("l_ymin") <= F.col("r_ymax"),
            F.col("l_ymax") >= F.col("r_ymin"),
            _cell(lo_x, F.col("l_grid"), finest) == F.col("l_cx"),
            _cell(lo_y, F.col("l_grid"), finest) == F.col("l_cy"),
        ],
    )
    return met.drop(*[f"{p}_{c}" for p in "lr" for c in ("level", "grid", "cx", "cy")])


def _distinct_boxes(regions: DataFrame, finest: float) -> DataFrame:
    """One row for each box with the regions that have just this one (``ids``); a region of several boxes has a row for each.

    A box of very many regions has a row for about ``SHARED`` of them. The extent is in order, ``sides`` as given;
    ``_from`` is the finest grid of tiles on which the box is met, the next above its own.
    """
    same = Window.partitionBy(*EXTENT, "alone")
    shared = Window.partitionBy(*EXTENT, "alone", "_share")
    alone = (F.count("*").over(Window.partitionBy("region_id")) == 1) & F.col("region_id").isNotNull()
    return (
        regions.withColumn("alone", alone)
        .withColumn("_share", F.pmod(F.xxhash64("region_id"), F.ceil(F.count("*").over(same) / F.lit(SHARED))))
        .withColumn("_least", F.min("region_id").over(shared))
        .withColumn("_ids", F.collect_list("region_id").over(shared))
        .filter(~F.col("alone") | (F.col("region_id") == F.col("_least")))
        .select(
            F.struct(*EXTENT).alias("sides"), "alone",
            F.when(F.col("alone"), F.col("_ids")).otherwise(F.array("region_id")).alias("ids"),
            *envelope_columns(*[F.col(c) for c in EXTENT]),
        )
        .withColumn("_from", F.least(_own_level(finest) + 1, F.lit(LEVELS - 1)))
    )


def _on_tiles(segments: DataFrame, boxes: DataFrame, finest: float) -> DataFrame:
    """One row for each tile in which a segment may reach the corner of a box.

    A path and a box meet on one grid only: that of the box's ``_from`` or of the path's longest segment (``_reach``),
    whichever is coarser. ``_own``: paths for which it is the latter. Tiles beyond the corners of all boxes are left out.
    """
    corners = {}
    for axis in "xy":
        corner = F.when(~F.isnan(f"{axis}min"), F.col(f"{axis}min"))
        corners |= {f"least_{axis}": F.min(corner), f"last_{axis}": F.max(corner)}
    bounds = boxes.agg(F.collect_set("_from").alias("used"), *[c.alias(n) for n, c in corners.items()]).first()
    met = [sorted({max(g, reach) for g in bounds.used}) for reach in range(LEVELS)]
    grids = F.array(*[F.array(*map(F.lit, m)).cast("array<int>") for m in met])
    grid = F.col("_grid")
    beyond = F.lit(finest * 1.001) * F.pow(F.lit(FACTOR), grid - 1)
    listed = segments.withColumn("_grid", F.explode(F.get(grids, F.col("_reach"))))
    listed = listed.withColumn("_own", grid == F.col("_reach"))
    for axis in ("x", "y"):
        low, high = _cell(F.col(f"{axis}min") - beyond, grid, finest), _cell(F.col(f"{axis}max"), grid, finest)
        if bounds[f"least_{axis}"] is not None:
            low = F.greatest(low, _cell(F.lit(bounds[f"least_{axis}"]), grid, finest))
            high = F.least(high, _cell(F.lit(bounds[f"last_{axis}"]), grid, finest))
        cells = F.when(F.col("_low") <= F.col("_high"), F.sequence("_low", "_high"))
        listed = listed.withColumn("_low", low).withColumn("_high", high).withColumn(f"_t{axis}", F.explode(cells))
    return listed


def _on_home(tiles: DataFrame, boxes: DataFrame, chosen: Column, finest: float) -> DataFrame:
    """The chosen boxes in the tiles (with ``_n`` segments) that hold their lower left corners, as many rows as grids they are met on.

    ``_parts`` and ``_blocks`` tell in how many groups the tile's paths and boxes go, ``_pack`` which boxes share a row there.
    """
    grid = F.col("_grid")
    width = F.lit(finest) * F.pow(F.lit(FACTOR), grid)

    def side(name: str, tile: Column, last: float) -> Column:
        return F.when(grid < LEVELS - 1, tile * width).otherwise(F.lit(last)).alias(name)

    inf = float("inf")
    extents = tiles.select(
        *TILE, "_n",
        side("xmin", F.col("_tx"), -inf), side("ymin", F.col("_ty"), -inf),
        side("xmax", F.col("_tx") + 1, inf), side("ymax", F.col("_ty") + 1, inf),
    )
    home = (
        chosen
        & (_cell(F.col("r_xmin"), grid, finest) == F.col("_tx"))
        & (_cell(F.col("r_ymin"), grid, finest) == F.col("_ty"))
        & ((F.col("_from") == grid) | (F.col("_own") & (F.col("_from") < grid)))
    )
    for c in EXTENT:
        home = home & F.col(f"sides.{c}").isNotNull()
    return (
        box_pairs(extents, boxes, finest)
        .filter(home)
        .withColumn("_m", F.count("*").over(Window.partitionBy(*TILE)))
        .withColumn("_parts", F.ceil(F.col("_n") / F.lit(SEGMENTS)))
        .withColumn("_blocks", F.ceil(F.col("_m") / F.lit(BOXES)))
        .withColumn("_pack", F.pmod(F.xxhash64("sides", "ids"), F.ceil(F.col("_m") / F.lit(PACK))))
        .select(*TILE, "_parts", "_blocks", "_pack", "sides.*", "ids")
    )


def _met(listed: DataFrame, boxes: DataFrame, chosen: Column, key: Sequence[str], finest: float) -> DataFrame:
    """``key, region_id, n_segments, first_contact`` of segments on their tiles and the chosen boxes.

    A region of several boxes has a row for each, a path of several chunks too.

    There all segments of a path that a box may meet stand together, so each
    (path, box) comes out once, from a task that holds the boxes of a group and streams the paths past them. A tile
    of many segments is dealt over groups by path, one of many boxes by box.
    """
    home = cut_lineage(_on_home(listed.groupBy(*TILE).agg(F.count("*").alias("_n")), boxes, chosen, finest))
    pack = [*TILE, "_parts", "_blocks", "_pack"]
    as_one = StructType([*[home.schema[c] for c in pack], StructField("boxes", BinaryType())])
    packs = (
        home.groupBy(*pack)
        .applyInArrow(contacts.packed(pack), as_one)
        .select(
            *TILE, F.pmod("_pack", "_blocks").alias("_block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "boxes",
        )
    )
    wide = (
        home.filter((F.col("_parts") > 1) | (F.col("_blocks") > 1))
        .select(*[F.col(c).alias(f"_h{c}") for c in TILE], "_parts", "_blocks")
        .distinct()
    )
    ends = ["x1", "y1", "x2", "y2"]
    paths = listed.join(F.broadcast(wide), [F.col(c) == F.col(f"_h{c}") for c in TILE], "left").select(
        *TILE,
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_blocks", F.lit(1)) - 1)).alias("_block"),
        F.pmod(F.xxhash64(*key, CHUNK), F.coalesce("_parts", F.lit(1))).alias("_part"),
        *key, CHUNK, "t", *ends,
    )
    spark = listed.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = packs.unionByName(paths, allowMissingColumns=True).repartition(tasks, *GROUP)
    rows = rows.sortWithinPartitions(*GROUP, F.col("boxes").isNull(), *key, CHUNK, F.col("t").asc_nulls_last())
    out = StructType([
        *[listed.schema[k] for k in (*key, CHUNK)],
        boxes.schema["ids"],
        StructField("n_segments", LongType()),
        StructField("first_contact", listed.schema["t"].dataType),
    ])
    shared = rows.mapInArrow(contacts.visits(list(GROUP), [*key, CHUNK], ends), out)
    return shared.select(*key, F.explode("ids").alias("region_id"), "n_segments", "first_contact")


def region_visits(
    instants: DataFrame,
    regions: DataFrame,
    key: Sequence[str] = KEY,
    finest: float = 1000.0,
    **chunking,
) -> DataFrame:
    """Each (path, region) that meet: number of segments in contact and first such time.

    ``regions`` has ``region_id`` and extent columns. Segments meet the boxes of the regions tile by tile, where
    contacts are found and counted path by path, so neither contacts nor counts are shuffled or kept. Regions of one
    and the same box are met once, and every one of them gets the result. What a large path's chunks or a region's
    boxes give is added up afterwards.
    """
    key = list(key)
    rows = neighbours(with_chunk(instants, [*key, "t", "x", "y"]), key, POSITION, **chunking)
    x2, y2 = F.coalesce("next.x", "x"), F.coalesce("next.y", "y")
    segments = (
        rows.select(
            *key, CHUNK, "t", F.col("x").alias("x1"), F.col("y").alias("y1"), x2.alias("x2"), y2.alias("y2"),
            F.least("x", x2).alias("xmin"), F.least("y", y2).alias("ymin"),
            F.greatest("x", x2).alias("xmax"), F.greatest("y", y2).alias("ymax"),
        )
        .dropna(subset=["x1", "y1", "x2", "y2"])
        .withColumn("_reach", F.max(_own_level(finest)).over(Window.partitionBy(*key, CHUNK)))
    )
    boxes = cut_lineage(_distinct_boxes(regions.select("region_id", *EXTENT), finest))
    listed = cut_lineage(_on_tiles(segments, boxes, finest).select(*TILE, *key, CHUNK, "t", "x1", "y1", "x2", "y2"))
    large, alone = F.col(CHUNK).isNotNull(), F.col("alone")
    whole = _met(listed.filter(~large), boxes, alone, key, finest)
    parted = []
    if not boxes.filter(~alone).isEmpty():
        parted.append(_met(listed.filter(~large), boxes, ~alone, key, finest))
    if not listed.filter(large).isEmpty():
        parted.append(_met(listed.filter(large), boxes, F.lit(True), key, finest))
    for some in parted[1:]:
        parted[0] = parted[0].unionByName(some)
    if parted:
        sums = [F.sum("n_segments").alias("n_segments"), F.min("first_contact").alias("first_contact")]
        whole = whole.unionByName(parted[0].groupBy(*key, "region_id").agg(*sums))
    return whole
