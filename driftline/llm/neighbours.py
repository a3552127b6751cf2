"""Approximate nearest neighbours: p-stable hashing with query-directed multiprobe.

Each of ``TABLES`` tables hashes a vector v to ``floor((a.v + b) / width)`` for several random
directions a; equal values make a bucket. A query visits its own bucket and those whose values
differ by one in some directions, in the order in which neighbours are expected there: the nearer
a query lies to the borders it crosses, the earlier. Candidates of all tables are merged and
ranked by their exact distance, in double precision.

Buckets are dealt to tasks by table and cell, a cell being all buckets that agree in the first
directions. Cells with more than ``BLOCK`` vectors are dealt over several tasks by a hash of the
id, and queries go to each of them, so a hot cell meets in no task. A task passes on the best of
each query only, so pairs of query and candidate are no rows of Spark. The number of directions
rises with the logarithm of the number of vectors, to keep buckets from growing with it.

``width`` and the number of probes are fitted on a bounded sample (``SAMPLE`` vectors, those with
the smallest hash of their id): the width to the usual distance of the last neighbour asked for, the probes
to a recall of ``RECALL`` against brute force within the sample. Every vector is indexed.

Equal vectors are one point that knows the smallest of its ids, as many as a result can hold.
A query for which fewer candidates were met than asked for is compared with every vector, block
by block. Vectors null, all zero, or with null or non-finite components take no part, nor rows
without id; vectors of another length are no candidates. Rows that repeat an id count once, with
the smallest vector. Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import ship, written
from driftline.session import cut_lineage

TABLES, DIRECTIONS = 16, 11
WIDTH = 2.0
SAMPLE, SAMPLE_QUERIES, RECALL = 2_000, 100, 0.96
PROBES = (16, 32, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
BLOCK = 8_192


class Index(NamedTuple):
    dim: int
    width: float
    directions: int
    cell: int  # directions that make a cell
    probes: int


@lru_cache(maxsize=64)
def _table(index: Index, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets, and odd multipliers that make one number of a bucket's values."""
    draw = np.random.default_rng([index.dim, index.directions, table])
    return (
        draw.standard_normal((index.dim, index.directions)),
        draw.uniform(0, 1, index.directions),
        draw.integers(-(2**62), 2**62, index.directions, dtype=np.int64) * 2 + 1,
    )


@lru_cache(maxsize=16)
def perturbations(directions: int, probes: int) -> np.ndarray:
    """Sets of borders to cross, best first, as rows of 0 and 1 over the 2 * directions nearest borders.

    Borders are known by their rank only; the expected squared distance of each rank orders the
    sets. From a set two more follow: its last border moved on by one, and the next one added.
    Both borders of one direction (ranks j and 2M + 1 - j) are never crossed together.
    """
    m = directions
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [
        1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
        for j in range(m + 1, 2 * m + 1)
    ]
    rows, heap = [np.zeros(2 * m, np.int64)], [(cost[0], (0,))]
    while heap and len(rows) < probes:
        score, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - j not in chosen for j in chosen):
            row = np.zeros(2 * m, np.int64)
            row[list(chosen)] = 1
            rows.append(row)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
    return np.array(rows)


def buckets(x: np.ndarray, index: Index, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and bucket of each vector."""
    a, b, mult = _table(index, table)
    values = np.floor(x @ a / index.width + b).astype(np.int64)
    with np.errstate(over="ignore"):
        return (values[:, : index.cell] * mult[: index.cell]).sum(axis=1), (values * mult).sum(axis=1)


def probed(x: np.ndarray, index: Index, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and buckets that each query visits: a row for each query, a column for each probe."""
    a, b, mult = _table(index, table)
    place = x @ a / index.width + b
    values = np.floor(place).astype(np.int64)
    into = place - values
    distance = np.concatenate([into, 1 - into], axis=1)  # to the border below, above
    order = np.argsort(distance, axis=1, kind="stable")
    step = np.concatenate([-mult, mult])
    in_cell = np.concatenate([np.arange(index.directions) < index.cell] * 2)
    sets = perturbations(index.directions, index.probes)
    with np.errstate(over="ignore"):
        cell = (values[:, : index.cell] * mult[: index.cell]).sum(axis=1)[:, None] + (step * in_cell)[order] @ sets.T
        bucket = (values * mult).sum(axis=1)[:, None] + step[order] @ sets.T
    return cell, bucket


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - query) ** 2).sum(axis=1))


def unpack(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def fit(sample: np.ndarray, total: int, k: int) -> Index:
    """Index parameters for a number of vectors like those of a sample.

    In a sample of one in n vectors, a k/n-th neighbour is as far away as a k-th among all.
    """
    k = -(-k * len(sample) // max(1, total))
    cell = max(1, round(np.log(max(1.0, total / 5_000)) / np.log(3)))
    dim = sample.shape[1]
    queries = sample[:SAMPLE_QUERIES]
    far = np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * queries @ sample.T))
    far[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    usual = float(np.median(np.take_along_axis(far, near, 1)[:, -1])) if near.size else 1.0
    index = Index(dim, WIDTH * (usual or 1.0), DIRECTIONS + cell, cell, PROBES[-1])
    if not near.size:
        return index._replace(probes=PROBES[0])
    met = np.zeros((len(PROBES), *near.shape), bool)
    for t in range(TABLES):
        _, own = buckets(sample, index, t)
        _, visited = probed(queries, index, t)
        for i, n in enumerate(near):
            first = (visited[i][None, :] == own[n][:, None])
            place = np.where(first.any(axis=1), first.argmax(axis=1), PROBES[-1])
            met[:, i, : len(n)] |= place[None, :] < np.array(PROBES)[:, None]
    enough = np.flatnonzero(met.mean(axis=(1, 2)) >= RECALL)
    return index._replace(probes=PROBES[enough[0]] if len(enough) else PROBES[-1])


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)




def _search(points: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """query, point, score: in each group the k nearest points to each query among those in its buckets.

    ``points`` has keys, point, vec, bucket; ``queries`` keys, query, vec, buckets (null: all).
    """
    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left = left.sort_values("bucket", kind="stable")
            x, ids, own = unpack(left["vec"]), left["point"].to_numpy(), left["bucket"].to_numpy()
            for q, v, visited in zip(right["query"], unpack(right["vec"]), right["buckets"]):
                if visited is None:
                    at = np.arange(len(ids))
                else:
                    visited = np.unique(visited)
                    lo, hi = np.searchsorted(own, visited), np.searchsorted(own, visited, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                if len(at):
                    d = distances(x[at], v)
                    first = np.lexsort((ids[at], d))[:k]
                    found.append(pd.DataFrame({"query": q, "point": ids[at][first], "score": d[first]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "point": [], "score": []})

    both = points.groupBy(*keys).cogroup(queries.groupBy(*keys))
    return both.applyInPandas(nearest, "query long, point long, score double")


def _dealt(points: DataFrame, queries: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """Points and queries by (dim, table, cell, part)."""
    def hashed(batches):
        for pdf in batches:
            x = unpack(pdf["vec"])
            for t in range(TABLES):
                cell, bucket = buckets(x, index, t)
                yield pd.DataFrame({"t": t, "cell": cell, "bucket": bucket, "point": pdf["point"], "vec": pdf["vec"]})

    def visiting(batches):
        for pdf in batches:
            x = unpack(pdf["vec"])
            for t in range(TABLES):
                cell, bucket = probed(x, index, t)
                for q, v, c, b in zip(pdf["query"], pdf["vec"], cell, bucket):
                    cells = np.unique(c)
                    yield pd.DataFrame({"t": t, "cell": cells, "query": q, "vec": v, "buckets": [b[c == at] for at in cells]})

    held = points.mapInPandas(hashed, "t int, cell long, bucket long, point long, vec binary")
    asked = queries.mapInPandas(visiting, "t int, cell long, query long, vec binary, buckets array<long>")
    counts = held.groupBy("t", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    counts = cut_lineage(counts)
    held = held.join(counts, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
    asked = asked.join(counts, ["t", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return held.drop("parts"), asked.drop("parts")


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    ship(vectors.sparkSession)
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))

    @F.pandas_udf("binary")
    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: np.asarray(x, "<f8").tobytes())

    base = base.groupBy("id").agg(F.min("v").alias("v"))
    base = written(base.select("id", F.size("v").alias("dim"), pack("v").alias("vec")), "vectors")
    results = [_of_length(base.where(F.col("dim") == r["dim"]), r["n"], k, every)
               for r in base.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    if not results:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _of_length(base: DataFrame, total: int, k: int, every: int) -> DataFrame:
    # A bounded sample: SAMPLE vectors come to the driver.
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()
    index = fit(unpack(sample["vec"]), total, k)

    place = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = base.select("id", "vec", place.alias("place")).where(F.col("place") <= k + 1)
    points = few.groupBy("vec").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = written(points, "points")
    asking = base.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec")
    asking = cut_lineage(asking.join(points.select("vec", "point"), "vec").select("query_id", "vec", F.col("point").alias("query")))
    queries = cut_lineage(asking.select("query", "vec").distinct())

    def nearest_ids(found: DataFrame) -> DataFrame:
        """The k + 1 nearest ids of each query point (its own among them)."""
        order = W.partitionBy("query").orderBy("score", "point")
        found = found.groupBy("query", "point").agg(F.min("score").alias("score"))
        found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
        each = found.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
        order = W.partitionBy("query").orderBy("score", "vec_id")
        return each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")

    held, asked = _dealt(points.select("point", "vec"), queries, index)
    found = cut_lineage(nearest_ids(_search(held, asked, ["t", "cell", "part"], k + 1)))
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, total))
    short = cut_lineage(queries.join(full, "query", "left_anti"))
    if not short.isEmpty():
        parts = total // BLOCK + 1
        everything = points.select(
            "point", "vec", F.lit(0).cast("long").alias("bucket"), F.pmod(F.xxhash64("point"), F.lit(parts)).cast("int").alias("part")
        )
        everywhere = short.select(
            "query", "vec", F.lit(None).cast("array<long>").alias("buckets"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        )
        exact = nearest_ids(_search(everything, everywhere, ["part"], k + 1))
        found = found.join(short.select("query"), "query", "left_anti").unionByName(exact)
    each = asking.select("query_id", "query").join(found, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
