"""Nearest neighbours against brute force."""

import numpy as np

from driftline.llm import neighbours
from driftline.llm.queries import QUERIES
from tests.llm import cases


def brute(ids, x, query, k=10):
    d = np.sqrt(((x - x[list(ids).index(query)]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return [(int(ids[i]), d[i]) for i in order]


def recall(got, ids, x):
    hit = all_of = 0
    for query, rows in got.groupby("query_id"):
        want = brute(ids, x, query)
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, len(want) + 1))
        d = dict(zip(ids, np.sqrt(((x - x[list(ids).index(query)]) ** 2).sum(axis=1))))
        assert np.allclose([d[v] for v in rows["vec_id"]], rows["score"], rtol=1e-12, atol=0)
        order = list(zip(rows["score"], rows["vec_id"]))
        assert order == sorted(order)
        hit += len({v for v, _ in want} & set(rows["vec_id"]))
        all_of += len(want)
    return hit / all_of


def test_recall_on_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    got = QUERIES["op3_nearest_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    assert sorted(got["query_id"].unique()) == [i for i in ids if i % 100 == 0]
    assert recall(got, ids, x) >= 0.9


def test_hot_vector_and_ties(spark):
    """A third of the rows are one vector, another third lies close around it."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((1500, 16))
    x[:500] = x[0]
    x[500:1000] = x[0] + draw.standard_normal((500, 16)) * 1e-3
    ids = draw.permutation(1500)
    docs = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(docs).toPandas()
    assert got["query_id"].nunique() == 15 and len(got) == 150
    assert recall(got, ids, x) >= 0.9
    copies = set(ids[:500])
    for query, rows in got[got["query_id"].isin(copies)].groupby("query_id"):
        assert rows.sort_values("rank")["vec_id"].tolist() == sorted(copies - {query})[:10]
        assert (rows["score"] == 0).all()


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (200, [0.0, 0.0]), (4, [nan, 1.0]),
        (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (300, None), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.5]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]),
    ]
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>").selectExpr("*", "1 AS query", "2 AS score", "3 AS vec")
    got = neighbours.nearest_neighbours(table).toPandas()
    assert set(got["query_id"]) == {0, 100}
    first = got[got["query_id"] == 0].sort_values("rank")
    assert first["vec_id"].tolist() == [100, 1, 9, 10] and first["score"].tolist() == [0.0, 0.5, np.sqrt(2), np.sqrt(2)]
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(table.where("vec_id = 0")).count() == 0


def test_probes_come_by_expected_success():
    sets = neighbours.perturbations(6, 60)
    assert sets[0].sum() == 0 and len({tuple(s) for s in sets}) == 60
    assert not any(s[j] and s[11 - j] for s in sets for j in range(6))


def test_small_cells_give_the_same(spark, monkeypatch):
    draw = np.random.default_rng(8)
    x = draw.standard_normal((400, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = neighbours.nearest_neighbours(docs).toPandas()
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    parted = neighbours.nearest_neighbours(docs).toPandas()
    assert cases.rows(whole) == cases.rows(parted)
