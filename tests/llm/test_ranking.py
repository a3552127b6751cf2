"""Ranked search against every score computed one by one, and against SQL."""

import math
import random
import re

import numpy as np
import pytest

from driftline.llm import ranking
from driftline.llm.common import read
from tests.llm import cases

TERM = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=50):
    """docs: (doc_id, text); items: (item_id, text)."""
    held = [(i, TERM.findall((t or "").translate(A_TO_Z))) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, size = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, terms in held:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(A_TO_Z)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, own in held:
            m = 50 + (50 * len(own) * n) // size
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * own.count(t)) // (1000 * own.count(t) + 20 * m))
                for t in terms if t in own
            )
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=50):
    found = ranking.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, shard, first, block", [(1, 20_000, 64, 500_000), (2, 7, 1, 500_000), (3, 40, 2, 30)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, first, block):
    """Small shards, short reads and several blocks of the query set; few words and equal lengths, so many ties."""
    monkeypatch.setattr(ranking, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(ranking, "FIRST_READ", first)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", block)
    draw = random.Random(seed)
    words = ["a", "the", "Über", "x1", "zeta", *cases.sentences(seed, 1, 25)[0].split()]
    docs = [(i, " ".join(draw.choice(words[: draw.randint(2, len(words))]) for _ in range(draw.choice([3, 3, 3, 12, 60])))) for i in range(260)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 15)))) for i in range(12)]
    for k in (5, 50):
        assert run(spark, docs, items, k) == brute(docs, items, k)


def test_bounds_stop_before_the_end():
    """Where one document leads in every list, the rest of the lists is left unread."""
    size, terms = 5000, 3
    ids, lengths = np.arange(size), np.full(size, 100)
    lists = [np.arange(terms, dtype=np.int32)] * size
    counts = [np.array([50 if i < 10 else 1] * terms, np.int32) for i in range(size)]
    reads = []
    shard = ranking.Shard(ids, lengths, lists, counts)
    scores, best = ranking.best_of(shard, [0, 1, 2], {0: 5, 1: 7, 2: 9}, 10, np.empty(0, np.int64), np.empty(0, np.int64), reads)
    assert best.tolist() == list(range(10)) and scores.tolist() == [21 * (50 * 10**9 // (50_000 + 2000))] * 10
    assert reads[0] < 0.1 * size * terms


def test_awkward_rows(spark):
    docs = [(r.doc_id, r.text) for r in cases.documents(spark).collect()]
    items = [
        (1, "MIT license"), (2, None), (3, ""), (4, "no such termxyz"), (5, "über the Lumière"), (5, "naïve"), (None, "six five"), (6, "12345"),
        (7, "the the THE"), (8, "中文文本没有空格"), (1, "MIT license"), (9, " ".join(t for t in cases.TEXTS[5:13])),
    ]
    docs += [(None, "six"), (None, "six"), (10**12, "six"), (-4, "six")]
    table = cases.documents(spark).select("doc_id", "text", "score", "key").unionByName(
        spark.createDataFrame([(*d, "x", "y") for d in docs[-4:]], "doc_id long, text string, score string, key string")
    )
    found = ranking.rank_documents(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)
    assert run(spark, [(1, None)], items) == [] and run(spark, docs, [(1, None)]) == []
    assert ranking.rank_documents(cases.no_documents(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_query_equals_sql(spark):
    from driftline.llm.queries import ORACLE, QUERIES

    got = QUERIES["op11_ranked_search"](spark, cases.SMALL)
    con = cases.duck(documents=read(spark, cases.SMALL, "documents"), benchmark=read(spark, cases.SMALL, "benchmark"))
    assert cases.rows(got.toPandas()) == cases.rows(con.sql(ORACLE["op11_ranked_search"]).df())
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
