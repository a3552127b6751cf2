"""Ranked lexical search by sequential reads alone: lower and upper bounds of each document's score.

All documents are ranked for each item of a stated query set. The score of a document sums, over
the item's distinct terms, a weight of the term times an impact of the term in the document, in
whole numbers (see ``weight`` and ``impacts``).

One pass over the texts writes, for each document, its length and its counts of the query set's
terms; Spark sums these to the number of documents, of terms, and of documents for each term. The
documents then stay where they lie. A task takes them in shards of bounded size, and each shard
holds for every term its postings by falling impact. For an item the lists of its terms are read
from the top, all together and further each time. A document read so far has at least what it has
been seen with, and at most that and, for each list in which it has not been seen, the impact at
which that list stands; a document not met yet has at most the sum of these. Reading goes on until
whoever could still reach the last place (an equal score counts, as ties go by doc_id) has equal
bounds, and nobody unmet can. So membership, ties and scores are all settled by sequential reads,
without looking a document up. What earlier shards of a task gave raises the bar for later ones;
each task hands on its ``k`` best for each item, and those meet in two steps.

A term is a maximal run of ASCII letters, digits and other code points from U+0080 on, A-Z in
lower case. A null or empty text has none: such a document is never returned, such an item has no
rows. Rows of one item_id are one item with the terms of all; a null item_id is an item of its
own. Documents that repeat a doc_id are ranked one by one; one without doc_id comes after all
others of equal score. Scores of 0 are not returned. Other columns are not read. Texts of any
length count whole. The query set goes in blocks of about ``BLOCK_TERMS`` pairs of item and term,
which bounds what is broadcast; each block reads the texts once. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import LOWER, UPPER, lower_ascii, ship, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
#: Pairs of item and term in a block of the query set; documents and postings of a shard.
BLOCK_TERMS = 500_000
SHARD_DOCUMENTS, SHARD_POSTINGS = 20_000, 2_000_000
#: Postings of each list in the first read; every read is twice as long as the one before.
FIRST_READ = 64
#: Tasks whose best documents meet before those of all tasks do.
TASKS_TOGETHER = 32

#: Every byte that ends a term becomes a space, A-Z become a-z.
BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Stands for a missing doc_id inside tasks.
LAST = 2**63 - 1


def terms_of(text: Column) -> Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of a term that stands ``counts`` times in documents of relative lengths ``lengths``."""
    return (1_000_000_000 * counts) // (1000 * counts + 20 * lengths)


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary), counts: one row for each document. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n long, terms array<int>, counts array<int>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number = shared.value
        for texts in batches:
            out = []
            for text in texts:
                found = text.encode().translate(BYTES).split(b" ")
                counts = Counter(found)
                n = len(found) - counts.pop(b"", 0)
                held = [(number[t], c) for t, c in counts.items() if t in number]
                out.append((n, [t for t, _ in held], [c for _, c in held]))
            yield pd.DataFrame(out, columns=["n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), counted(F.coalesce("text", F.lit(""))).alias("c"))
    return rows.select("doc_id", "c.*").where("n > 0")


class Shard:
    """Some documents, and for each term its postings by falling impact."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]):
        self.doc_ids = doc_ids
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        place = np.repeat(np.arange(len(terms)), sizes)
        term = np.concatenate([*terms, np.empty(0, np.int32)]).astype(np.int64)
        impact = impacts(np.concatenate([*counts, np.empty(0, np.int32)]).astype(np.int64), lengths[place])
        order = np.lexsort((place, -impact, term))
        self.place, self.impact, term = place[order], impact[order], term[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts[1:], len(term))
        self.lists = {int(term[a]): (int(a), int(b)) for a, b in zip(starts, ends)}


def best_of(shard: Shard, terms: list[int], weights: dict[int, int], k: int, scores: np.ndarray, ids: np.ndarray, reads: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of a shard's documents and of those given, by score and doc_id. ``reads`` gets the postings read."""
    lists = [(shard.place[a:b], shard.impact[a:b] * weights[t]) for t in terms if weights[t] > 0 and t in shard.lists for a, b in [shard.lists[t]]]
    if not lists:
        return scores, ids
    size = len(shard.doc_ids)
    lower = np.zeros(size, np.int64)
    done, step = 0, FIRST_READ
    while True:
        stand, known = [], np.zeros(size, np.int64)  # where each list stands; of that, what documents have been seen in
        for place, value in lists:
            lower[place[done : done + step]] += value[done : done + step]
            stand.append(int(value[done + step]) if done + step < len(value) else 0)
        unmet = sum(stand)
        if unmet:
            for (place, _), at in zip(lists, stand):
                if at:
                    known[place[: done + step]] += at
        open_by = unmet - known
        upper = lower + open_by
        all_lower = np.concatenate([scores, lower])
        bar = int(np.partition(all_lower, len(all_lower) - k)[len(all_lower) - k]) if len(all_lower) >= k else 0
        reach = (upper >= bar) & (upper > 0) & ((lower > 0) | (unmet >= max(bar, 1)))
        if not unmet or (unmet < bar and not open_by[reach].any()):
            break
        done += step
        step *= 2
    if reads is not None:
        reads.append(sum(min(len(v), done + step) for _, v in lists))
    found = np.flatnonzero((lower > 0) & (lower >= bar))
    scores, ids = np.concatenate([scores, lower[found]]), np.concatenate([ids, shard.doc_ids[found]])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def shards(batches: Iterator[pd.DataFrame], documents: int, terms: int) -> Iterator[Shard]:
    """Rows of the index as shards of bounded size."""

    def made() -> Shard:
        rows = pd.concat(held, ignore_index=True)
        lengths = np.array([50 + (50 * int(n) * documents) // terms for n in rows["n"]], np.int64)
        return Shard(rows["doc_id"].to_numpy(np.int64), lengths, rows["terms"].tolist(), rows["counts"].tolist())

    held, rows, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        postings += int(batch["terms"].map(len).sum())
        if rows >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
            yield made()
            held, rows, postings = [], 0, 0
    if rows:
        yield made()


def ranked_block(docs: DataFrame, wanted: dict[int, list[str]], k: int) -> DataFrame:
    """at (number of the item), doc_id, score: the ``k`` best of each task for each item of a block."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in wanted.values() for t in terms}))}
    postings = written(index(docs, {t.encode(): i for t, i in vocabulary.items()}), "postings")
    documents, in_all = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # As many rows as the block has terms.
    holding = {r["t"]: r["n"] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    weights = {t: weight(documents, n) for t, n in holding.items()}
    items = {at: [vocabulary[t] for t in terms if vocabulary[t] in weights] for at, terms in wanted.items()}
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = shared.value
        nothing = np.empty(0, np.int64)
        best = {at: (nothing, nothing) for at in items}
        for shard in shards(batches, documents, in_all):
            for at, terms in items.items():
                best[at] = best_of(shard, terms, weights, k, *best[at])
        task = TaskContext.get().partitionId()
        for at, (scores, ids) in best.items():
            if len(scores):
                yield pd.DataFrame({"at": at, "task": task, "doc_id": ids, "score": scores})

    found = postings.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))).mapInPandas(ranked, "at long, task int, doc_id long, score long")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    ship(spark)
    pairs = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    pairs = written(pairs, "queries")
    numbers = written(
        pairs.groupBy("item_id").agg(F.count("*").alias("n")).withColumn(
            "at", F.row_number().over(Window.orderBy(F.asc_nulls_first("item_id")))  # one row for each item of the query set
        ), "items",
    )
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(numbers.withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK_TERMS)), "blocks")
    best = None
    for (block,) in sorted(blocks.select("block").distinct().collect()):
        own = blocks.where(F.col("block") == block).select(F.col("item_id").alias("id"), "at")
        wanted: dict[int, list[str]] = {}
        for at, term in pairs.join(own, F.col("item_id").eqNullSafe(F.col("id"))).select("at", "term").collect():
            wanted.setdefault(at, []).append(term)
        found = ranked_block(docs, wanted, k)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], "at long, task int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("at", F.floor(F.col("task") / TASKS_TOGETHER)).orderBy(*order)
    every = Window.partitionBy("at").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).select("at", "doc_id", "score")
    best = best.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
    return best.join(numbers.select("item_id", "at"), "at").select("item_id", "rank", "doc_id", "score")


def ranking_sql(k: int = BEST) -> str:
    """DuckDB SQL for the same rows: every document's score for every item."""
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
    size AS (SELECT row_no, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS in_all FROM size),
    held AS (SELECT row_no, term, count(*)::BIGINT AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) GROUP BY row_no, term),
    weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term, docs),
    asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL),
    scored AS (SELECT item_id, row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // in_all))))::BIGINT AS score
        FROM asked JOIN weighed USING (term) JOIN held USING (term) JOIN size USING (row_no), whole GROUP BY item_id, row_no)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored JOIN size USING (row_no) WHERE score > 0 QUALIFY rank <= {k}"""
