"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key drawn by hash from its id, which puts each source in a random order
that is the same in every run. A source's words are taken in this order until its budget is used
up; a budget beyond the source's size repeats the whole source first (an epoch each) and takes
the remainder from the next pass.

No source is ever sorted whole: sizes are summed by (source, range of keys), these sums are
accumulated, and only the one range that holds the cut is ordered document by document.

A null text has size 0 and takes part with 0 words; null ids count as empty text; a null source
is a source of its own, after all others. Documents with the same id and size share the key:
if the cut falls on them, each gives the same number of words. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import WORD
from driftline.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
SEED = "mix-1:"
#: Hex digits of the key that make a range: 65,536 ranges for each source.
RANGE_DIGITS = 4
#: Sources up to which the cuts (some 100 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Words of each source in the mix: its weight times a level common to all, cap times its size at most.

    The level at which all targets add up is where sharing out the excess ends. With sources in
    order of cap over weight it is the largest of: what is left to share once the sources before
    are full, over the weights from here on. One row per source, so one window over all of them.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    filling = W.orderBy(F.col("full") / F.col("weight"), "place")
    before, onwards = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    everywhere = W.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    named = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    named = named.withColumn("weight", weight).withColumn("full", cap * F.col("source_size"))
    level = (
        share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onwards)
    levelled = named.withColumn("level", level).withColumn("level", F.max("level").over(everywhere))
    return levelled.select(
        "source", "source_size",
        F.greatest(F.lit(0.0), F.least("full", F.col("weight") * F.col("level"))).alias("target"),
    )


def plan_mix(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """One row per source: source_size, target, epochs, and where the last pass ends.

    ``sized`` has source, size and key. All documents before (cut_key, cut_size) are taken once
    more, those at it give ``part`` words, those after it none.
    """
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    wanted = cut_lineage(wanted)

    ranged = sized.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    running = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("range_size").over(running), F.lit(0)))
    need = wanted.select(F.col("source").alias("of"), "rest").where("rest > 0")
    at = sums.join(need, F.col("source").eqNullSafe(F.col("of"))).where("before < rest AND rest <= before + range_size")
    at = at.select("of", F.col("range").alias("at_range"), "before", "rest")

    inside = ranged.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at_range")))
    inside = inside.groupBy("of", "key", "size").agg(
        F.count("*").alias("copies"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    running = W.partitionBy("of").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    words = F.col("size") * F.col("copies")
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum(words).over(running), F.lit(0)))
    cuts = inside.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + words)).select(
        "of", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"),
        F.floor((F.col("rest") - F.col("before")) / F.col("copies")).alias("part"),
    )
    return wanted.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_size", "part"
    )


def with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and ``taken``; ``sized`` keeps its columns."""
    plan = cut_lineage(plan)
    plan = plan.withColumnRenamed("source", "_source")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    again = (
        F.when(F.col("cut_key").isNull(), 0)
        .when((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("size") < F.col("cut_size"))), F.col("size"))
        .when((F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size")), F.col("part"))
        .otherwise(0)
    )
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("taken", (F.col("epochs") * F.col("size") + again).cast("long"))
        .drop("_source", "epochs", "cut_key", "cut_size", "part")
    )


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document. The text is read once."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("key"))
    sized = cut_lineage(sized)
    return with_plan(sized, plan_mix(sized, **options)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each time a document is taken.

    A document taken twice stands there twice. The document at a source's cut stands there with
    the words that are taken of it, up to the end of the last one; ``n_chars``, if present, follows.
    """
    small = cut_lineage(
        docs.select("source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("key"))
    )
    sized = docs.select(
        F.struct("*").alias("doc"), "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("key")
    )
    taken = with_plan(sized, plan_mix(small, **options)).where("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))
    each = taken.select("doc", "size", "taken", F.explode(copies).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), words), "")
    each = each.withColumn("text", F.when(words == F.col("size"), F.col("doc.text")).otherwise(cut))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return each.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mixing_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{word}')), 0) AS size,
        md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
      FROM documents
    ), sizes AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
    ), named AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes
    ), weighted AS (
      SELECT *, [{', '.join(map(str, WEIGHTS))}][CAST(place % {len(WEIGHTS)} + 1 AS BIGINT)] AS weight, CAST({CAP} AS DOUBLE) * source_size AS "full" FROM named
    ), levels AS (
      SELECT *, (CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum("full") OVER (ORDER BY "full" / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY "full" / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM weighted
    ), targets AS (
      SELECT source, source_size, greatest(0, least("full", weight * max(level) OVER ())) AS target FROM levels
    ), budgets AS (
      SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM targets
    ), rests AS (
      SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM budgets
    ), groups AS (
      SELECT source, key, size, count(*) AS copies FROM sized GROUP BY ALL
    ), prefixes AS (
      SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups
    ), parts AS (
      SELECT p.source, p.key, p.size, r.source_size, r.target,
        r.epochs * p.size + greatest(0, least(p.size, (r.budget - r.epochs * r.source_size - p.before) // p.copies)) AS taken
      FROM prefixes p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source
    )
    SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, p.source_size, CAST(p.target AS DOUBLE) AS target, CAST(p.taken AS BIGINT) AS taken
    FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source AND s.key = p.key AND s.size = p.size"""
