"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are words in lower case and runs of other signs; a token's case and an immediate repeat
are tokens too. One- and two-grams of tokens are hashed to ``2 ** BITS`` features. A document is
the sparse vector of its n-gram counts over their number, so long and short texts weigh alike.

Training rows (bounded: ``TRAIN_ROWS`` of each label, those with the smallest hash of their id)
are dealt over ``SHARDS`` tasks. Each runs the per-coordinate FTRL-proximal updates over its
rows, from the weights that all have agreed on; Spark averages the weights by feature over the
shards that met it, and the next round starts from there. The model is 2 ** BITS numbers at most.

Every text is scored whole as a sparse dot product. A null or empty text has no n-gram and gets
the score of the bias alone. Without any training row the score is 0.5. Repeated rows are scored
one by one; columns other than doc_id and text are never looked at, nor the id but for its fold.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import fold, ship
from driftline.session import cut_lineage

BITS, ROUNDS, SHARDS = 18, 3, 8
TRAIN_ROWS = 4_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-5
#: Feature vectors have this length; a weight of 1 then moves a score by as much.
SCALE = 8.0
DECISION = 0.7

TOKEN = re.compile(r"\w+|[^\w\s]+")
U = np.uint64


class TokenHashes(dict):
    """Hash of a token in lower case, and of its case, by the token; forgotten when full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        case = b"U" if token.isupper() and len(token) > 1 else b"L" if token.isalnum() else b"S"
        self[token] = found = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "replace")) & ~3 | b"ULS".index(case)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def features(text: str, known: TokenHashes, bits: int = BITS) -> np.ndarray:
    """Feature numbers of all n-grams of a text, repeats included."""
    found = TOKEN.findall(text)
    tokens = np.fromiter(map(known.__getitem__, found), U, len(found))
    if not len(tokens):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        kinds = tokens & U(3)
        again = np.concatenate([[False], tokens[1:] == tokens[:-1]])
        pairs = tokens[:-1] * U(0x9E3779B97F4A7C15) + tokens[1:]
        shapes = kinds[:-1] * U(8) + kinds[1:] * U(2) + again[1:] + U(77)
    grams = np.concatenate([tokens, pairs, kinds + U(1), shapes])
    return (_mix(grams) >> U(64 - bits)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: list[int], weights: np.ndarray, bias: float, epochs: int = 1) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights after FTRL-proximal updates that start at ``weights``; and which features were met.

    z holds the sum of gradients less what the changing rate has already given back, n the sum of
    their squares; a weight is the closed form of both. Starting at given weights means starting
    with the z whose closed form they are.
    """
    n = np.zeros(len(weights) + 1)
    start = np.append(weights, bias)
    z = -start * (BETA / ALPHA + L2) - np.sign(start) * L1
    for _ in range(epochs):
        for grams, label in zip(rows, labels):
            at, counts = np.unique(grams, return_counts=True)
            at = np.append(at, len(weights))
            x = np.append(counts * (SCALE / max(1, len(grams))), 1.0)
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0.0)
            w = -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
    w = -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return w[:-1], float(w[-1]), n[:-1] > 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, rows: int) -> DataFrame:
    """doc_id, y, text: up to ``rows`` of each label outside the fold that is left out, by smallest hash of the id."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != left_out)
    ).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    picked = known.where("y = 0").orderBy("h", "doc_id").limit(rows).union(
        known.where("y = 1").orderBy("h", "doc_id").limit(rows)
    )
    picked = cut_lineage(picked)  # two times ``rows`` at most: a bounded broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "h", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, left_out: int = 2) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = training_rows(docs, labels, label, folds, left_out, TRAIN_ROWS)
    rows = cut_lineage(rows.withColumn("shard", F.pmod("h", F.lit(SHARDS))).repartition(SHARDS, "shard"))
    weights, bias = np.zeros(2**BITS), 0.0
    for _ in range(ROUNDS):
        agreed = spark.sparkContext.broadcast((weights, bias))

        def shard(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "doc_id", "text"])
            known = TokenHashes()
            grams = [features(t, known) for t in pdf["text"]]
            w, b, met = ftrl(grams, pdf["y"].tolist(), *agreed.value)
            at = np.flatnonzero(met)
            return pd.DataFrame({"f": np.append(at, -1), "w": np.append(w[at], b)})

        # Shards hold a bounded number of rows: TRAIN_ROWS of each label over SHARDS.
        found = rows.groupBy("shard").applyInPandas(shard, "f long, w double")
        merged = found.groupBy("f").agg(F.avg("w").alias("w")).toPandas()
        if merged.empty:
            return weights, bias
        weights = weights.copy()
        real = merged["f"] >= 0
        weights[merged["f"][real]] = merged["w"][real]
        bias = float(merged["w"][~real].iloc[0])
    return weights, bias


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    ship(docs.sparkSession)
    weights, bias = train(docs, labels, "quality", folds, left_out)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, b = model.value
        known = TokenHashes()
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            grams = features(t, known)
            out[i] = b + (w[grams].sum() * SCALE / len(grams) if len(grams) else 0.0)
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    scored = docs.select(
        "doc_id", (fold(F.col("doc_id"), folds) == left_out).alias("held_out"),
        score(F.coalesce("text", F.lit(""))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
