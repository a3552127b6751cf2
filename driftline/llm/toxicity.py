"""Toxicity by compression distance: how much better a dictionary of toxic text compresses a window.

Two zstandard dictionaries of equal length are made from training text, one of toxic and one of
ordinary documents. A text is cut into windows of about ``WINDOW`` bytes at spaces; the distance
of a window is its compressed length under the ordinary dictionary less that under the toxic one.
A document's three largest distances give its score, by a logistic curve fitted on training
documents that the dictionaries have not seen.

What makes this work on short windows:

* the content of the toxic dictionary is picked by contrast: the words whose share of documents
  differs most between the labels (by the two-proportion z score), not merely frequent ones, which
  both labels share; how many is settled on the calibration rows. The ordinary dictionary holds the
  most frequent words of ordinary documents;
* both end in one anchor, which also ends every window, so a window always has a match and a
  single word more shows in full; literals are never entropy-coded, so that lengths differ by
  matches only.

Training is on a bounded sample: ``TRAIN_ROWS`` of each label, those with the smallest hash of the
id. Without a toxic and an ordinary training row the score is
0. Every text is scored whole, A-Z in lower case; null and empty texts have one empty window and
the score of distance 0. Rows are scored one by one, in any number; labels, lang, source and the
id are no input of a score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import fold, give_back, lower_ascii, ship
from driftline.llm.quality import training_rows
from driftline.session import cut_lineage

WINDOW, TOP = 48, 3
TRAIN_ROWS = 3_000
#: Numbers of toxic words that calibration chooses from.
SIZES = (8, 12, 16, 24, 32, 48, 64, 96)
FILL = 2_000
MIN_MATCH = 7
#: Words of fewer bytes than MIN_MATCH are made this long.
PADDED = 8
#: Contrast that such words need: common ones differ by chance, and the ordinary dictionary has none to set against them.
SHORT_Z = 3.0
CLIP = 10.0
DECISION = 0.3

ANCHOR = hashlib.sha256(b"anchor").digest()[:24]
#: zstandard starts no match in a block's last bytes.
TAIL = bytes(range(1, 9))


LETTER = rb"[a-z\x80-\xff]"
SHORT = re.compile(rb"(?<!%b)%b{1,%d}(?!%b)" % (LETTER, LETTER, MIN_MATCH - 1, LETTER))


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Of a dictionary of raw content; the fast strategy with a target length leaves literals as they are."""
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=MIN_MATCH, target_length=1,
            strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False,
        ),
    )


def windows(text: str) -> list[bytes]:
    """Whole text in windows that end at the first space after WINDOW bytes, or after twice as many."""
    data, found, at = text.encode().lower(), [], 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            space = data.find(b" ", end, end + WINDOW)
            end = space if space >= 0 else end + WINDOW
        found.append(data[at:end])
        at = end + 1 if data[end : end + 1] == b" " else end
    return found or [b""]


@lru_cache(maxsize=100_000)
def _padded(word: bytes) -> bytes:
    """A short word and bytes of its own, at least two."""
    return word + hashlib.blake2b(word, digest_size=PADDED).digest()[: max(2, PADDED - len(word))]


def forget() -> None:
    """Frees what a task has remembered: workers outlive it."""
    _padded.cache_clear()
    give_back()


def expanded(data: bytes) -> bytes:
    """Text in lower case with its short words made long enough to be matched."""
    return SHORT.sub(lambda m: _padded(m[0]), data)


def largest_distances(text: str, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[float]:
    best = [0] * TOP
    least = 0
    for w in windows(text):
        whole = b" %b %b%b" % (expanded(w), ANCHOR, TAIL)
        d = len(ordinary.compress(whole)) - len(toxic.compress(whole))
        if d > least:
            best = sorted([*best, d])[1:]
            least = best[0]
    return [min(CLIP, d) for d in best[::-1]]


def contents(toxic: list[str], ordinary: list[str], size: int) -> tuple[bytes, bytes]:
    """Dictionary contents from words, best first; the best stand last, where references are shortest."""
    bad = expanded((" " + " ".join(reversed(toxic[:size])) + " ").encode())
    usual = expanded((" " + " ".join(reversed(ordinary)) + " ").encode())
    return bad, usual[-len(bad) :].rjust(len(bad), b" ")


def ranked_words(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words by contrast between toxic and ordinary rows (y), and longer ordinary words by number of documents."""
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(r"[^\x00-\x60\x7B-\x7F]+"), F.lit(0)))
    counts = rows.select("y", F.explode(words).alias("w")).groupBy("w").agg(
        F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("usual")
    )
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    bad, usual = float(n.get(1, 0)), float(n.get(0, 0))
    if not bad or not usual:
        return [], []
    p = (F.col("bad") + F.col("usual") + 0.5) / (bad + usual + 1)
    z = (F.col("bad") / bad - F.col("usual") / usual) / F.sqrt(p * (1 - p) * (1 / bad + 1 / usual))
    least = F.when(F.octet_length("w") < MIN_MATCH, SHORT_Z).otherwise(0.0)
    by_contrast = counts.where("bad > 2").select("w", z.alias("z")).where(F.col("z") > least).orderBy(F.desc("z"), "w").limit(max(SIZES))
    longer = (F.col("usual") > 0) & (F.octet_length("w") >= MIN_MATCH)
    by_number = counts.where(longer).orderBy(F.desc("usual"), "w").limit(FILL)
    return [r["w"] for r in by_contrast.collect()], [r["w"] for r in by_number.collect()]


def curve_inputs(distances: np.ndarray) -> np.ndarray:
    """The distances, steps at the lengths of one short and one long word for the two largest, and 1."""
    steps = [distances[:, i] >= at for i in (0, 1) for at in (3, 4, 5)]
    return np.column_stack([distances, *steps, np.ones(len(distances))])


def probability(distances: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve_inputs(distances) @ weights, -30, 30)))


def logistic(distances: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of the curve's inputs: Newton steps on the weighted log likelihood with a small ridge."""
    x = curve_inputs(distances)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2) -> Model | None:
    """Dictionaries of all training rows; their size and the curve from rows that the dictionaries have not seen.

    Words ranked on either half of the rows make dictionaries that are tried on the other half.
    """
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", folds, left_out, TRAIN_ROWS)
    rows = cut_lineage(rows.repartition(F.col("h")))
    ranked = [ranked_words(rows.where(F.pmod("h", F.lit(2)) != half)) for half in (0, 1)]
    whole = ranked_words(rows)
    if not (whole[0] and ranked[0][0] and ranked[1][0]):
        return None
    pairs = docs.sparkSession.sparkContext.broadcast([[contents(*r, size) for size in SIZES] for r in ranked])

    @F.pandas_udf("array<double>")
    def tried(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        both = [[(compressor(t), compressor(o)) for t, o in of_half] for of_half in pairs.value]
        for texts, halves in batches:
            yield pd.Series([
                [d for t, o in both[half] for d in largest_distances(text, t, o)] for text, half in zip(texts, halves)
            ])
        forget()

    # At most twice TRAIN_ROWS rows of a few numbers come to the driver.
    found = rows.select("y", tried("text", F.pmod("h", F.lit(2)).cast("int")).alias("d")).toPandas()
    y = found["y"].to_numpy(float)
    share = labels.where(fold(F.col("doc_id"), folds) != left_out).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.5
    have = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, share / have, (1 - share) / (1 - have))
    x = np.array(found["d"].tolist(), float).reshape(len(y), len(SIZES), TOP)
    best = None
    for k, size in enumerate(SIZES):
        w = logistic(x[:, k], y, weight)
        p = probability(x[:, k], w)
        loss = -(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()
        if best is None or loss < best[0]:
            best = loss, Model(*contents(*whole, size), tuple(w))
    return best[1]


def toxicity(text: Column, spark, model: Model | None) -> Column:
    """Score from 0 to 1 of a text column."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        t, o = compressor(m.toxic), compressor(m.ordinary)
        for texts in batches:
            x = np.array([largest_distances(text, t, o) for text in texts], float).reshape(len(texts), TOP)
            yield pd.Series(probability(x, np.array(m.weights)))
        forget()

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    ship(docs.sparkSession)
    model = train(docs, labels, folds, left_out)
    scored = docs.select(
        "doc_id", (fold(F.col("doc_id"), folds) == left_out).alias("held_out"),
        toxicity(F.col("text"), docs.sparkSession, model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    ship(docs.sparkSession)
    model = train(docs, labels)
    return docs.where(toxicity(F.col("text"), docs.sparkSession, model) < DECISION)
