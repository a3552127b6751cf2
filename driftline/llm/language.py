"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary that consist of small letters, with or without
the mark of a word's start. Each language has a probability for each piece. The probability of a
word is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities;
a forward pass over the word gives it. Pieces do not cross words, so a text's probability is the
product over its words, each of which is worked out once and remembered.

The probabilities are learned by expectation maximisation from training documents (a bounded
sample: ``TRAIN_DOCS`` of each language, those with the smallest hash of their id): expected
counts of pieces in all segmentations, by a forward and a backward pass, summed by Spark over all
words, smoothed with the counts of all languages together.

Words are runs of letters in lower case; runs longer than ``LONGEST`` are parted after so many
letters, none is left out. A letter that no piece holds counts alike for all languages. The score
is the posterior probability of the predicted language among those learned, which all have the
same prior; of equal ones the first by name is predicted. Null texts, texts without letters, and
all texts if there is nothing to learn from, give ``und`` and score 0. Rows are predicted one by
one; lang, source and doc_id are no input of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import fold, give_back, ship
from driftline.session import cut_lineage

TRAIN_DOCS, ROUNDS = 600, 2
LONGEST, REMEMBERED, TEXT_BLOCK = 32, 300_000, 1_000_000
#: Words whose segmentations are in memory at a time: some 5 KB each.
AT_ONCE = 2_000
#: Weight of the shared counts, and probability of a letter outside the vocabulary.
SMOOTH, UNKNOWN = 500.0, 1e-7
UNDEFINED, CONFIDENT = "und", 0.5

WORD = re.compile(r"[^\W\d_]+")
START = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.vocab_size()))
    return [p for p in every if p == p.lower() and (p.removeprefix(START).isalpha() or p == START)]


def words(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Segmenter:
    """All segmentations of many words at once."""

    def __init__(self, vocabulary: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(vocabulary):
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.unknown = len(vocabulary)

    def edges(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every place where a piece stands, by end; and the words' lengths.

        Every letter has a piece: one outside the vocabulary has the piece ``unknown``.
        """
        flat: list[tuple[int, int, int, int]] = []
        lengths = np.empty(len(batch), np.int64)
        for w, word in enumerate(batch):
            marked = START + word
            n = lengths[w] = len(marked)
            alone = 0
            for end, (piece, size) in self.automaton.iter(marked):
                end += 1
                flat.append((end, w, end - size, piece))
                if size == 1:
                    alone += 1
            if alone < n:
                known = {e for e, v, s, _ in flat[-n * 20 :] if v == w and e - s == 1}
                flat += [(e, w, e - 1, self.unknown) for e in range(1, n + 1) if e not in known]
        table = np.array(flat, np.int64).reshape(-1, 4)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        return table[:, 1], table[:, 2], table[:, 0], table[:, 3], lengths

    def forward(self, batch: list[str], probabilities: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        word, start, end, piece, lengths = self.edges(batch)
        alpha = self._alpha(word, start, end, piece, lengths, probabilities)
        return np.log(np.maximum(alpha[np.arange(len(batch)), lengths], 1e-300))

    @staticmethod
    def _alpha(word, start, end, piece, lengths, probabilities) -> np.ndarray:
        alpha = np.zeros((len(lengths), lengths.max(initial=0) + 1, probabilities.shape[1]))
        alpha[:, 0] = 1.0
        bounds = np.searchsorted(end, np.arange(1, lengths.max(initial=0) + 2))
        for e in range(1, lengths.max(initial=0) + 1):
            here = slice(bounds[e - 1], bounds[e])
            w = word[here]
            if len(w):
                terms = alpha[w, start[here]] * probabilities[piece[here]]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                alpha[w[first], e] = np.add.reduceat(terms, first, axis=0)
        return alpha

    def expected(self, batch: list[str], counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        """Expected number of each piece in all segmentations of words that stand so often."""
        word, start, end, piece, lengths = self.edges(batch)
        alpha = self._alpha(word, start, end, piece, lengths, probabilities)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(batch)), lengths] = 1.0
        bounds = np.searchsorted(end, np.arange(1, lengths.max(initial=0) + 2))
        for e in range(lengths.max(initial=0), 0, -1):
            here = slice(bounds[e - 1], bounds[e])
            np.add.at(beta, (word[here], start[here]), beta[word[here], end[here]] * probabilities[piece[here]])
        total = np.maximum(alpha[np.arange(len(batch)), lengths], 1e-300)
        share = alpha[word, start] * probabilities[piece] * beta[word, end] / total[word]
        return np.bincount(piece, (share[:, 0] * counts[word]), minlength=self.unknown + 1)


class Model:
    """Languages by name, pieces, and a probability for each piece (the last: unknown) and language."""

    def __init__(self, languages: list[str], vocabulary: list[str], probabilities: np.ndarray):
        self.languages, self.vocabulary, self.probabilities = languages, vocabulary, probabilities


def training_words(docs: DataFrame, folds: int, left_out: int) -> DataFrame:
    """lang, word, n over the bounded sample."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != left_out))
    drawn = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= TRAIN_DOCS)
    picked = cut_lineage(picked.select("doc_id", F.col("lang").alias("of")).distinct())
    # TRAIN_DOCS ids for each language at most.
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id"]).where("lang = of")

    @F.pandas_udf("array<string>")
    def parted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield found.map(words)
        give_back()

    each = texts.select("lang", F.explode(parted(F.coalesce("text", F.lit("")))).alias("word"))
    return each.groupBy("lang", "word").agg(F.count("*").alias("n"))


def train(docs: DataFrame, folds: int = 5, left_out: int = 0, path: str | None = None) -> Model | None:
    ship(docs.sparkSession)
    spark = docs.sparkSession
    vocabulary = pieces(path or default_path())
    counted = cut_lineage(training_words(docs, folds, left_out))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return None
    size = len(vocabulary)
    probabilities = np.full((size + 1, len(languages)), 1.0 / size)
    probabilities[size] = UNKNOWN
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, languages, probabilities))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, langs, p = shared.value
            segmenter = Segmenter(names)
            for batch in batches:
                for lang, rows in batch.groupby("lang"):
                    found = np.zeros(len(names) + 1)
                    for at in range(0, len(rows), AT_ONCE):
                        some = rows.iloc[at : at + AT_ONCE]
                        found += segmenter.expected(some["word"].tolist(), some["n"].to_numpy(float), p[:, [langs.index(lang)]])
                    hit = np.flatnonzero(found)
                    yield pd.DataFrame({"lang": lang, "piece": hit, "n": found[hit]})
            del segmenter
            give_back()

        # A number for each language and piece of the fixed vocabulary comes to the driver.
        summed = counted.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size + 1, len(languages)))
        counts[summed["piece"], [languages.index(x) for x in summed["lang"]]] = summed["n"]
        counts = counts[:size]
        every = counts.sum(axis=1) + 0.01
        every /= every.sum()
        probabilities = np.vstack([
            (counts + SMOOTH * every[:, None]) / (counts.sum(axis=0) + SMOOTH), np.full((1, len(languages)), UNKNOWN)
        ])
    return Model(languages, vocabulary, probabilities)


class Scorer:
    """Sums of the log probabilities of a text's words; a word once worked out is remembered."""

    def __init__(self, model: Model):
        self.model, self.segmenter = model, Segmenter(model.vocabulary)
        self.place: dict[str, int] = {}
        self.known = np.empty((0, len(model.languages)))

    def block(self, texts: list[str]) -> np.ndarray:
        parted = [words(t) for t in texts]
        parted = [w if any(c.isalpha() for v in w for c in v) else [] for w in parted]
        new = list({w for found in parted for w in found if w not in self.place})
        if len(self.place) + len(new) > REMEMBERED and self.place:
            self.place, self.known = {}, self.known[:0]
            new = list({w for found in parted for w in found})
        found = []
        for at in range(0, len(new), AT_ONCE):
            found.append(self.segmenter.forward(new[at : at + AT_ONCE], self.model.probabilities))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.known = np.vstack([self.known, *found])
        sums = np.full((len(texts), len(self.model.languages)), np.nan)
        for i, found in enumerate(parted):
            if found:
                sums[i] = self.known[np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))].sum(axis=0)
        return sums

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        sums, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= TEXT_BLOCK):
                size += len(texts[end]) + 1
                end += 1
            sums.append(self.block(texts[at:end]))
            at = end
        both = np.vstack(sums) if sums else np.empty((0, len(self.model.languages)))
        none = np.isnan(both).all(axis=1)
        both[none] = 0.0
        best = both.argmax(axis=1)
        posterior = 1.0 / np.exp(both - both.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.array([*self.model.languages, UNDEFINED], object)
        return pd.DataFrame({
            "lang_pred": names[np.where(none, len(names) - 1, best)], "score": np.where(none, 0.0, posterior)
        })


def identify(text: Column, spark, model: Model | None) -> Column:
    """Struct of lang_pred and score."""
    if model is None:
        return F.struct(F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield scorer(texts.tolist())
        del scorer
        give_back()

    return predict(F.coalesce(text, F.lit("")))


def predict_language(docs: DataFrame, folds: int = 5, left_out: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    ship(docs.sparkSession)
    model = train(docs, folds, left_out, path)
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), folds) == left_out).alias("held_out"),
        identify(F.col("text"), docs.sparkSession, model).alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def drop_unclear(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with a language told with some confidence, with all their columns."""
    ship(docs.sparkSession)
    model = train(docs, path=path)
    names = docs.columns
    told = docs.select(F.struct("*").alias("doc"), identify(F.col("text"), docs.sparkSession, model).alias("p"))
    kept = told.where((F.col("p.lang_pred") != UNDEFINED) & (F.col("p.score") >= CONFIDENT))
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
