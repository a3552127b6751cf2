"""Language, toxicity and quality: sums by brute force, held-out accuracy, awkward rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from driftline.llm import language, quality, toxicity
from driftline.llm.queries import QUERIES
from tests.llm import cases


def all_segmentations(marked: str, known: dict[str, float], unknown: float) -> float:
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        parts, at = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(marked[at:i])
                at = i
        parts.append(marked[at:])
        p = 1.0
        for part in parts:
            p *= known.get(part, unknown if len(part) == 1 else 0.0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bb"]
    p = np.linspace(0.02, 0.2, len(vocabulary))
    both = np.vstack([np.column_stack([p, p[::-1]]), [[1e-7, 1e-7]]])
    words = ["abab", "bba", "a", "acb", "ccc", "aaaa"]
    got = language.Segmenter(vocabulary).forward(words, both)
    for i, w in enumerate(words):
        for j in (0, 1):
            want = all_segmentations("▁" + w, dict(zip(vocabulary, both[:, j])), 1e-7)
            assert math.isclose(math.exp(got[i, j]), want, rel_tol=1e-9)


def test_expected_counts_by_brute_force():
    vocabulary = ["▁", "a", "b", "ab"]
    p = np.array([[0.3], [0.2], [0.1], [0.4], [1e-7]])
    got = language.Segmenter(vocabulary).expected(["ab", "b"], np.array([2.0, 1.0]), p)
    whole, cut = 0.3 * 0.4, 0.3 * 0.2 * 0.1
    share = whole / (whole + cut)
    assert np.allclose(got, [3, 2 * (1 - share), 2 * (1 - share) + 1, 2 * share, 0])


def held_out(doc_id, folds, left_out):
    return zlib.crc32(str(doc_id).encode()) % folds == left_out


@pytest.mark.parametrize("name", ["op5_language", "op6_toxicity", "op9_quality"])
def test_every_row_once_and_folds(spark, name):
    got = QUERIES[name](spark, cases.LARGER).toPandas()
    docs = spark.read.parquet(f"{cases.LARGER}/documents.parquet").select("doc_id", "lang").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    folds, left_out = (5, 0) if name == "op5_language" else (4, 2)
    assert all(h == held_out(d, folds, left_out) for d, h in zip(got["doc_id"], got["held_out"]))
    assert got["score"].between(0, 1).all()
    unseen = got[got["held_out"]]
    if name == "op5_language":
        m = unseen.merge(docs, on="doc_id").dropna(subset=["lang"])
        assert (m["lang_pred"] == m["lang"]).mean() > 0.97
        return
    label = name.partition("_")[2].replace("toxicity", "toxic")
    labels = spark.read.parquet(f"{cases.LARGER}/labels.parquet").toPandas()
    m = unseen.merge(labels, on="doc_id")
    rank = m["score"].rank()
    ones, zeros = (m[label] == 1).sum(), (m[label] == 0).sum()
    auc = (rank[m[label] == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
    # The few toxic rows of this table teach only the words of one language.
    assert auc > (0.9 if label == "quality" else 0.75) and (m["predicted"] == m[label]).mean() > 0.9
    assert (got["predicted"] == (got["score"] >= (0.3 if label == "toxic" else 0.7))).all()


def test_toxicity_held_out(spark):
    """In this table only some of the toxic texts show that they are."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    m = toxicity.score_toxicity(docs, labels).where("held_out").toPandas().merge(labels.toPandas(), on="doc_id")
    assert m[m["toxic"] == 1]["predicted"].mean() > 0.55 and m[m["toxic"] == 0]["predicted"].mean() < 0.06


def awkward_labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(19)] + [(3, 1, 0), (None, 1, 1), (4, None, None), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    ).selectExpr("*", "'x' AS text", "'x' AS score")


def test_awkward_rows(spark):
    docs, labels = cases.documents(spark), awkward_labels(spark)
    n = docs.count()
    spoken = language.predict_language(docs).toPandas()
    assert len(spoken) == n
    silent = spoken[spoken["doc_id"].isin([0, 1, 2, 3, 13, 14])]
    assert (silent["lang_pred"] == "und").all() and (silent["score"] == 0).all()
    assert (spoken[spoken["doc_id"] == 9]["lang_pred"] != "und").all()
    for scored in (toxicity.score_toxicity(docs, labels), quality.score_quality(docs, labels)):
        scored = scored.toPandas()
        assert len(scored) == n and scored["score"].between(0, 1).all()
    assert language.drop_unclear(docs).columns == docs.columns == toxicity.drop_toxic(docs, labels).columns


def test_empty_tables(spark):
    docs, none = cases.documents(spark), cases.no_documents(spark)
    labels, no_labels = awkward_labels(spark), awkward_labels(spark).limit(0)
    for d, ls in ((none, labels), (none, no_labels)):
        assert language.predict_language(d).count() == 0
        assert toxicity.score_toxicity(d, ls).count() == 0 and quality.score_quality(d, ls).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, no_labels).collect()} == {0.0}
    assert {r.score for r in quality.score_quality(docs, no_labels).collect()} == {0.5}
    assert {r.lang_pred for r in language.predict_language(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_windows_hold_the_whole_text():
    for text in ("", "a", "ab " * 200, "x" * 1000, " lead", "ü" * 300 + " end", "a  b" * 40):
        joined = b" ".join(toxicity.windows(text))
        assert joined.replace(b" ", b"") == text.encode().lower().replace(b" ", b"")


def test_toxic_words_lengthen_distance():
    bad, usual = toxicity.contents(["vilest", "rotten", "wretched"], ["table", "window", "garden", "house"], 3)
    t, o = toxicity.compressor(bad), toxicity.compressor(usual)
    assert toxicity.largest_distances("what a rotten wretched thing to say of them", t, o)[0] >= 4
    assert toxicity.largest_distances("what a quiet pleasant thing to say of them", t, o)[0] <= 1


def test_every_learned_word_gives_a_match():
    words = ["scum", "clown", "moron", "rat", "pig", "stupid", "ñu", "trash", "worthless"]
    bad, usual = toxicity.contents(words, ["between", "gardens", "windows", "another"], len(words))
    t, o = toxicity.compressor(bad), toxicity.compressor(usual)
    for w in words:
        for text in (w, f"{w}.", f"({w})", f"a quiet\n{w}\nthing to say", f"what a {w}, they say", "i a o u e x y " * 3 + w, f"stupid {w}!"):
            assert toxicity.largest_distances(text, t, o)[0] >= 3, text
    for text in ("scumble", "a clo wn", "what a quiet thing", "pigs rats", ""):
        assert toxicity.largest_distances(text, t, o)[0] <= 1, text


def test_ftrl_learns_and_continues():
    draw = np.random.default_rng(0)
    rows = [draw.integers(0, 50, 20) + (50 if y else 0) for y in (draw.random(400) < 0.5)]
    labels = [int(r[0] >= 50) for r in rows]
    w, b, met = quality.ftrl(rows, labels, np.zeros(128), 0.0)
    right = [(b + w[r].mean() * quality.SCALE > 0) == bool(y) for r, y in zip(rows, labels)]
    assert np.mean(right) > 0.98 and met[:100].all() and not met[100:].any()
    same, bias, _ = quality.ftrl([], [], w, b)
    assert np.allclose(same, w, atol=1e-4) and math.isclose(bias, b, abs_tol=1e-4)


def test_predictions_do_not_depend_on_other_columns(spark):
    docs = spark.read.parquet(f"{cases.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{cases.SMALL}/labels.parquet")
    model = toxicity.train(docs, labels)
    swapped = docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'zz' AS lang", "'q' AS source")
    a = docs.select("doc_id", toxicity.toxicity(docs["text"], spark, model).alias("s")).toPandas()
    b = swapped.select("doc_id", toxicity.toxicity(swapped["text"], spark, model).alias("s")).toPandas()
    merged = pd.merge(a, b.assign(doc_id=b["doc_id"] - 1000000), on="doc_id")
    assert (merged["s_x"] == merged["s_y"]).all()


def test_language_memory_of_many_new_words():
    """Words never met before take their segmentations' memory a few at a time; scores are the same."""
    import tracemalloc

    draw = random.Random(4)
    vocabulary = language.pieces(language.default_path())
    chances = np.random.default_rng(1).random((len(vocabulary) + 1, 4)) / len(vocabulary)
    new = sorted({"".join(draw.choice("abcdefghinorst") for _ in range(draw.randint(8, 14))) for _ in range(20_000)})
    scorer = language.Scorer(language.Model(list("abcd"), vocabulary, chances))
    tracemalloc.start()
    got = scorer.block([" ".join(new)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    assert np.allclose(got[0], scorer.segmenter.forward(new, chances).sum(axis=0))


def test_toxicity_forgets_words_after_a_task():
    toxicity.expanded(b" some of a few short words ")
    assert toxicity._padded.cache_info().currsize
    toxicity.forget()
    assert not toxicity._padded.cache_info().currsize
