"""The corpus pipeline, stage by stage on each stage's own input."""

import random
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from driftline.llm import bpe, language, mixing, toxicity
from driftline.llm.common import read, written
from tests.llm import cases
from tests.llm.test_neardup import brute, brute_sets, family


def test_stages(spark):
    docs = read(spark, cases.SMALL, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_near_dedup", "mixing", "bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, cases.SMALL), name)
        kept[name] = (docs.toPandas(), out.toPandas())
        if name != "bpe":
            assert out.columns == columns
        docs = out

    before, after = kept["toxicity"]
    labels = read(spark, cases.SMALL, "labels")
    scored = toxicity.score_toxicity(read(spark, cases.SMALL, "documents"), labels).toPandas()
    assert set(after["doc_id"]) == set(scored[scored["predicted"] == 0]["doc_id"])
    # Eleven toxic rows teach little; test_models holds how many are found in a larger table.
    clean = set(labels.where("toxic = 0").toPandas()["doc_id"])
    assert len(clean & set(after["doc_id"])) >= 0.95 * len(clean)

    before, after = kept["language_id"]
    assert len(after) >= 0.98 * before["text"].notna().sum()

    before, after = kept["minhash_near_dedup"]
    groups = brute(before["doc_id"].tolist(), before["text"].tolist(), corpus_pipeline.NEAR_PERCENT)
    assert set(after["doc_id"]) == {i for i, (_, root) in groups.items() if i == root} and len(after) == after["doc_id"].nunique()

    before, after = kept["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = before.assign(n=before["text"].map(size)).groupby(before["source"].fillna("-"))["n"].sum()
    taken = after.assign(n=after["text"].map(size)).groupby(after["source"].fillna("-"))["n"].sum()
    assert abs(taken.sum() - 1.5 * sizes.sum()) <= len(sizes)
    texts = dict(zip(before["doc_id"], before["text"]))
    assert all(texts[d].startswith(t) for d, t in zip(after["doc_id"], after["text"]))

    before, after = kept["bpe"]
    library = Tokenizer.from_file(bpe.default_path())
    want = sorted((d, library.encode(t, add_special_tokens=False).ids) for d, t in zip(before["doc_id"], before["text"]))
    assert sorted((d, np.frombuffer(i, "<u4").tolist()) for d, i in zip(after["doc_id"], after["ids"])) == want


def test_near_copies_at_80_go(spark):
    """Families with similarities on both sides of 0.8, against a brute force at 0.8."""
    draw = random.Random(4)
    texts = []
    for seed in range(12):
        texts += family(draw, " ".join(cases.sentences(seed, 4, 5000)), 12, 4)
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    sets, root = brute_sets(texts), list(range(len(texts)))
    links = [(a, b) for a in root for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in links)
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, "").toPandas()
    assert sorted(kept["doc_id"]) == [i for i, r in enumerate(root) if i == r]


def test_awkward_documents_go_through(spark, tmp_path):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert name == "bpe" or docs.columns == columns
    none = cases.no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, str(tmp_path)), name)
        assert none.count() == 0
