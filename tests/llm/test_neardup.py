"""Near-duplicates against brute force."""

import random
import re

import numpy as np

from driftline.llm import neardup
from driftline.llm.queries import QUERIES
from tests.llm import cases


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def brute(ids, texts, percent=85):
    sets, parent = brute_sets(texts), {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def compare(spark, ids, texts):
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    want = brute(ids, texts)
    assert len(got) == len(ids)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(draw, text, copies, most):
    """Copies with 0 to ``most`` words changed: some are near each other, all are near few."""
    for _ in range(copies):
        w = text.split()
        for at in draw.sample(range(len(w)), draw.randint(0, most)):
            w[at] = f"new{draw.randint(0, 10**6)}"
        yield " ".join(w)


def test_families_of_near_copies(spark):
    draw = random.Random(5)
    texts = cases.sentences(2, 60)
    for long in cases.sentences(3, 3, 5000):
        texts += family(draw, " ".join([long] * 1 + cases.sentences(draw.randint(0, 99), 3, 5000)), 60, 5)
    for short in ("a b c d e f g h", "one two", "x y z w v u"):
        texts += [short, short.upper(), short + "  ", short + " more"]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    compare(spark, ids, texts)


def private_edits(draw, copies, words, edits, shared):
    """Texts of one base with ``edits`` words changed in each, most pairs just below the limit; ``shared`` pairs are near."""
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(words)]
    texts = []
    for k in range(copies):
        near = k % shared == 1
        w = texts[-1].split() if near else list(base)
        for at in draw.sample(range(words), 2 if near else edits):
            w[at] = f"new{draw.randint(0, 10**9)}"
        texts.append(" ".join(w))
    return texts


def test_sparse_links_in_a_large_family_are_all_found(spark):
    """Most pairs of a family of 300 stand below the limit; each of the few links is found, in blocks of any size."""
    draw = random.Random(31)
    texts = private_edits(draw, 300, 400, 9, 10)
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    compare(spark, ids, texts)


def test_blocks_of_the_rest(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 4000)
    draw = random.Random(32)
    texts = private_edits(draw, 120, 300, 7, 6) + private_edits(draw, 60, 40, 1, 6) + cases.sentences(33, 20)
    compare(spark, list(range(len(texts))), texts)


def test_links_between_similar_and_unlike_pairs_need_no_star(spark):
    """What the stars decide is not needed: with every link taken away the rest alone finds all components."""
    draw = random.Random(34)
    texts = private_edits(draw, 90, 300, 2, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(
        docs["doc_id"].alias("class"), "text", neardup.sketch(docs["text"], 5, neardup.BINS, neardup.ROWS).alias("s")
    ).selectExpr("class", "text", "s.n_shingles AS size", "s.bands AS bands")
    shared = neardup.shared_buckets(rows.selectExpr("class", "explode(bands) AS key"))
    still = neardup.open_rows(shared, spark.createDataFrame([], "class long, root long"))
    dealt = neardup.blocks(still.join(rows.drop("text"), "class"))
    pairs = neardup.undecided(dealt, 85, neardup.fewest_shared(85, neardup.BINS, neardup.ROWS))
    found = [(r.a, r.b) for r in neardup.confirmed_links(pairs, rows.select("class", "text"), 5, 85).collect()]
    assert len(found) == len(set(found))
    sets = brute_sets(texts)
    want = {(a, b) for b in range(90) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    sizes = {r.key: r.n for r in shared.select("key", "n").distinct().collect()}
    keys = {r["class"]: r.bands for r in rows.collect()}

    def first_shared(a, b):
        return next((sizes[k] for k, m in zip(keys[a], keys[b]) if k == m), 0)

    assert {tuple(sorted(p)) for p in found} == {p for p in want if first_shared(*p) > neardup.ALL_PAIRS}
    assert len(found) > 10


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(240)]
    texts = [" ".join(words[i * 3 : i * 3 + 150]) for i in range(30)]
    compare(spark, list(range(30)), texts)


def test_driver_table(spark):
    rows = spark.read.parquet(f"{cases.SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_near_duplicates"](spark, cases.SMALL).collect()}
    assert got == brute([r.doc_id for r in rows], [r.text for r in rows])


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    got = neardup.near_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    by_id = got.dropna(subset=["doc_id"]).groupby("doc_id")["component_id"].apply(set)
    assert by_id[16] == by_id[17] == {16} and by_id[18] == {16}
    assert by_id[5] == {5} and by_id[0] == {0} and by_id[1] == {1}
    assert (got[got["doc_id"].isin([0, 1, 2, 3])]["n_shingles"] == 0).all()
    assert got[got["doc_id"].isna()]["component_id"].isna().all() and got[got["doc_id"].isna()]["kept"].all()
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 17 not in ids and 18 not in ids and ids.count(None) == 2
    assert neardup.near_duplicates(cases.no_documents(spark)).count() == 0
    assert neardup.drop_near_duplicates(cases.no_documents(spark)).count() == 0


def test_an_id_that_stands_twice_takes_no_unrelated_text_with_it(spark):
    a, c, other = cases.sentences(21, 3, 5000)
    a2, c2 = a + " tail", c + " tail"
    rows = [(1, a), (5, a2), (5, c), (9, c2), (7, other), (7, other), (7, other.upper()), (8, ""), (8, other + " end"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    size = lambda t: len(t.split()) - 4
    assert got[1, size(a)] == (1, True) and got[5, size(a2)] == (1, False)
    assert got[5, size(c)] == (5, True) and got[9, size(c2)] == (5, False)
    assert got[7, size(other)] == (7, True) and got[8, size(other) + 1] == (7, False) and got[8, 0] == (8, True)
    left = sorted((r.doc_id, (r.text or "").lower()) for r in neardup.drop_near_duplicates(docs).collect())
    assert left == sorted([(1, a), (5, c), (7, other), (8, ""), (8, "")])


def test_stars_bound_the_pairs(spark):
    """A thousand copies with one new word each: pairs grow with the rows, not with their square."""
    draw = random.Random(9)
    texts = list(family(draw, " ".join(cases.sentences(11, 4, 5000)), 1000, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = docs.select("doc_id", neardup.sketch(docs["text"], 5, neardup.BINS, neardup.ROWS).alias("s"))
    bands = classes.selectExpr("doc_id AS class", "explode(s.bands) AS key")
    assert neardup.candidate_pairs(bands).count() < 40 * len(texts)


def test_densified_bins_agree_as_often_as_sets():
    draw = np.random.default_rng(1)
    rates = []
    for seed in range(300):
        shared, own = draw.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64), draw.integers(0, 2**63, 20, dtype=np.int64).view(np.uint64)
        a, b = np.unique(np.concatenate([shared, own[:10]])), np.unique(np.concatenate([shared, own[10:]]))
        rates.append((neardup.signature(a, 252, seed) == neardup.signature(b, 252, seed)).mean())
    assert abs(np.mean(rates) - 40 / 60) < 0.02
