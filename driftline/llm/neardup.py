"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, stars.

A document's set is its distinct shingles of ``width`` words. Each shingle is hashed once; the
hash picks one of ``bins`` bins, and a bin keeps its smallest value. Empty bins borrow from a bin
that a hash of (bin, attempt) names, tried until a full one is met, so that two sets agree in a
bin with a probability equal to their similarity. Bands of ``rows`` bins are bucket keys. Small
sets fill few bins and their estimate scatters; they get the bands of further seeds too.

Copies of a set are one class from the start, told by a 128-bit sum over the set. In each bucket
of classes the star has two centres, so pairs are at most twice the bucket's rows: the class that
stands in the largest buckets over all its bands (the least edited text of a family), and the
class that a hash draws. A bucket with no more than ``ALL_PAIRS`` classes is compared in full.
Candidate pairs are confirmed on the full sets: ``100 * |A and B| >= percent * |A or B|``.
Components come from label propagation with pointer jumps over the confirmed links.

The stars alone would lose links in families whose texts are seldom similar enough, so the rest
is exact: in each larger bucket that still holds several components, every class outside the
bucket's largest component is held against every class of another component there, in blocks of
bounded size. A pair counts in the first bucket that it shares only; sizes and the number of bands
shared rule most pairs out before any text moves. So no two sets that share a bucket stay apart
without having been compared.

A document without words or without text has an empty set and is linked with nothing. One with
fewer words than ``width`` has its whole sequence as its one shingle. Rows that repeat a doc_id
are one document if their sets are equal; otherwise each set is linked on its own and each row
carries the component of its own set: sets are classes by their own numbers, which become doc_ids
at the very end. A row without doc_id takes no part: component_id is null and kept true. Only
doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import give_back, ship, written
from driftline.session import cut_lineage

WIDTH, PERCENT = 5, 85
BINS, ROWS = 252, 6
#: Sets smaller than this get the bands of ``SEEDS`` permutations, larger ones of the first only.
SMALL_SET, SEEDS = 96, 3
#: Buckets of up to so many classes are compared pair by pair, larger ones as two stars.
ALL_PAIRS = 4
#: The rest goes in blocks of about so many classes and shingles, whichever fills up first.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: A pair is ruled out by its shared bands where similar sets share as few with this probability at most.
UNLIKELY = 1e-5

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class WordHashes(dict):
    """Hash of a word by the word, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z in lower case, words parted by ASCII white space."""
    split = text.encode().lower().split()
    n = len(split)
    words = np.fromiter(map(known.__getitem__, split), U, n)
    if n == 0:
        return words
    count = max(1, n - width + 1)
    with np.errstate(over="ignore"):
        rolled = np.full(count, n if n < width else width, U)
        for k in range(min(n, width)):
            rolled = _mix(rolled * U(0x9E3779B97F4A7C15) + words[k : k + count])
    return np.unique(rolled)


@lru_cache(maxsize=4)
def _donors(bins: int, attempts: int = 64) -> np.ndarray:
    """For each bin the bins that it borrows from, in order."""
    at = np.arange(bins, dtype=U)[:, None] * U(attempts) + np.arange(attempts, dtype=U)[None, :]
    return (_mix(at + U(0x5851F42D4C957F2D)) % U(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """One value for each bin, all bins full."""
    with np.errstate(over="ignore"):
        hashed = _mix(shingles + U(seed) * U(0xD1342543DE82EF95))
    hashed.sort()
    place = (((hashed >> U(32)) * U(bins)) >> U(32)).astype(np.int64)  # rises with the hash
    first = np.flatnonzero(np.diff(place, prepend=-1))
    empty = U(0xFFFFFFFFFFFFFFFF)
    values = np.full(bins, empty, U)
    values[place[first]] = hashed[first]
    full = values != empty
    if full.all():
        return values
    donors = _donors(bins)
    got = full[donors]
    first = got.argmax(axis=1)
    from_bin = donors[np.arange(bins), first]
    from_bin[~got.any(axis=1)] = np.flatnonzero(full)[0]
    return np.where(full, values, values[from_bin])


def band_keys(shingles: np.ndarray, bins: int, rows: int) -> np.ndarray:
    seeds = SEEDS if len(shingles) < SMALL_SET else 1
    keys = []
    for seed in range(seeds):
        values = signature(shingles, bins, seed).reshape(-1, rows)
        with np.errstate(over="ignore"):
            key = np.arange(len(values), dtype=U) + U(1000 * seed)
            for r in range(rows):
                key = _mix(key * U(0x9E3779B97F4A7C15) + values[:, r])
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def sketch(text: Column, width: int, bins: int, rows: int) -> Column:
    """Struct: n_shingles, whole (two longs that tell the set), bands (keys)."""

    @F.pandas_udf("n_shingles long, whole array<long>, bands array<long>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for texts in batches:
            out = []
            for t in texts:
                s = shingle_set(t, width, known)
                if not len(s):
                    out.append((0, None, None))
                    continue
                with np.errstate(over="ignore"):
                    whole = [int(_mix(s + U(k)).sum(dtype=U).astype(np.int64)) for k in (11, 23)]
                out.append((len(s), whole, band_keys(s, bins, rows)))
            yield pd.DataFrame(out, columns=["n_shingles", "whole", "bands"])
        known.clear()
        give_back()

    return sketched(F.coalesce(text, F.lit("")))


def similar(percent: int, width: int, a: Column, b: Column) -> Column:
    """Whether two texts' full sets are similar enough."""

    @F.pandas_udf("boolean")
    def confirmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = WordHashes()
        kept: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            s = kept.get(text)
            if s is None:
                if len(kept) > 200:
                    kept.clear()
                s = kept[text] = shingle_set(text, width, known)
            return s

        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                p, q = of(x), of(y)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    out.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pd.Series(out, dtype=bool)
        known.clear()
        kept.clear()
        give_back()

    return confirmed(a, b)


def shared_buckets(bands: DataFrame) -> DataFrame:
    """Rows (class, key) of buckets with several classes, and the bucket's size ``n``."""
    counts = cut_lineage(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return cut_lineage(bands.join(counts, "key"))


def candidate_pairs(bands: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes from rows (class, key): stars in each bucket, no pair listed twice."""
    return star_pairs(shared_buckets(bands))


def star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes from ``shared_buckets``: stars in each bucket, no pair listed twice.

    The most central class of a bucket is found by sums of bucket sizes, the drawn one by a hash
    of class and bucket; both are minima with partial results, so a hot bucket meets in no task.
    """
    weight = shared.groupBy("class").agg(F.sum("n").alias("weight"))
    placed = shared.join(weight, "class")
    drawn = F.xxhash64("class", "key")
    centres = placed.groupBy("key").agg(
        F.max(F.struct("weight", F.col("class").alias("c")))["c"].alias("central"),
        F.min(F.struct(drawn.alias("d"), F.col("class").alias("c")))["c"].alias("drawn"),
    )
    stars = shared.join(cut_lineage(centres), "key").select(
        "class", F.explode(F.array_distinct(F.array("central", "drawn"))).alias("centre")
    )
    small = shared.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.collect_set("class").alias("classes"))
    small = small.select("classes", F.explode("classes").alias("class")).select(
        "class", F.explode("classes").alias("centre")
    )
    pairs = stars.unionByName(small).where("class <> centre")
    return pairs.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(class, root) for every class with a link: the smallest class that can be reached.

    Each round a class takes the smallest root among itself and its neighbours, then the root of
    that root, so paths halve; the state is written after each round and the loop ends when no
    root changes. All groups of neighbours are reduced to minima, so none meets in a task.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).toDF("class", "other").distinct())
    state = cut_lineage(both.groupBy("class").agg(F.min("other").alias("m")).select("class", F.least("class", "m").alias("root")))
    while True:
        near = both.join(state.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.min("root").alias("near"))
        hooked = state.join(near, "class").select("class", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # The root itself follows too: the smallest root that any of its members has met.
        pulled = hooked.groupBy(F.col("was").alias("class")).agg(F.min("root").alias("pull"))
        stepped = hooked.join(pulled, "class", "left").select(
            "class", "was", F.least("root", F.coalesce("pull", "root")).alias("root")
        )
        stepped = cut_lineage(stepped)
        over = stepped.select(F.col("class").alias("root"), F.col("root").alias("above"))
        jumped = cut_lineage(stepped.join(over, "root", "left").select("class", "was", F.coalesce("above", "root").alias("root")))
        state = jumped.select("class", "root")
        if jumped.where("root <> was").isEmpty():
            return state


def fewest_shared(percent: int, bins: int, rows: int) -> int:
    """Bands that two similar sets share at least, but for a probability of ``UNLIKELY``; never below 1."""
    n, p = bins // rows, (percent / 100) ** rows
    chance, k = 0.0, 0
    while k < n:
        chance += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if chance > UNLIKELY:
            break
        k += 1
    return max(1, k)


def open_rows(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, class, root, minor): larger buckets that hold several components.

    ``minor`` classes are those outside the bucket's largest component: of two classes of a
    bucket in different components one is minor at least.
    """
    placed = shared.where(F.col("n") > ALL_PAIRS).join(roots, "class", "left")
    placed = placed.select("key", "class", F.coalesce("root", "class").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("n", "root"))["root"].alias("largest"), F.count("*").alias("several")
    )
    largest = largest.where("several > 1").select("key", "largest")
    return placed.join(largest, "key").select("key", "class", "root", (F.col("root") != F.col("largest")).alias("minor"))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``open_rows`` with size and bands, dealt to groups (key, i, j): minor block i against block j."""

    def number(taken: Column) -> Column:
        by_count = F.sum(taken.cast("long")) / BLOCK
        by_size = F.sum(F.when(taken, F.col("size")).otherwise(0)) / BLOCK_SHINGLES
        return F.ceil(F.greatest(by_count, by_size)).cast("int")

    counts = rows.groupBy("key").agg(number(F.col("minor")).alias("left"), number(F.lit(True)).alias("right"))
    dealt = rows.join(counts, "key")
    place = F.xxhash64("class", "key")
    asking = dealt.where("minor").select(
        "key", F.pmod(place, "left").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("j"),
        F.lit(True).alias("asking"), "class", "root", "minor", "size", "bands",
    )
    asked = dealt.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"),
        F.pmod(place, "right").cast("int").alias("j"),
        F.lit(False).alias("asking"), "class", "root", "minor", "size", "bands",
    )
    return asking.unionByName(asked)


def undecided(dealt: DataFrame, percent: int, fewest: int) -> DataFrame:
    """(key, i, j, a, b): for each block the pairs a[k], b[k] that sizes and bands do not rule out."""

    def matrix(bands: pd.Series, width: int, fill: int) -> np.ndarray:
        out = np.full((len(bands), width), fill, np.int64)
        for r, values in enumerate(bands):
            out[r, : len(values)] = values
        return out

    def compared(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        key, i, j = group
        q, o = rows[rows["asking"]], rows[~rows["asking"]]
        width = max(map(len, rows["bands"]))
        left, right = matrix(q["bands"], width, -1), matrix(o["bands"], width, -2)
        shape = (len(q), len(o))
        met, here, shares = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, np.int16)
        for t in range(width):
            same = left[:, t, None] == right[None, :, t]
            shares += same
            if (left[:, t] == key).any():
                here |= same & ~met & (left[:, t] == key)[:, None]
            met |= same
        x, y = q["size"].to_numpy()[:, None], o["size"].to_numpy()[None, :]
        a, b = q["class"].to_numpy(), o["class"].to_numpy()
        keep = here & (shares >= fewest) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        keep &= q["root"].to_numpy()[:, None] != o["root"].to_numpy()[None, :]
        keep &= (a[:, None] < b[None, :]) | ~o["minor"].to_numpy(bool)[None, :]
        r, c = np.nonzero(keep)
        found = [(key, i, j, a[r], b[c])] if len(r) else []
        return pd.DataFrame(found, columns=["key", "i", "j", "a", "b"])

    return dealt.groupBy("key", "i", "j").applyInPandas(compared, "key long, i int, j int, a array<long>, b array<long>")


def confirmed_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of ``undecided`` whose full sets are similar; each text moves once to a block."""

    def confirm(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = WordHashes()
        sets = {c: shingle_set(t, width, known) for c, t in zip(right["class"], right["text"])}
        known.clear()
        order = {c: k for k, c in enumerate(sets)}
        values, at = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets.values()])
        places = np.split(at, ends[:-1])
        a, b = np.concatenate(list(left["a"])), np.concatenate(list(left["b"]))
        by_a = np.argsort(a, kind="stable")
        a, b = a[by_a], b[by_a]
        mark, out = np.zeros(len(values), np.int64), []
        for first, last in _runs(a):
            own, others = places[order[a[first]]], [places[order[c]] for c in b[first:last]]
            sizes = np.array([len(p) for p in others])
            mark[own] = 1
            both = np.add.reduceat(mark[np.concatenate(others)], np.cumsum(sizes) - sizes)
            mark[own] = 0
            hit = 100 * both >= percent * (len(own) + sizes - both)
            out.append(pd.DataFrame({"a": a[first:last][hit], "b": b[first:last][hit]}))
        give_back()
        return pd.concat(out, ignore_index=True)

    named = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.concat("a", "b"))).alias("class"))
    moved = named.join(texts, "class").select("key", "i", "j", "class", "text").toDF("in_key", "in_i", "in_j", "class", "text")
    there = moved.groupBy("in_key", "in_i", "in_j")
    return pairs.groupBy("key", "i", "j").cogroup(there).applyInPandas(confirm, "a long, b long")


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return zip(starts.tolist(), [*starts[1:].tolist(), len(sorted_values)])


def judged(docs: DataFrame, width: int, percent: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, text_hash, component_id, kept: one row for each row of ``docs``."""
    ship(docs.sparkSession)
    hashed = F.xxhash64("text").alias("text_hash")
    sketched = docs.select("doc_id", hashed, sketch(F.col("text"), width, bins, rows).alias("s")).select("doc_id", "text_hash", "s.*")
    sketched = written(sketched, "sketches")
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("whole").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")
    )
    # Written, so that a class has the same number wherever it is read.
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "whole", "first", "bands", "size"), "classes")
    shared = shared_buckets(classes.select("class", F.explode("bands").alias("key")))
    pairs = cut_lineage(star_pairs(shared))

    def texts_of(asked: DataFrame, name: str) -> DataFrame:
        """Of all texts only those in a pair move, one for each class."""
        asked = classes.join(asked.distinct(), "class", "left_semi").select("class", "first.doc_id", "first.text_hash")
        texts = docs.select("doc_id", hashed, "text").join(asked, ["doc_id", "text_hash"])
        return written(texts.groupBy("class").agg(F.min("text").alias("text")), name)

    texts = texts_of(pairs.select("a").union(pairs.select("b")).toDF("class"), "texts")
    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")
    links = pairs.join(left, "a").join(right, "b").where(similar(percent, width, F.col("left"), F.col("right")))
    links = cut_lineage(links.select("a", "b"))
    roots = cut_lineage(components(links))

    # The rest of the larger buckets.
    still = cut_lineage(open_rows(shared, roots))
    if not still.isEmpty():
        dealt = blocks(still.join(classes.select("class", "size", "bands"), "class"))
        rest = written(undecided(dealt, percent, fewest_shared(percent, bins, rows)), "rest")
        if not rest.isEmpty():
            asked = texts_of(rest.select(F.explode(F.array_distinct(F.concat("a", "b"))).alias("class")), "rest_texts")
            more = cut_lineage(confirmed_links(rest, asked, width, percent))
            if not more.isEmpty():
                roots = cut_lineage(components(links.union(more)))
    # A component is called by the smallest doc_id of all its classes.
    firsts = classes.select("class", "first.doc_id")
    names = roots.join(firsts, "class").groupBy("root").agg(F.min("doc_id").alias("name"))
    named = roots.join(names, "root").select("class", "name")
    placed = classes.select("whole", "class", "first.doc_id").join(named, "class", "left").select(
        "whole", F.coalesce("name", "doc_id").alias("component_id")
    )
    joined = sketched.select("doc_id", "n_shingles", "text_hash", "whole").join(placed, "whole", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", "text_hash", component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    return judged(docs, width, percent, bins, rows).drop("text_hash")


#: Dropped rows (16 bytes each) up to which they are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def drop_near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """``docs`` with one document of each group: of those with its smallest id the one with the smallest hash.

    Rows go by id and text, so a text stays when another one of the same id goes. Documents
    without words are in no group; of equal rows of an id one stays.
    """
    found = cut_lineage(judged(docs, width, percent, bins, rows).where("doc_id IS NOT NULL").drop("component_id"))
    kept = found.where("kept").withColumn("words", F.col("n_shingles") > 0)
    first = kept.groupBy("doc_id", "words").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last"), F.count("*").alias("n"))
    several = cut_lineage(first.where("n > 1"))
    second = kept.join(several.where("words AND first <> last"), ["doc_id", "words"]).where("text_hash <> first")
    dropped = cut_lineage(found.where("NOT kept").select("doc_id", "text_hash").union(second.select("doc_id", "text_hash")).distinct())
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    names = docs.columns
    rows_of = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64("text").alias("text_hash"))
    rest = rows_of.join(dropped, ["doc_id", "text_hash"], "left_anti")
    if not several.isEmpty():
        repeated = several.select("doc_id").distinct()
        once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text_hash"])
        rest = rest.join(repeated, "doc_id", "left_anti").unionByName(once)
    return rest.select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
