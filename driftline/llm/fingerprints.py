"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A text is a multiset of paragraphs: stretches between line breaks, and within long lines between
sentences, without spaces around them and without empty ones. Each paragraph is hashed to a wide
vector, and a fingerprint is the sum of the vectors, lane by lane, modulo powers of two:

* ``LANES`` lanes of 32 bits from SHA-256, modulo 2^32: texts with equal multisets have equal
  lanes, whatever the order of paragraphs, and others differ in them but for chance;
* ``SIGNS`` lanes of +1 or -1, modulo 2^20: two sums point the same way where most paragraphs are
  common, and their product over all lanes estimates how many are.

Paragraphs are inserted by adding and deleted by subtracting (``combine``). As text a fingerprint
is its lanes in lowercase hex. A null text counts as empty; the empty text has no paragraph and
all lanes 0. Two fingerprints without any sign are alike (1) if they are equal, else not (0).

The next document is the one with the next smaller doc_id; after the last comes the first again.
Rows with the same doc_id follow each other by text, null first; a null doc_id is the smallest.
A single row is its own next. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES, SIGNS = 8, 60
WIDE, FIELD = 2**32, 2**20
#: Where paragraphs part.
BREAK = r"[\n\r]+|[.!?] "
#: Documents in a range of neighbouring ids, about; and the most ranges that are made.
RANGE_ROWS, MOST_RANGES = 2_000, 65_536
STEP = 256


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), F.lit(BREAK)), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _lane_sum(vectors: Column, lane: int) -> Column:
    return F.pmod(F.aggregate(vectors, F.lit(0).cast("long"), lambda s, v: s + v[lane]), F.lit(WIDE))


def _bit_counts(bits: Column, shift: int, mask: int) -> Column:
    return F.aggregate(
        bits, F.lit(0).cast("long"), lambda s, b: s + F.shiftrightunsigned(b, shift).bitwiseAND(F.lit(mask))
    )


def _signed(packed: Column, n: Column, shift: int) -> Column:
    return F.transform(packed, lambda p: n - 2 * F.shiftrightunsigned(p, shift).bitwiseAND(F.lit(FIELD - 1)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: struct of ``wide`` and ``signs``, the lanes of the text in column ``text``.

    Three bits of a paragraph's hash, 20 apart, are counted at a time in the fields of one number.
    """
    hashes = F.transform(paragraphs(F.col(text)), lambda p: F.sha2(p.cast("binary"), 256))
    df = df.withColumn("_hashes", hashes)
    df = df.withColumn("_wide", F.transform(F.col("_hashes"), lambda h: F.array(*[_number(F.substring(h, 8 * i + 1, 8)) for i in range(LANES)])))
    df = df.withColumn("_bits", F.transform(F.col("_hashes"), lambda h: _number(F.substring(h, 50, 15))))
    mask = 1 + FIELD + FIELD * FIELD
    df = df.withColumn("_packed", F.array(*[_bit_counts(F.col("_bits"), j, mask) for j in range(20)]))
    df = df.withColumn("_n", F.size("_hashes").cast("long"))
    wide = [_lane_sum(F.col("_wide"), i) for i in range(LANES)]
    fields = [_signed(F.col("_packed"), F.col("_n"), 20 * f) for f in range(3)]
    lanes = F.struct(F.array(*wide).alias("wide"), F.concat(*fields).alias("signs"))
    return df.withColumn(name, lanes).drop("_hashes", "_wide", "_bits", "_packed", "_n")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of two multisets together, or of ``a`` without ``b`` if ``sign`` is -1."""
    return F.struct(
        F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(WIDE))).alias("wide"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: x + sign * y).alias("signs"),
    )


def as_text(lanes: Column) -> Column:
    wide = F.transform(lanes["wide"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    signs = F.transform(lanes["signs"], lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(FIELD)))), 5, "0"))
    return F.array_join(F.concat(wide, signs), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated share of common paragraphs, of the larger of the two."""
    def product(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x["signs"], y["signs"], lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v)

    most = F.greatest(product(a, a), product(b, b))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(a, b) / F.when(most > 0, most)))
    return F.coalesce(share, F.when(a["wide"] == b["wide"], 1.0).otherwise(0.0))


def _ranges(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Range of a row's ``key``, counted from the largest keys, and where each range's first row is needed too.

    The bounds are approximate quantiles, at most ``MOST_RANGES`` numbers; equal keys share a range.
    """
    rows = docs.count()
    parts = min(MOST_RANGES, rows // RANGE_ROWS + 1)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.agg(F.percentile_approx("key", shares, 100_000).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    steps = [bounds[i : i + STEP] for i in range(0, len(bounds), STEP)] or [[0]]

    def above(values: Column, key: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    key = F.col("key")
    step = F.greatest(above(longs([s[0] for s in steps]), key) - 1, F.lit(0))
    place = step * STEP + above(F.element_at(F.array(*map(longs, steps)), step + 1), key)
    part = -place
    tops = docs.groupBy(part.alias("part")).agg(F.max("key").alias("top"))
    by_part = W.orderBy("part")
    lowest = F.max("part").over(W.partitionBy())
    edges = tops.select("top", F.coalesce(F.lag("part").over(by_part), lowest).alias("also"))
    return part, edges


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), next_text, and part, extra, key for ``neighbours``.

    Documents are dealt by range of ids, and the first row of each range goes to the range before
    it too (``extra``), so each row finds its next in its own range. The text is shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    part, edges = _ranges(docs.select("key"))
    own = F.struct(part.alias("part"), F.lit(False).alias("extra"))
    also = F.struct(F.col("also").alias("part"), F.lit(True).alias("extra"))
    dealt = docs.join(F.broadcast(edges), F.col("key") == F.col("top"), "left").select(
        "doc_id", "key", "text", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("at")
    ).select("doc_id", "key", "text", "at.part", "at.extra")
    return dealt.withColumn("next_text", F.lead("text").over(neighbours()))


def neighbours() -> W:
    return W.partitionBy("part").orderBy("extra", F.desc("key"), "text")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = with_fingerprint(rows.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half))), "text", "own")
    rows = rows.withColumn("next", F.lead("own").over(neighbours())).where(~F.col("extra"))
    rows = with_fingerprint(
        rows.select("doc_id", "n_chars", "own", "next", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")),
        "edited", "changed",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def fingerprints_sql() -> str:
    def lanes(text: str) -> str:
        return f"""list_transform(list_filter(list_transform(string_split_regex({text}, '[\\n\\r]+|[.!?] '), lambda p: trim(p, ' ')), lambda p: p <> ''), lambda p: sha256(p))"""

    def wide(h: str) -> str:
        return "[" + ", ".join(
            f"CAST(coalesce(list_sum(list_transform({h}, lambda x: CAST('0x' || x[{8 * i + 1}:{8 * i + 8}] AS BIGINT))), 0) % {WIDE} AS BIGINT)"
            for i in range(LANES)
        ) + "]"

    def signs(h: str) -> str:
        bits = f"list_transform({h}, lambda x: CAST('0x' || x[50:64] AS BIGINT))"
        return "[" + ", ".join(
            f"CAST(len({h}) - 2 * coalesce(list_sum(list_transform({bits}, lambda b: (b >> {20 * f + j}) & 1)), 0) AS BIGINT)"
            for f in range(3) for j in range(20)
        ) + "]"

    def text(w: str, s: str) -> str:
        return (f"array_to_string(list_transform({w}, lambda x: printf('%08x', x)), '') || "
                f"array_to_string(list_transform({s}, lambda x: printf('%05x', (x + {FIELD}) % {FIELD})), '')")

    def like(a: str, b: str) -> str:
        def product(x: str, y: str) -> str:
            return f"list_sum(list_transform(list_zip({x}_signs, {y}_signs), lambda z: z[1] * z[2]))"
        most = f"greatest({product(a, a)}, {product(b, b)})"
        return f"CASE WHEN {most} > 0 THEN greatest(0.0, least(1.0, CAST({product(a, b)} AS DOUBLE) / {most})) WHEN {a}_wide = {b}_wide THEN 1.0 ELSE 0.0 END"

    return f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
    ), following AS (
      SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM base WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
    ), edits AS (
      SELECT doc_id, text, next_text, length(text) AS n_chars,
        substring(text, 1, CAST(length(text) - length(text) // 2 AS BIGINT)) || substring(next_text, 1, CAST(length(text) // 2 AS BIGINT)) AS edited
      FROM following
    ), hashed AS (
      SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {lanes('text')} AS h, {lanes('edited')} AS eh, {lanes('next_text')} AS nh FROM edits
    ), lanes AS (
      SELECT doc_id, n_chars, edited_sha256, {wide('h')} AS own_wide, {signs('h')} AS own_signs, {wide('eh')} AS changed_wide, {signs('eh')} AS changed_signs,
        {wide('nh')} AS next_wide, {signs('nh')} AS next_signs
      FROM hashed
    )
    SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, {text('own_wide', 'own_signs')} AS fingerprint, {text('changed_wide', 'changed_signs')} AS edited_fingerprint,
      CAST({like('own', 'changed')} AS DOUBLE) AS near_edited, CAST({like('own', 'next')} AS DOUBLE) AS near_next
    FROM lanes"""
