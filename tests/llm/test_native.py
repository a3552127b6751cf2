"""License scans, mixing, URL filters and fingerprints against their SQL, on driver tables and awkward rows."""

import pytest

from driftline.llm import fingerprints, licenses, mixing, urls
from driftline.llm.queries import ORACLE, QUERIES
from tests.llm import cases
from pyspark.sql import functions as F

OPERATORS = {
    "licenses": (licenses.scan_licenses, licenses.licenses_sql),
    "mixing": (mixing.mix_table, mixing.mixing_sql),
    "fingerprints": (fingerprints.fingerprint_table, fingerprints.fingerprints_sql),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_equal_sql(spark, name):
    operator, sql = OPERATORS[name]
    docs = cases.documents(spark)
    if name == "mixing":  # rows that share the cut share what is left; ids must differ to be sure of the SQL's order
        docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got, want = operator(docs).toPandas(), cases.duck(documents=docs).sql(sql()).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cases.rows(got) == cases.rows(want)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name][0](cases.no_documents(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for f in Path(cases.SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, cases.SMALL).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cases.rows(got) == cases.rows(want)


def test_license_rules_are_many_and_labels_known(spark):
    assert len(licenses.rules()) > 200
    texts = [
        "SPDX-License-Identifier: GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3.",
        "see https://creativecommons.org/licenses/by-nc-sa/4.0/", "mit freundlichen grüßen", "all rights reserved",
        "redistributed under the BSD 3-Clause License", "Licensed under CC BY-NC-SA 4.0",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got[0] == ("gpl-3", 1.0) and got[1] == ("gpl-3", 0.9) and got[2] == ("cc-by-nc-sa", 0.8)
    assert got[3] == ("", 0.0) and got[4] == ("all-rights-reserved", 0.85) and got[5][0] == "bsd-3-clause"
    # The base label stays though a longer detection holds its words.
    assert got[6] == ("cc-by-nc,cc-by-nc-sa", 0.9)


def test_mix_meets_targets_and_repeats(spark):
    texts = cases.sentences(1, 400)
    rows = [(i, t, "big" if i % 2 else ["s1", "s2", "s3", None][i % 4], "en", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    table = mixing.mix_table(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    per = table.groupby(table["source"].fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((per["taken"] - per["target"]).abs() <= 0.5).all()
    assert (table["taken"] <= 2 * table["size"]).all() and (per["target"] <= 2 * per["size"] + 1e-9).all()
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    again = mixed.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("words")).toPandas()
    assert dict(zip(again.doc_id, again.words)) == {d: t for d, t in zip(table.doc_id, table.taken) if t}
    assert mixed.where("n_chars <> length(text)").count() == 0


def test_mix_of_awkward_rows_is_whole(spark):
    docs = cases.documents(spark)
    table = mixing.mix_table(docs).toPandas()
    assert len(table) == docs.count()
    assert (table["taken"] <= 2 * table["size"]).all()
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(cases.no_documents(spark)).count() == 0


def test_urls(spark):
    given = [
        (1, "https://a.example.org/es/x?y"), (2, "http://Example.ORG/en/1"), (3, "http://x.org"), (4, "http://b.com/fr/1"),
        (5, "http://b.com/de/1"), (6, "no scheme/porn"), (7, None), (8, "http://ads-track.example.net/"), (9, "http://adsl.net/tracking"),
        (10, "http://x.net/ads/ads/ads"), (11, "a://b://c/d"), (12, ""), (12, ""), (None, "http://q.net/a#b"), (13, "http://e.net?x/y"),
        (14, "http://orgx/en/"), (15, "http://ä.net/" + "bet-" * 5000 + "xpoker"),
    ]
    pages = spark.createDataFrame(given, "page_id long, url string").selectExpr("*", "'h' AS html", "'z' AS host", "'z' AS rule")
    got = urls.judge_urls(pages).toPandas()
    want = cases.duck(pages=pages).sql(urls.urls_sql()).df()
    assert cases.rows(got) == cases.rows(want)
    verdicts = dict(zip(got["page_id"], zip(got["rule"], got["verdict"])))
    assert verdicts[1] == ("example.org/es/", "block") and verdicts[2] == ("example.org/en/1", "block")
    assert verdicts[3] == (None, "allow") and verdicts[4] == ("com/fr/", "allow") and verdicts[5] == ("com/de/", "block")
    assert [verdicts[i][1] for i in (6, 7, 8, 9, 10, 15)] == ["block", "allow", "block", "allow", "allow", "allow"]
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_fingerprints_are_homomorphic(spark):
    a, b = "First one. Second two\nThird three", "Fourth four\nSecond two"
    docs = spark.createDataFrame([(a, b, "Third three\nSecond two\nFirst one", a + "\n" + b)], "a string, b string, swapped string, both string")
    for c in ("a", "b", "swapped", "both"):
        docs = fingerprints.with_fingerprint(docs, c, f"{c}_lanes")
    joined = fingerprints.combine(F.col("a_lanes"), F.col("b_lanes"))
    row = docs.select(
        fingerprints.as_text(F.col("a_lanes")).alias("a"), fingerprints.as_text(F.col("swapped_lanes")).alias("swapped"),
        fingerprints.as_text(F.col("both_lanes")).alias("both"), fingerprints.as_text(joined).alias("joined"),
        fingerprints.as_text(fingerprints.combine(joined, F.col("b_lanes"), -1)).alias("parted"),
    ).first()
    assert row.a == row.swapped == row.parted and row.both == row.joined != row.a


def test_edited_texts_are_nearer_than_next(spark):
    got = QUERIES["op10_fingerprints"](spark, cases.SMALL).toPandas()
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.2
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()


def expansions(pattern):
    """All texts that an expression of alternatives, optional groups and classes stands for."""
    import re._parser as parser

    def of(items):
        texts = [""]
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "IN":
                more = [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
            elif name == "BRANCH":
                more = [t for branch in value[1] for t in of(branch)]
            elif name == "SUBPATTERN":
                more = of(value[-1])
            else:
                assert name == "MAX_REPEAT" and value[:2] == (0, 1)
                more = ["", *of(value[2])]
            texts = [t + m for t in texts for m in more]
        return texts

    return of(parser.parse(pattern))


def test_gates_ask_for_words_of_every_form():
    """A rule's keywords stand in each text that its expression allows, so the gate hides none."""
    for rule in licenses.rules():
        for text in expansions(rule.pattern):
            assert set(rule.needs) <= set(text.split()), (rule.label, text, rule.needs)


def test_forms_behind_the_gate_are_found(spark):
    texts = ["Simplified BSD License", "New BSD License", "Original BSD License", "The Software shall be used for Good, not Evil.",
             "Governed by the Mozilla Public License 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licenses.scan_licenses(docs).collect()}
    assert "bsd-2-clause" in got[0][0] and "bsd-3-clause" in got[1][0] and "bsd-4-clause" in got[2][0] and "jsr" in got[3][0]
    assert got[4][0] == {"mpl-2"} and got[4][1] == 0.9
