"""License scans: ordered signature rules over the words of a text, with DataFrame functions only.

A rule is a regular expression over words in lower case, gated by keywords: only where all
keywords of a rule stand among a text's words is its expression tried. Detections are intervals
of words. One that lies inside another is suppressed; of equal intervals the rule of the highest
priority stays (the order in ``rules()``). The labels of what is left, and the base labels, are
the document's labels; its score is the highest weight left.

Null texts count as empty. A text without words has no labels and score 0. Repeated rows are
scanned one by one; an empty table gives no rows; columns other than doc_id and text are not
looked at. Work is linear in a text's length, whatever the number of detections.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import LOWER, UPPER, lower_ascii

#: Everything but digits, a-z and what is not ASCII parts words (after lower-casing).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


class Rule(NamedTuple):
    label: str
    needs: tuple[str, ...]
    pattern: str
    weight: float
    base: bool = False


# Name of a license in words, by label: keywords that all its forms have, then the expression.
NAMES = (
    ("mit", ("mit",), "(?:mit|mit x11|expat mit) licen[cs]e"),
    ("mit-0", ("mit", "attribution"), "mit no attribution(?: licen[cs]e)?"),
    ("apache-2", ("apache", "2"), "apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("apache-1.1", ("apache", "1"), "apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache-1.0", ("apache", "1"), "apache(?: software)? licen[cs]e(?: version)? 1 0"),
    ("gpl-2", ("general", "public", "2"), "gnu general public licen[cs]e(?: gpl)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3", ("general", "public", "3"), "gnu general public licen[cs]e(?: gpl)?(?: version| v)? 3(?: 0)?"),
    ("gpl", ("gnu", "general", "public"), "gnu general public licen[cs]e"),
    ("lgpl-2.1", ("lesser", "2", "1"), "gnu lesser general public licen[cs]e(?: version| v)? 2 1"),
    ("lgpl-3", ("lesser", "3"), "gnu lesser general public licen[cs]e(?: version| v)? 3(?: 0)?"),
    ("lgpl-2", ("library", "general", "2"), "gnu library general public licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("lgpl", ("gnu", "lesser"), "gnu lesser general public licen[cs]e"),
    ("agpl-3", ("affero", "3"), "gnu affero general public licen[cs]e(?: version| v)? 3(?: 0)?"),
    ("agpl", ("affero",), "(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", ("gnu", "free", "documentation"), "gnu free documentation licen[cs]e"),
    ("bsd-2-clause", ("bsd",), "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", ("bsd",), "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", ("bsd",), "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?"),
    ("0bsd", ("bsd", "zero"), "zero clause bsd(?: licen[cs]e)?"),
    ("bsd", ("bsd",), "(?:modified |revised |simplified |new )?bsd licen[cs]e"),
    ("mpl-2", ("mozilla", "2"), "mozilla public licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("mpl-1.1", ("mozilla", "1"), "mozilla public licen[cs]e(?: version| v)? 1 1"),
    ("mpl", ("mozilla",), "mozilla public licen[cs]e"),
    ("epl-2", ("eclipse", "2"), "eclipse public licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("epl-1", ("eclipse", "1"), "eclipse public licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("edl", ("eclipse", "distribution"), "eclipse distribution licen[cs]e"),
    ("cddl-1.1", ("cddl",), "cddl(?: version| v)? 1 1"),
    ("cddl", ("common", "development", "distribution"), "common development and distribution licen[cs]e"),
    ("cpl", ("common", "public"), "common public licen[cs]e"),
    ("cpal", ("attribution", "common", "public"), "common public attribution licen[cs]e"),
    ("eupl", ("european", "union", "public"), "european union public licen[cs]e"),
    ("osl-3", ("open", "software", "3"), "open software licen[cs]e(?: version| v)? 3(?: 0)?"),
    ("afl-3", ("academic", "free"), "academic free licen[cs]e(?: version| v)? 3(?: 0)?"),
    ("artistic-2", ("artistic", "2"), "artistic licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("artistic", ("artistic",), "(?:perl |clarified )?artistic licen[cs]e"),
    ("isc", ("isc",), "isc licen[cs]e"),
    ("zlib", ("zlib",), "zlib(?: libpng)? licen[cs]e"),
    ("libpng", ("libpng",), "libpng licen[cs]e"),
    ("boost", ("boost",), "boost software licen[cs]e"),
    ("unlicense", ("unlicense",), "(?:the )?unlicense"),
    ("wtfpl", ("wtfpl",), "wtfpl"),
    ("wtfpl", ("public", "fuck"), "do what the fuck you want to public licen[cs]e"),
    ("python-2", ("python", "foundation"), "python software foundation licen[cs]e"),
    ("php-3", ("php", "3"), "php licen[cs]e(?: version| v)? 3(?: 0| 01)?"),
    ("ruby", ("ruby",), "ruby licen[cs]e"),
    ("postgresql", ("postgresql",), "postgresql licen[cs]e"),
    ("openssl", ("openssl",), "openssl(?: ssleay)? licen[cs]e"),
    ("w3c", ("w3c", "software"), "w3c software(?: notice)?(?: and)? licen[cs]e"),
    ("ncsa", ("ncsa",), "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("unicode", ("unicode",), "unicode(?: terms of use| licen[cs]e agreement| licen[cs]e)"),
    ("ofl", ("open", "font"), "(?:sil )?open font licen[cs]e"),
    ("upl", ("universal", "permissive"), "universal permissive licen[cs]e"),
    ("blue-oak", ("blue", "oak"), "blue oak model licen[cs]e"),
    ("mulan", ("mulan",), "mulan p(?:ermissive|ublic) (?:software )?licen[cs]e"),
    ("ms-pl", ("microsoft", "public"), "microsoft public licen[cs]e"),
    ("ms-rl", ("microsoft", "reciprocal"), "microsoft reciprocal licen[cs]e"),
    ("apsl", ("apple", "public"), "apple public source licen[cs]e"),
    ("ipl", ("ibm", "public"), "ibm public licen[cs]e"),
    ("odbl", ("open", "database"), "open(?: data commons)? open database licen[cs]e|open database licen[cs]e"),
    ("odc-by", ("commons", "data", "attribution"), "open data commons attribution licen[cs]e"),
    ("pddl", ("domain", "dedication", "public"), "(?:open data commons )?public domain dedication and licen[cs]e"),
    ("cc0", ("cc0",), "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", ("creative", "commons", "zero"), "creative commons zero(?: v1)?(?: 1)?(?: 0)?(?: universal)?"),
    ("cc-by-nc-nd", ("cc", "by", "nc", "nd"), "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", ("cc", "by", "nc", "sa"), "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", ("cc", "by", "nc"), "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", ("cc", "by", "nd"), "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", ("cc", "by", "sa"), "cc by sa(?: [1-4] [05])?"),
    ("cc-by", ("cc", "by"), "cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", ("creative", "commons", "noncommercial"), "creative commons attribution noncommercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", ("creative", "commons", "noncommercial"), "creative commons attribution noncommercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", ("creative", "commons", "noncommercial"), "creative commons attribution noncommercial(?: [1-4] [05])?"),
    ("cc-by-nd", ("creative", "commons", "attribution"), "creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"),
    ("cc-by-sa", ("creative", "commons", "attribution"), "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", ("creative", "commons", "attribution"), "creative commons attribution(?: [1-4] [05])?"),
    ("sspl", ("server", "side", "public"), "server side public licen[cs]e"),
    ("busl", ("business", "source"), "business source licen[cs]e"),
    ("elastic-2", ("elastic", "2"), "elastic licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("elastic", ("elastic",), "elastic licen[cs]e"),
    ("commons-clause", ("commons", "clause"), "commons clause(?: licen[cs]e)?(?: condition)?"),
    ("openrail", ("rail",), "(?:creativeml )?(?:open )?(?:big ?science )?(?:open )?rail(?: m)? licen[cs]e"),
    ("llama", ("llama", "community"), "llama(?: [234])?(?: [0-9])? community licen[cs]e"),
    ("x11", ("x11",), "x11 licen[cs]e"),
    ("beerware", ("beerware",), "beerware(?: licen[cs]e)?"),
    ("jsr", ("good", "evil"), "software shall be used for good not evil"),
)

# Short forms: identifiers as words, by label.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("apache-2", "apache 2 0"), ("apache-1.1", "apache 1 1"),
    ("gpl-2", "gpl 2 0(?: only| or later)?"), ("gpl-3", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?"), ("gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("0bsd", "0bsd"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"),
    ("mpl-2", "mpl 2 0"), ("mpl-1.1", "mpl 1 1"), ("epl-2", "epl 2 0"), ("epl-1", "epl 1 0"),
    ("cddl", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("cpl", "cpl 1 0"), ("eupl", "eupl 1 [12]"), ("osl-3", "osl 3 0"),
    ("afl-3", "afl 3 0"), ("artistic-2", "artistic 2 0"), ("artistic", "artistic 1 0"), ("isc", "isc"), ("zlib", "zlib"),
    ("libpng", "libpng"), ("boost", "bsl 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("python-2", "python 2 0|psf 2 0"),
    ("php-3", "php 3 01?"), ("ruby", "ruby"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("w3c", "w3c"),
    ("ncsa", "ncsa"), ("unicode", "unicode dfs 2016|unicode 3 0"), ("ofl", "ofl 1 [01]"), ("upl", "upl 1 0"), ("blue-oak", "blueoak 1 0 0"),
    ("mulan", "mulanpsl [12] 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("apsl", "apsl 2 0"), ("ipl", "ipl 1 0"),
    ("odbl", "odbl 1 0"), ("odc-by", "odc by 1 0"), ("pddl", "pddl 1 0"), ("cc0", "cc0 1 0"),
    ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"), ("cc-by-nd", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"), ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"),
    ("sspl", "sspl 1 0"), ("busl", "busl 1 1"), ("elastic-2", "elastic 2 0"), ("x11", "x11"), ("beerware", "beerware"),
)

# Addresses of license texts, as words.
ADDRESSES = (
    ("mit", ("opensource",), "opensource org licenses mit(?: license)?(?: php)?"),
    ("apache-2", ("apache", "licenses"), "apache org licenses license 2 0"),
    ("gpl", ("gnu", "licenses"), "gnu org licenses gpl(?: html| txt)?"),
    ("gpl-2", ("gnu", "licenses"), "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", ("gnu", "licenses"), "gnu org licenses gpl 3 0"),
    ("lgpl", ("gnu", "licenses"), "gnu org licenses lgpl(?: html| txt)?"),
    ("agpl", ("gnu", "licenses"), "gnu org licenses agpl(?: html| txt)?"),
    ("mpl-2", ("mozilla",), "mozilla org (?:en us )?mpl 2 0"),
    ("bsd-2-clause", ("opensource",), "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", ("opensource",), "opensource org licenses bsd 3 clause"),
    ("epl-2", ("eclipse",), "eclipse org legal epl 2 0"),
    ("unlicense", ("unlicense",), "unlicense org"),
    ("boost", ("boost",), "boost org license 1 0"),
    ("cc0", ("creativecommons",), "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", ("creativecommons",), "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", ("creativecommons",), "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc", ("creativecommons",), "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", ("creativecommons",), "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", ("creativecommons",), "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by", ("creativecommons",), "creativecommons org licenses by [1-4] [05]"),
)

# Sentences of license texts and notices.
CLAUSES = (
    ("mit", ("permission", "hereby", "charge"), "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", ("permission", "fee"), "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", ("redistribution", "binary"), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", ("endorse", "promote"), "may be used to endorse or promote products derived from this software"),
    ("gpl", ("redistribute", "modify", "gnu"), "redistribute it and or modify it under the terms of the gnu general public license"),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain"),
    ("boost", ("hereby", "charge", "organization"), "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", ("provided", "warranty", "implied"), "this software is provided as is without any express or implied warranty in no event"),
    ("ofl", ("font", "sil"), "this font software is licensed under the sil open font license"),
    ("public-domain", ("public", "domain"), "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", ("public", "domain"), "(?:is|are) in the public domain"),
    ("all-rights-reserved", ("rights", "reserved"), "all rights reserved"),
    ("proprietary", ("proprietary", "confidential"), "proprietary and confidential"),
    ("no-commercial-use", ("commercial", "permitted"), "commercial use (?:is )?not permitted|no commercial use (?:is )?permitted"),
)
GRANT = "(?:licen[cs]ed|released|distributed|published|available|provided|offered|governed|covered)(?: for use)? (?:under|by)(?: the)?(?: terms of)?(?: the)? "


def rules() -> list[Rule]:
    """All rules, highest priority first: base phrases, identifiers, grants, addresses, clauses, bare names."""
    def words(pattern: str) -> set[str]:
        return {w for w in pattern.split(" ") if w.isalnum()}

    found = [Rule(label, tuple(sorted(words(p))), p, 0.95, True) for p, label in BASE]
    found += [Rule(label, ("identifier", "spdx"), f"spdx licen[cs]e identifier (?:{p})", 1.0) for label, p in IDENTIFIERS]
    found += [Rule(label, needs, f"{GRANT}(?:{p})", 0.9) for label, needs, p in NAMES]
    found += [Rule(label, needs, p, 0.8) for label, needs, p in ADDRESSES]
    found += [Rule(label, needs, p, 0.85) for label, needs, p in CLAUSES]
    return found + [Rule(label, needs, p, 0.6) for label, needs, p in NAMES]


def expression(pattern: str) -> str:
    """A pattern of words as expression over a text in which each word has a space on either side."""
    return f" ({pattern.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')}) "


def _table() -> list[dict]:
    return [
        {"place": i, "label": r.label, "needs": list(r.needs), "rx": expression(r.pattern), "weight": r.weight, "base": r.base}
        for i, r in enumerate(rules())
    ]


def words_of(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _intervals(spaced: Column, rule: Column) -> Column:
    """Intervals [start, end) of words where a rule's expression matches, in one pass over the text."""
    mark = "\x01"
    marked = F.split(F.trim(F.regexp_replace(spaced, rule["rx"], F.lit(f" {mark}$1 "))), F.lit(" +"))
    starts = F.filter(
        F.transform(marked, lambda w, i: F.when(w.startswith(mark), i)), lambda i: i.isNotNull()
    )
    sizes = F.transform(
        F.regexp_extract_all(spaced, rule["rx"], F.lit(1)), lambda m: F.size(F.split(m, F.lit(" +")))
    )
    return F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. No shuffle."""
    table = F.from_json(
        F.lit(json.dumps(_table())),
        "array<struct<place:int,label:string,needs:array<string>,rx:string,weight:double,base:boolean>>",
    )
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules() for k in r.needs})])
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    gated = worded.select(
        "doc_id", "words", F.array_intersect("words", keywords).alias("hits")
    ).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "words",
        # Named twice, so that the optimizer does not move the intersection into the loop over rules.
        F.when(
            F.size("hits") > 0,
            F.filter(table, lambda r: F.forall(r["needs"], lambda k: F.array_contains("hits", k))),
        ).otherwise(F.filter(table, lambda r: F.lit(False))).alias("rules"),
    )
    spaced = gated.select(
        "doc_id", "n_words", "rules",
        F.when(F.size("rules") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).alias("spaced"),
    )
    detected = spaced.select(
        "doc_id", "n_words",
        F.flatten(F.transform("rules", lambda r: F.transform(
            _intervals(F.col("spaced"), r),
            lambda d: F.struct(
                d["start"].alias("start"), (-d["end"]).alias("minus_end"), r["place"].alias("place"),
                r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base"),
            ),
        ))).alias("all"),
    ).withColumn("all", F.array_sort("all"))
    empty = F.struct(F.lit(0).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def sweep(state: Column, d: Column) -> Column:
        """Detections come by start, longest first, then by priority: one is inside another if it ends within reach."""
        inside = -d["minus_end"] <= state["reach"]
        return F.struct(
            F.greatest(state["reach"], -d["minus_end"]).alias("reach"),
            F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["weight"])).alias("score"),
        )

    base = F.filter("all", lambda d: d["base"])
    swept = detected.select("doc_id", "n_words", base.alias("base"), F.aggregate("all", empty, sweep).alias("kept"))
    return swept.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        _joined(F.transform("base", lambda d: d["label"])).alias("base_labels"),
        _joined(F.concat(F.transform("base", lambda d: d["label"]), "kept.labels")).alias("labels"),
        F.col("kept.score").alias("score"),
    )


def licenses_sql() -> str:
    """The same in DuckDB: the rules as a table, detections as rows, suppression as a window."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(
        f"({r['place']}, {text(r['label'])}, [{', '.join(map(text, r['needs']))}], {text(r['rx'])}, CAST({r['weight']} AS DOUBLE), {r['base']})"
        for r in _table()
    )
    return f"""
    WITH rules(place, label, needs, rx, weight, base) AS (VALUES {values}),
    worded AS (
      SELECT row_number() OVER () AS rid, doc_id,
        list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}', ' ', 'g'), ' '), lambda w: w <> '') AS words
      FROM documents
    ), tried AS (
      SELECT w.rid, r.place, r.label, r.weight, r.base, r.rx, ' ' || array_to_string(w.words, '  ') || ' ' AS spaced
      FROM worded w JOIN rules r ON list_has_all(w.words, r.needs)
    ), marked AS (
      SELECT rid, place, label, weight, base,
        list_filter(list_transform(string_split_regex(trim(regexp_replace(spaced, rx, ' ' || chr(1) || '\\1 ', 'g')), ' +'),
          lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN i - 1 END), lambda i: i IS NOT NULL) AS starts,
        list_transform(regexp_extract_all(spaced, rx, 1), lambda m: len(string_split_regex(m, ' +'))) AS sizes
      FROM tried
    ), detected AS (
      SELECT rid, place, label, weight, base, unnest(starts) AS s, unnest(sizes) AS n FROM marked
    ), reached AS (
      SELECT *, s + n <= coalesce(max(s + n) OVER (PARTITION BY rid ORDER BY s, n DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
      FROM detected
    ), summed AS (
      SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
        list_sort(list(DISTINCT label) FILTER (base)) AS bases, list_sort(list(DISTINCT label) FILTER (base OR NOT inside)) AS labels,
        max(weight) FILTER (NOT inside) AS score
      FROM reached GROUP BY rid
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      coalesce(array_to_string(bases, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0) AS score
    FROM worded LEFT JOIN summed USING (rid)"""
