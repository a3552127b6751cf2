"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

The vocabulary has strict terms (weight ``threshold``) and soft terms (weight 1). A term counts
only where the characters beside it are neither a-z nor 0-9, and only once however often it
stands in the URL. A URL whose weights reach the threshold is blocked: one strict term does, or
several different soft ones.

Null URLs and URLs without ``://`` have an empty host and path and no rule; their text (null:
empty) is still searched for terms. Repeated rows are judged one by one; other columns of the
table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import lower_ascii, ship

# The rules of the contract, (action, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "milf", "camgirl", "camgirls", "sexcam", "sexchat",
    "escorts", "warez", "keygen", "serialz", "viagra", "cialis", "levitra", "phishing", "malware", "ransomware",
    "spamfarm", "linkfarm", "clickbait", "adserver", "doubleclick",
)
SOFT = (
    "adult", "sex", "sexy", "nude", "naked", "erotic", "fetish", "escort", "dating", "hookup", "webcam",
    "casino", "casinos", "poker", "slots", "roulette", "blackjack", "betting", "bet", "gamble", "gambling",
    "jackpot", "lottery", "win", "winner", "prize", "bonus", "loan", "loans", "payday", "debt", "forex",
    "bitcoin", "crypto", "pills", "pharmacy", "weightloss", "torrent", "torrents", "crack", "cracked", "hack",
    "cheat", "free", "cheap", "replica", "click", "ads", "adclick", "banner", "popup", "track", "tracker",
    "spam", "farm", "seo", "backlinks", "affiliate",
)
THRESHOLD = 2


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def _inside(char: str) -> bool:
    return "a" <= char <= "z" or "0" <= char <= "9"


def terms_in(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """How many different strict and soft terms stand in a URL in lower case."""
    seen = set()
    for end, (term, hard) in _automaton(strict, soft).iter(url):
        start = end - len(term) + 1
        if (start == 0 or not _inside(url[start - 1])) and (end + 1 == len(url) or not _inside(url[end + 1])):
            seen.add((hard, term))
    hard = sum(h for h, _ in seen)
    return hard, len(seen) - hard


def vocabulary_hits(url: Column, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT) -> Column:
    """Struct of ``strict_hits`` and ``soft_hits``, the numbers of different terms."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict_hits long, soft_hits long")
    def count(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([terms_in(u, strict, soft) for u in urls], columns=["strict_hits", "soft_hits"])

    return count(lower_ascii(F.coalesce(url, F.lit(""))))


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct (action, rule); else null."""
    best = F.lit(None).cast("struct<action:string,rule:string>")
    for action, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(at + start).alias("rule"))).otherwise(best)
    return best


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the numbers of terms. Reads the columns page_id and url only."""
    ship(pages.sparkSession)
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    found = parts.select(
        "page_id", "host", "path",
        matching_rule(F.col("host"), F.col("path"), rules).alias("best"),
        vocabulary_hits(F.col("url"), strict, soft).alias("hits"),
    )
    weight = F.col("hits.strict_hits") * threshold + F.col("hits.soft_hits")
    by_terms = F.when(weight >= threshold, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", by_terms).alias("verdict"), "hits.strict_hits", "hits.soft_hits",
    )


def urls_sql() -> str:
    """The same in DuckDB: a regular expression for each term."""
    def hits(terms: Iterable[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)

    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", a, h + p) for a, h, p in longest]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {f} THEN '{a}'" for f, a, _ in fits) + " END"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), judged AS (
      SELECT page_id, host, path, {rule} AS rule, {action} AS action, {hits(STRICT)} AS strict_hits, {hits(SOFT)} AS soft_hits FROM parts
    )
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {THRESHOLD} * strict_hits + soft_hits >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
      strict_hits, soft_hits
    FROM judged"""
