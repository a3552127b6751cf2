"""Conversation prefix trie against prefixes counted one by one."""

import hashlib
import random
import re
import zlib

import pytest

from driftline.llm import tries
from tests.llm import cases

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (y[0], y[1], y[2], digest(y[2], y[3])))] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + x[h:])
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for x in nodes:
        if x:
            children[x[:-1]] += 1
    for x, members in nodes.items():
        for d in range(len(x) + 1):
            saved[x[:d]] += (len(members) - 1) * words(x[-1][1]) if x else 0
            leaves[x[:d]] += children[x] == 0
    return sorted(
        (min(m), len(x), min(nodes[x[:-1]]) if x else None, len(m), children[x], leaves[x], saved[x],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(x)))).encode()).hexdigest())
        for x, m in nodes.items()
    )


def digest(role, text):
    words = len(re.findall(r"[^\x20\x09-\x0d]+", text))
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + f"{words:08X}"


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "'x' AS rep", "'x' AS n", "'x' AS seg")
    return sorted(tuple(r) for r in tries.conversation_trie(table, **options).collect())


def conversations(seed, n, turns, vocabulary):
    draw = random.Random(seed)
    rows, begun = [], [[]]
    for c in draw.sample(range(-30, 10 * n), n):
        talk = list(draw.choice(begun)[: draw.randint(0, turns)])
        while len(talk) < draw.randint(1, turns):
            talk.append((draw.choice(["user", "assistant", None]), draw.choice(vocabulary)))
        begun.append(talk)
        rows += [(c, t, *x) for t, x in enumerate(talk)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, turns, size, task_rows, fan", [(1, 5, 1024, 100_000, 32), (2, 6, 1024, 4, 2), (3, 9, 2, 3, 2), (4, 30, 4, 5, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, turns, size, task_rows, fan):
    """Forests of few conversations met over several levels, segments of few turns over several rounds."""
    monkeypatch.setattr(tries, "TASK_ROWS", task_rows)
    monkeypatch.setattr(tries, "FAN", fan)
    monkeypatch.setattr(tries, "BLOCK", 7)
    rows = conversations(seed, 60, turns, ["", "a b", "one  two\tthree", None, "x"])
    assert run(spark, rows, size=size) == brute(rows)


def test_contracted_forest_is_short_and_loses_nothing():
    """Lines cut anywhere and met again give the ends of the whole line."""
    draw = random.Random(5)
    for _ in range(300):
        words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(0, 7))) for _ in range(draw.randint(2, 40))})
        size = len(words)
        reps = draw.sample(range(1000), size)
        items = [(reps[i], draw.randint(1, 3), 1, 0, len(w), len(w)) for i, w in enumerate(words)]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        edges = [(common(a, b), common(a, b), 0, 0, 0) for a, b in zip(words, words[1:])]
        whole, alone, *_ = tries.contract(items, edges, False)
        cuts = sorted(draw.sample(range(1, size), min(size - 1, draw.randint(1, 5))))
        parts, ends = [], []
        for a, b in zip([0, *cuts], [*cuts, size]):
            found, none, kept, between = tries.contract(items[a:b], edges[a : b - 1], True)
            assert not none and len(kept) <= 2 * 7 + 3 and len(between) == len(kept) - 1
            ends.append(found)
            parts.append((kept, between))
        line, joints = [], []
        for k, (kept, between) in enumerate(parts):
            joints += ([edges[cuts[k - 1] - 1]] if k else []) + between
            line += kept
        top, last, *_ = tries.contract(line, joints, False)
        assert [x for _, x in last] == [x for _, x in alone]
        owner = {(e[0], e[1]): e[2] for e in top}
        got = list(top)
        for found in ends:
            got += [(*e[:2], e[2] if e[3] else owner.get((e[2], e[1]), e[2]), True, *e[4:]) for e in found]
        assert sorted(got) == sorted(whole)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "system", None), (20, 0, "user", "a"), (20, 1, None, "b c"),
        (21, 5, "user", "own"), (22, 1, "user", ""), (22, 1, "", "user"), (None, 1, "user", "lost"), (-5, 0, "user", "minus"), (-5, 1, "user", "x " * 50_000),
        (0, 0, "user", "base"), (3, 0, "user", "one"), (4, 0, "user", "one"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, 1, "user", "lost")]) == []
    assert run(spark, []) == [] if spark.createDataFrame([], SCHEMA).isEmpty() else False
    alone = [(1, 0, "user", "hi")]
    assert run(spark, alone) == brute(alone)


def test_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 16)
    monkeypatch.setattr(tries, "TASK_ROWS", 50)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 4000, 20) for t in range(3)]
    rows += [(c, 0, "system", "same") for c in range(5, 300)] + [(c, 1, "user", f"own {c}") for c in range(5, 300)]
    rows += [(7_000_001 + k, t, "user", f"turn {t}") for k in (0, 20) for t in range(700)] + [(7_000_021, 700, "user", "more")]
    assert run(spark, rows, size=64) == brute(rows)


def test_query_equals_sql(spark):
    from driftline.llm.queries import ORACLE, QUERIES

    got = QUERIES["op13_conversation_trie"](spark, cases.SMALL)
    con = cases.duck(conversations=spark.read.parquet(f"{cases.SMALL}/conversations.parquet"))
    want = con.sql(ORACLE["op13_conversation_trie"]).df()
    assert cases.rows(got.toPandas()) == cases.rows(want)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
