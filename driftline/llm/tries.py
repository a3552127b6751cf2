"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Every distinct sequence of the first d turns of some conversation is a node; conversations that
start with it are its members. Sequences stand sorted, equal ones once, so the members of a node
are neighbours, and a node with several branches is where neighbours have d turns in common.
Taken in descending order of what they have in common, the edges between neighbours join
components by union-find. Where components meet at depth d, the one with the smallest conversation
goes on and the others end there: each such end is a branch of the node of depth d. A conversation
so owns the nodes of its own path below the depth at which it ended, all others belong to smaller
ones, and what a branch held when it ended (members, leaves, tokens) is what it adds to its owner.

Spark sorts the sequences over tasks by range. A task joins all components that end inside it; of
those that may go on over its borders it keeps a forest contracted to its two spines: a line of
components that get less and less in common with the border, not more of them than turns. Forests
of ``FAN`` neighbouring tasks then meet in one task and are contracted again, until one is left.
Losers at an open depth name the component that they met; its owner is looked up later.

Turns are ordered by number (null first), then by role and by a digest of the text; a null role or
text is empty; repeated rows are turns of their own. Rows without conv_id take no part. Turns are
told apart by 128-bit digests, equal conversations by 128 bits over those. A conversation may have
any number of turns and is cut into segments of ``SEGMENT``: conversations with equal segments go
into a further round on the next segment (a round for each segment that different conversations
share). Its turns are numbered by ranges of a sort, so a long one is spread over tasks. Only
conv_id, turn, role and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, ship, written

#: Turns of a segment; forests that meet in one task; sequences and bytes of a task.
SEGMENT, FAN = 1024, 32
TASK_ROWS, TASK_BYTES = 100_000, 32_000_000
#: Conversations in a block of ids, written as one text.
BLOCK = 8192
#: The digest of a turn and its number of words, in hexadecimal.
ENTRY, DIGEST = 40, 32
NOTHING = hashlib.sha256(b"").hexdigest()

Item = tuple[int, int, int, int, int, int]  # smallest conversation, members, leaves, saved, depth, words up to it
Edge = tuple[int, int, int, int, int]  # depth, words up to it; members, leaves, saved of branches that ended at it
CUT: Edge = (-1, 0, 0, 0, 0)


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), entry, words: the turns of each conversation in order.

    Rows are sorted by range, so a long conversation may lie in several tasks; its counts in the
    tasks before give what to add to the numbers. Those are fewer rows than tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORD))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), words.alias("words"),
        F.concat(digest, F.lpad(F.hex(words), ENTRY - DIGEST, "0")).alias("entry"),
    )
    order = [F.asc_nulls_first("turn"), "role", "entry"]
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(tasks, "conv_id", *order).withColumn("task", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv_id", "task").count().withColumn("offset", F.sum("count").over(before))
    offsets = offsets.where("offset > 0").select("conv_id", "task", "offset")
    inside = Window.partitionBy("conv_id", "task").orderBy(*order)
    numbered = ranged.withColumn("n", F.row_number().over(inside)).join(F.broadcast(offsets), ["conv_id", "task"], "left")
    return numbered.select("conv_id", (F.col("n") + F.coalesce("offset", F.lit(0))).alias("pos"), "entry", "words")


def rebuilt_turns(placed: DataFrame, family: int = 20, shares: int = 4) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their rebuilt turns: conv_id, depth (from 1), entry, words.

    The first turns come from the conversation whose number is the next multiple of ``family``
    towards zero: crc32(conv_id) % ``shares`` of them, or as many as it has.
    """
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", kept.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    )
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("pos") < shares)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "entry", "words"))).alias("head")  # fewer than ``shares``
    )
    known = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:int,entry:string,words:int>>")), F.lit(1), F.col("h").cast("int")).alias("head")
    )
    own = placed.join(known.select("conv_id", "h", F.size("head").alias("took")), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("took")).cast("long").alias("depth"), "entry", "words"
    )
    first = known.select("conv_id", F.inline("head")).select("conv_id", F.col("pos").cast("long").alias("depth"), "entry", "words")
    return convs.select("conv_id"), first.unionByName(own)


def segments(rebuilt: DataFrame, size: int) -> DataFrame:
    """conv_id, k, seg, w: entries of each ``size`` turns as one text, and their words."""
    return rebuilt.groupBy("conv_id", F.floor((F.col("depth") - 1) / size).alias("k")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "entry"))), lambda x: x["entry"]), "").alias("seg"),
        F.sum(F.col("words").cast("long")).alias("w"),
    )


def distinct_sequences(convs: DataFrame, segs: DataFrame) -> DataFrame:
    """rep, n, n_turns, words, ends_sha256: each sequence once, by its smallest conversation.

    The digest of all conversation numbers of a sequence is one pass in order by its definition:
    numbers come as blocks of bounded size, sorted by Spark, and stream through a task.
    """
    sums = segs.groupBy("conv_id").agg(
        F.sum(F.length("seg") / ENTRY).cast("long").alias("n_turns"), F.sum("w").alias("words"),
        F.bit_xor(F.xxhash64("k", "seg")).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), "k", "seg")).alias("b"),
    )
    zero = F.lit(0).cast("long")
    every = convs.join(sums, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("n_turns", "words", "a", "b")]
    )
    key = ["n_turns", "a", "b"]
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = every.groupBy(*key, "words", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n"),
        F.array_join(F.transform(ids, lambda c: c.cast("string")), ",").alias("ids"),
    )

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, row, digest = None, None, None
        for batch in batches:
            out = []
            for n_turns, a, b, words, least, n, ids in batch.itertuples(index=False, name=None):
                if at != (n_turns, a, b):
                    if row:
                        out.append((*row, digest.hexdigest()))
                    at, row, digest = (n_turns, a, b), [least, 0, n_turns, words], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                row[1] += n
            yield pd.DataFrame(out, columns=names)
        if row:
            yield pd.DataFrame([(*row, digest.hexdigest())], columns=names)

    names = ["rep", "n", "n_turns", "words", "ends_sha256"]
    sorted_blocks = blocks.repartition(*key).sortWithinPartitions(*key, "block")
    return sorted_blocks.select(*key, "words", "least", "n", "ids").mapInPandas(
        told, "rep long, n long, n_turns long, words long, ends_sha256 string"
    )


def in_common(a: str, b: str) -> tuple[int, int]:
    """Entries that two segments begin with alike, and the words in those."""
    depth = words = at = 0
    while at < len(a) and a[at : at + ENTRY] == b[at : at + ENTRY]:
        words += int(a[at + DIGEST : at + ENTRY], 16)
        depth += 1
        at += ENTRY
    return depth, words


def contract(items: list[Item], edges: list[Edge], is_open: bool) -> tuple[list[tuple], list[tuple[int, Item]], list[Item], list[Edge]]:
    """Joins a line of components by its edges, the deepest first.

    Returns the ends of branches (conversation, depth, the one met, whether that is the owner for
    certain, members, leaves, saved, whether it is a child), the components that no edge leads out
    of (place of their first item, component), and, where the line goes on at both ends
    (``is_open``), the items and edges of its contracted forest.
    """
    size = len(items)
    parent, last, whole = list(range(size)), list(range(size)), list(items)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ends: list[tuple] = []
    left: list[tuple[Item, Edge | None]] = [(items[0], None)]  # each with the edge towards the border
    right: list[tuple[Item, Edge | None]] = [(items[-1], None)]
    middle: list[tuple[Item | None, Edge]] = []
    order = sorted((i for i in range(size - 1) if edges[i][0] >= 0), key=lambda i: (-edges[i][0], i))
    for depth, group in groupby(order, key=lambda i: edges[i][0]):
        runs: list[list[int]] = []  # edges of this depth that meet in one component
        for i in group:
            if runs and find(i) == find(runs[-1][-1] + 1):
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            parts = [find(run[0]), *[find(i + 1) for i in run]]
            words = edges[run[0]][1]
            more = [sum(edges[i][k] for i in run) for k in (2, 3, 4)]
            open_left = is_open and parts[0] == 0
            open_right = is_open and last[parts[-1]] == size - 1
            inner = parts[open_left : len(parts) - open_right]
            branches = [
                (rep, n, leaves if top > depth else 0, saved + (n - 1) * (up_to - words), top > depth)
                for rep, n, leaves, saved, top, up_to in (whole[p] for p in inner)
            ]
            best = min(range(len(inner)), key=lambda k: branches[k][0], default=None)
            for k, (rep, n, leaves, saved, child) in enumerate(branches):
                if k != best:
                    ends.append((rep, depth, branches[best][0], not (open_left or open_right), n, leaves, saved, child))
                if k != best or not (open_left or open_right):
                    more = [more[0] + n, more[1] + leaves, more[2] + saved]
            if not (open_left or open_right):
                whole[parts[0]] = (branches[best][0], *more, depth, words)
            else:
                edge = (depth, words, *more)
                if open_left and open_right:
                    middle = [(whole[inner[best]], edge), (None, (depth, words, 0, 0, 0))] if inner else [(None, edge)]
                else:
                    (left if open_left else right).append((whole[inner[best]], edge))
            for p in parts[1:]:
                parent[p] = parts[0]
            last[parts[0]] = last[parts[-1]]
    firsts = [i for i in range(size) if parent[i] == i]
    if not is_open:
        return ends, [(i, whole[i]) for i in firsts], [], []
    alone = [(i, whole[i]) for i in firsts if i != 0 and last[i] != size - 1]
    kept, between = [item for item, _ in left], [edge for _, edge in left[1:]]
    if size > 1:
        if len(firsts) > 1:
            middle = [(None, CUT)]
        for item, edge in middle:
            between.append(edge)
            if item:
                kept.append(item)
        line = right[::-1]
        kept += [item for item, _ in line]
        between += [edge for _, edge in line[:-1]]
    return ends, alone, kept, between


ROWS = (
    "kind string, task long, g long, rep long, depth long, via long, final boolean, n long, leaves long, saved long, child int, "
    "items array<array<long>>, edges array<array<long>>, borders array<string>, border_groups array<long>"
)
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _report(task: int, groups: list[int], result: tuple, borders: list[str], border_groups: list[int]) -> pd.DataFrame:
    ends, alone, items, edges = result
    out = [("end", task, None, rep, depth, via, final, n, leaves, saved, int(child), None, None, None, None)
           for rep, depth, via, final, n, leaves, saved, child in ends]
    for i, (rep, n, leaves, saved, _, words) in alone:
        out.append(("root", task, groups[i], rep, None, None, None, n, leaves, saved + (n - 1) * words, None, None, None, None, None))
    if items:
        out.append(("forest", task, *[None] * 9, [list(x) for x in items], [list(x) for x in edges], borders, border_groups))
    return pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in ("g", "rep", "depth", "via", "n", "leaves", "saved", "child")})


def forest(elements: DataFrame, bytes_in_all: int, rows_in_all: int) -> tuple[DataFrame, DataFrame]:
    """Ends (rep, depth, winner, n, leaves, saved, child) and roots (g, rep, n, leaves, saved) of all groups.

    ``elements``: g, seg, rep, n, leaves, saved; unlike seg in each group g, saved as of the end of seg.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, edges, groups = [], [], []
        border, seg, g = [], "", None
        for batch in batches:
            for group, now, rep, n, leaves, saved in batch[["g", "seg", "rep", "n", "leaves", "saved"]].itertuples(index=False, name=None):
                if items:
                    edges.append((*in_common(seg, now), 0, 0, 0) if group == g else CUT)
                else:
                    border = [(group, now)]
                seg, g = now, group
                groups.append(group)
                items.append((rep, n, leaves, saved, *in_common(now, now)))
        if items:
            border.append((g, seg))
            yield _report(TaskContext.get().partitionId(), groups, contract(items, edges, True), [s for _, s in border], [x for x, _ in border])

    def meet(is_open: bool):
        def met(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("task")
            items, edges, groups, border = [], [], [], None
            for its, eds, segs, gs in pdf[["items", "edges", "borders", "border_groups"]].itertuples(index=False, name=None):
                if border:
                    edges.append((*in_common(border[1], segs[0]), 0, 0, 0) if border[0] == gs[0] else CUT)
                at = gs[0]
                eds = [tuple(map(int, e)) for e in eds]
                for k, item in enumerate(its):
                    if k and eds[k - 1][0] < 0:
                        at = gs[1]  # a forest holds two groups at most: those at its borders
                    groups.append(int(at))
                    items.append(tuple(map(int, item)))
                edges += eds
                border = gs[1], segs[1]
            heads, tails = pdf.iloc[0], pdf.iloc[-1]
            return _report(
                int(heads["task"]) // FAN, groups, contract(items, edges, is_open),
                [heads["borders"][0], tails["borders"][1]], [int(heads["border_groups"][0]), int(tails["border_groups"][1])],
            )

        return met

    tasks = max(1, -(-rows_in_all // TASK_ROWS), -(-bytes_in_all // TASK_BYTES))
    ranged = elements.repartitionByRange(tasks, "g", "seg").sortWithinPartitions("g", "seg")
    levels = [written(ranged.mapInPandas(first, ROWS), "forest")]
    most = levels[0].agg(F.max("task")).first()[0] or 0
    while True:
        most //= FAN
        lists = levels[-1].where("kind = 'forest'")
        levels.append(written(lists.groupBy(F.floor(F.col("task") / FAN)).applyInPandas(meet(most > 0), ROWS), "forest"))
        if not most:
            break
    roots = levels[0].where("kind = 'root'")
    for level in levels[1:]:
        roots = roots.unionByName(level.where("kind = 'root'"))
    # From the last level down: whoever an end met at an open depth may have ended there itself.
    fields = ["rep", "depth", "n", "leaves", "saved", "child"]
    above = None
    for level in levels[::-1]:
        own = level.where("kind = 'end'")
        now = own.select(*fields, F.col("via").alias("winner"))
        if above is not None:
            later = above.select(F.col("rep").alias("via"), "depth", F.col("winner").alias("later"))
            pending = own.where("NOT final").join(later, ["via", "depth"], "left")
            now = own.where("final").select(*fields, F.col("via").alias("winner")).unionByName(
                pending.select(*fields, F.coalesce("later", "via").alias("winner"))
            )
        above = now if above is None else above.unionByName(now)
    return above, roots.select("g", "rep", "n", "leaves", "saved")


def all_ends(reps: DataFrame, segs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Ends of all sequences (rep, depth, winner, n, leaves, saved, child), and the one that has none (rep)."""
    members = reps.select("rep", "n", F.col("words").alias("rest"), F.lit(0).cast("long").alias("g"))
    rounds = []
    while True:
        own = segs.where(F.col("k") == len(rounds)).select(F.col("conv_id").alias("rep"), "seg", "w")
        here = members.join(own, "rep", "left").select(
            "g", F.coalesce("seg", F.lit("")).alias("seg"), "rep", "n", (F.col("rest") - F.coalesce("w", F.lit(0))).alias("rest")
        )
        here = written(here, "members")
        met = here.groupBy("g", "seg").agg(
            F.min("rep").alias("rep"), F.sum("n").alias("n"), F.count("*").alias("m"), F.max("rest").alias("rest")
        )
        rounds.append(written(met, "elements"))
        shared = rounds[-1].where("m > 1").select("g", "seg", F.col("rep").alias("next"))
        if shared.isEmpty():
            break
        members = here.join(shared, ["g", "seg"]).select("rep", "n", "rest", F.col("next").alias("g"))
    ends, totals = None, None
    for number, met in list(enumerate(rounds))[::-1]:
        elements = met.select("g", "seg", "rep", "n", "m", F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved"))
        if totals is not None:
            deeper = totals.select(F.col("g").alias("rep"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
            shared = elements.where("m > 1").drop("leaves", "saved").join(deeper, "rep").withColumnsRenamed({"l": "leaves", "s": "saved"})
            elements = elements.where("m = 1").unionByName(shared)
        n, in_all = met.agg(F.count("*"), F.sum(F.length("seg"))).first()
        found, totals = forest(elements.drop("m"), in_all or 0, n)
        found = found.withColumn("depth", F.col("depth") + number * size)
        ends = found if ends is None else ends.unionByName(found)
    return ends, totals.select("rep")


def from_depth(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (rep, k, depth, ..) with sums over the rows of the same rep at this depth and below.

    Windows run for each segment; what the segments below add comes from their totals, where a
    conversation has several.
    """
    inside = Window.partitionBy("rep", "k").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("rep").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where("n_turns > size").groupBy("rep", "k").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    totals = totals.select("rep", "k", *[F.coalesce(F.sum(f"_{name}").over(below), F.lit(0)).alias(f"_{name}") for name in sums])
    local = rows.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    single, several = local.where("n_turns <= size"), local.where("n_turns > size").join(totals, ["rep", "k"])
    return single.unionByName(several.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).select(single.columns))


def conversation_trie(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(turns.sparkSession)
    convs, rebuilt = rebuilt_turns(written(placed_turns(turns), "placed"))
    segs, convs = written(segments(rebuilt, size), "segments"), written(convs, "conversations")
    reps = written(distinct_sequences(convs, segs), "sequences")
    ends, root = all_ends(reps, segs, size)
    ends = written(ends, "ends")

    ended = ends.select("rep", F.col("depth").alias("l"), "winner").unionByName(
        root.select("rep", F.lit(-1).cast("long").alias("l"), F.lit(None).cast("long").alias("winner"))
    )
    known = reps.join(ended, "rep")
    places = F.posexplode(F.sequence(F.lit(1), (F.length("seg") / ENTRY).cast("int")))
    own = segs.withColumnRenamed("conv_id", "rep").join(known.where("l < n_turns").drop("words"), "rep").select(
        "rep", "k", "n", "n_turns", "l", "winner", "seg", places.alias("p", "i")
    ).select(
        "rep", "k", "n", "n_turns", "l", "winner", (F.col("k") * size + F.col("i")).alias("depth"),
        F.conv(F.substring("seg", F.col("p") * ENTRY + DIGEST + 1, F.lit(ENTRY - DIGEST)), 16, 10).cast("long").alias("w"),
    ).where("depth > l")
    top = known.where("l < 0").select(
        "rep", F.lit(0).cast("long").alias("k"), "n", "n_turns", "l", "winner", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("w")
    )
    won = ends.groupBy(F.col("winner").alias("rep"), "depth").agg(
        F.sum("n").alias("more"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.sum("child").alias("children")
    )
    zero = F.lit(0).cast("long")
    nodes = own.unionByName(top).join(won, ["rep", "depth"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("more", "more_leaves", "more_saved", "children")} | {"size": F.lit(size)}
    )
    is_leaf = F.when((F.col("depth") == F.col("n_turns")) & (F.col("children") == 0) & (F.col("more") == 0), 1).otherwise(0).cast("long")
    nodes = from_depth(nodes, {"members": F.col("more"), "n_leaves": F.col("more_leaves") + is_leaf})
    nodes = nodes.withColumn("n_convs", F.col("n") + F.col("members"))
    nodes = from_depth(nodes, {"saved_tokens": (F.col("n_convs") - 1) * F.col("w") + F.col("more_saved")})
    # A sequence ends at a node of its own, or, where it only begins others, at one of their owner's.
    last = known.select(F.when(F.col("l") < F.col("n_turns"), F.col("rep")).otherwise(F.col("winner")).alias("rep"), F.col("n_turns").alias("depth"), "ends_sha256")
    return nodes.join(last, ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("l") + 1, F.coalesce("winner", "rep")).otherwise(F.col("rep"))).alias("parent_conv_id"),
        "n_convs", (F.col("children") + (F.col("depth") < F.col("n_turns")).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def trie_sql() -> str:
    """DuckDB SQL for the nodes, from all prefixes of all rebuilt conversations."""
    step = "list_reduce(list_concat([{0}], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: " + step.format("xor(x, b)") + ")"
    return f"""
    WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor({crc}, 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)),
    heads AS (SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
    rebuilt AS (SELECT conv_id, pos AS depth, role, text FROM heads
        UNION ALL
        SELECT t.conv_id, t.pos - c.h + (SELECT count(*) FROM heads x WHERE x.conv_id = c.conv_id), t.role, t.text
        FROM turns t JOIN convs c USING (conv_id) WHERE t.pos > c.h),
    paths AS (SELECT c.conv_id, coalesce(p.path, []) AS path, coalesce(p.sizes, []) AS sizes FROM convs c LEFT JOIN (
        SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY depth) AS path,
            list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY depth) AS sizes FROM rebuilt GROUP BY conv_id) p USING (conv_id)),
    members AS (SELECT conv_id, len(path) AS n_turns, d AS depth, array_to_string(path[1:d], '') AS node,
            CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS w, path
        FROM paths, unnest(range(len(path) + 1)) u(d)),
    nodes AS (SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS saved,
            any_value(path[1:depth]) AS path,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends
        FROM members GROUP BY node, depth),
    family AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
    below AS (SELECT array_to_string(n.path[1:d], '') AS node, sum(n.saved) AS saved, count(*) FILTER (f.n IS NULL) AS leaves
        FROM nodes n LEFT JOIN family f USING (node), unnest(range(n.depth + 1)) u(d) GROUP BY 1)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(f.n, 0)::BIGINT AS n_children,
        b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
    FROM nodes n LEFT JOIN nodes p ON p.node = n.above AND n.depth > 0 LEFT JOIN family f ON f.node = n.node JOIN below b ON b.node = n.node"""
