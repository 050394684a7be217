"""Mixing sources to target weights with a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to) and size class.
The flow routes token capacity from patterns to source quotas; a pattern's tokens may be taken up to
``MOST`` times and each repetition costs more than the one before (0, 1, 3, ...: convex), so repeats are
spread before they pile up. What a pattern gives is then made up of whole documents: as many full copies of
all as fit, and of the rest a seeded choice in each size class, with one last fitting of the gaps.

Only patterns and size classes reach the driver, and their number is checked; documents never do.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.staging import stage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken so often at most.
MOST = 3
#: Patterns the driver may be asked to route.
PATTERN_LIMIT = 100_000
#: A size class is cut into ranges of the hash, buckets; its border falls into one, and only that one is ordered.
#: There are at least so many, and about as many as the square root of the largest class' rows.
BUCKETS = 256
#: Documents of a class, from its border on, that may fill the gaps.
SPARE = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float]) -> np.ndarray:
    """Shares of the total by weight, none above MOST times its source's size; the excess goes to the others.

    By rising size-to-weight ratio the first sources are full and the rest share what is left.
    """
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    left = size.sum()
    while open_.any():
        share = left * weight[open_] / weight[open_].sum()
        over = share > MOST * size[open_]
        if not over.any():
            out[open_] = share
            break
        full = np.flatnonzero(open_)[over]
        out[full] = MOST * size[full]
        left -= out[full].sum()
        open_[full] = False
    return out


def route(capacity: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float]) -> np.ndarray:
    """Tokens that each pattern gives to each of its sources: a min-cost flow, one level of cost after the other.

    A pattern's n-th repetition costs n (n - 1) / 2 a token; the flow is the largest the capacities allow. Only
    the arcs that leave the start have a cost, so cheapest augmenting paths use up a level before the
    next: each level's arcs are opened in turn and the flow is raised to a largest one by blocking flows.
    10,000 patterns of some of 20 sources take seconds. Returns patterns x sources, as a dense array over the sources.
    """
    n, m = len(capacity), len(quota)
    # nodes: patterns, sources, start, end; an arc and its reverse are numbers 2k and 2k + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[float] = []
    start, end = n + m, n + m + 1

    def arc(a, b, free):
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((free, 0.0))

    for i in range(n):
        arc(start, i, 0.0)
    for i in range(n):
        for j in members[i]:
            arc(i, n + j, float("inf"))
    for j, q in enumerate(quota):
        arc(n + j, end, float(q))
    tiny = 1e-9 * max(1.0, float(np.sum(quota)))

    def depths():
        """Steps from the start to each node along arcs with room; -1 where there is no way."""
        depth = [-1] * len(graph)
        depth[start] = 0
        queue = deque([start])
        while queue:
            a = queue.popleft()
            for k in graph[a]:
                if room[k] > tiny and depth[to[k]] < 0:
                    depth[to[k]] = depth[a] + 1
                    queue.append(to[k])
        return depth

    def block(depth):
        """Fill all shortest ways; each arc is left for good once it leads nowhere."""
        turn = [0] * len(graph)
        path: list[int] = []
        a = start
        while True:
            if a == end:
                amount = min(room[k] for k in path)
                for k in path:
                    room[k] -= amount
                    room[k ^ 1] += amount
                # back to the first arc that is full
                cut = next(i for i, k in enumerate(path) if room[k] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while turn[a] < len(graph[a]):
                k = graph[a][turn[a]]
                if room[k] > tiny and depth[to[k]] == depth[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append(graph[a][turn[a]])
                a = to[path[-1]]
            elif a == start:
                return
            else:
                a = to[path.pop() ^ 1]
                turn[a] += 1

    for _ in range(MOST):
        for i, c in enumerate(capacity):
            room[2 * i] += float(c)
        while (depth := depths())[end] >= 0:
            block(depth)
    out = np.zeros((n, m))
    at = 2 * n
    for i in range(n):
        for j in members[i]:
            out[i, j] += room[at + 1]
            at += 2
    return out


def plan(patterns: DataFrame, weights: Sequence[float] = WEIGHTS) -> tuple[list[tuple], list[tuple]]:
    """From (sources array, size): rows (source, source_size, target), and rows (sources, give).

    Sources come by code point, null last, and take the weights in turn.
    """
    rows = [(tuple(r[0]), int(r[1])) for r in patterns.limit(PATTERN_LIMIT + 1).collect()]
    if len(rows) > PATTERN_LIMIT:
        raise ValueError(f"more than {PATTERN_LIMIT} membership patterns; group sources before mixing")
    names = sorted({s for sources, _ in rows for s in sources}, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    number = {s: i for i, s in enumerate(names)}
    rows.sort(key=lambda r: [number[s] for s in r[0]])
    # a document counts with each of its sources, the total counts it once
    size = np.zeros(len(names))
    for sources, n in rows:
        for s in sources:
            size[number[s]] += n / len(sources)
    goal = targets(size, [weights[i % len(weights)] for i in range(len(names))])
    flow = route([n for _, n in rows], [[number[s] for s in sources] for sources, _ in rows], goal)
    return (
        [(s, float(size[i]), float(goal[i])) for s, i in number.items()],
        [(list(sources), float(flow[i].sum())) for i, (sources, _) in enumerate(rows)],
    )


def _keyed(documents: DataFrame, memberships: Column, size: Column, seed: int) -> DataFrame:
    """Each document as ``_row``, with what the mix needs of it; its own columns' names do not matter."""
    alone = F.array(F.lit(None).cast("string"))
    sources = F.array_sort(F.array_distinct(F.when(memberships.isNull() | (F.size(memberships) == 0), alone).otherwise(memberships)))
    told = documents.select(F.struct("*").alias("_row"), sources.alias("_sources"), size.alias("_size"), F.xxhash64("doc_id", F.lit(seed)).alias("_hash"))
    return told.withColumn("_class", F.floor(F.log2(F.greatest("_size", F.lit(1)))).cast("int"))


def bucket_bits(rows: int) -> int:
    """Leading bits of the hash that tell a bucket: so many that buckets, and rows of a bucket, are about sqrt(rows)."""
    return max(BUCKETS.bit_length() - 1, math.ceil(math.log2(max(1, rows)) / 2))


def plan_mix(documents: DataFrame, memberships: Column, size: Column, weights: Sequence[float] = WEIGHTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """What ``apply_mix`` needs, one row per pattern and size class, and the sources with size and target.

    ``documents`` needs doc_id and what the two columns are made of. A row tells how many copies every
    document of its class gives (``_base``) and which ones give one more: those with a hash up to ``_edge``
    and those whose hash is in ``_extra``.
    """
    spark = documents.sparkSession
    key = stage(_keyed(documents, memberships, size, seed).select("_sources", "_size", "_hash", "_class"))
    largest = key.where("_size > 0").groupBy("_sources", "_class").count().agg(F.max("count")).first()[0]
    shift = 64 - bucket_bits(largest or 0)
    key = key.withColumn("_bucket", F.shiftright("_hash", shift))
    quotas, gives = plan(key.groupBy("_sources").agg(F.sum("_size").alias("total")), weights)
    source_table = spark.createDataFrame(quotas, "_source string, source_size double, target double")
    give = spark.createDataFrame(gives, "_p array<string>, _give double")

    sums = key.where("_size > 0").groupBy("_sources", "_class", "_bucket").agg(F.sum("_size").alias("s"), F.count("*").alias("n"))
    times = sums.groupBy("_sources").agg(F.sum("s").alias("w")).join(give, F.expr("_sources <=> _p")).select(
        F.col("_sources").alias("_q"), (F.col("_give") / F.col("w")).alias("_times")).withColumn(
        "_base", F.least(F.floor(F.col("_times") + 1e-9), F.lit(MOST)).cast("int"))
    by_class = Window.partitionBy("_sources", "_class")
    upto = by_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    goals = stage(sums.join(times, F.expr("_sources <=> _q")).withColumns({
        "_goal": F.sum("s").over(by_class) * F.greatest(F.col("_times") - F.col("_base"), F.lit(0.0)), "_upto": F.sum("s").over(upto), "_rows_upto": F.sum("n").over(upto),
    }).select("_sources", "_class", "_bucket", "_base", "_goal", "_upto", "_rows_upto", "s"))
    passed = F.col("_upto") > F.col("_goal") + 1e-6
    cut = stage(goals.groupBy(F.col("_sources").alias("_q"), F.col("_class").alias("_c")).agg(
        F.min("_base").alias("_base"), F.min("_goal").alias("_goal"), F.min(F.when(passed, F.col("_bucket"))).alias("_border"),
        F.min(F.when(passed, F.col("_upto") - F.col("s"))).alias("_before"), (F.min(F.when(passed, F.col("_rows_upto"))) + SPARE).alias("_need")))
    # only the border buckets are ordered, with as many after them as hold the spare documents
    mine = F.expr("_sources <=> _q AND _class = _c")
    last = goals.join(cut.select("_q", "_c", "_need"), mine).where("_rows_upto >= _need").groupBy("_q", "_c").agg(F.min("_bucket").alias("_last"))
    cut = stage(cut.join(last.select(F.col("_q").alias("_w"), F.col("_c").alias("_v"), "_last"), F.expr("_q <=> _w AND _c = _v"), "left").drop("_w", "_v", "_need"))
    # documents of one hash go together
    border = key.join(cut, mine).where(F.col("_size") > 0).where(F.col("_bucket").between(F.col("_border"), F.coalesce("_last", F.lit(2**63 - 1)))).groupBy(
        "_sources", "_class", "_bucket", "_hash").agg(F.sum("_size").alias("_size"), F.first("_goal").alias("_goal"), F.first("_before").alias("_before"))
    walk = by_class.orderBy("_bucket", "_hash")
    walked = stage(border.withColumn("_cum", F.col("_before") + F.sum("_size").over(walk.rowsBetween(Window.unboundedPreceding, 0))).withColumns({
        "_in": F.col("_cum") <= F.col("_goal") + 1e-6, "_rank": F.row_number().over(walk)}))
    edges = walked.groupBy(F.col("_sources").alias("_w"), F.col("_class").alias("_v")).agg(
        F.max(F.when(F.col("_in"), F.col("_hash"))).alias("_edge"), F.max(F.when(F.col("_in"), F.col("_cum"))).alias("_reached"),
        F.coalesce(F.max(F.when(F.col("_in"), F.col("_rank"))), F.lit(0)).alias("_rows"))
    edges = stage(cut.join(edges, F.expr("_q <=> _w AND _c = _v"), "left").drop("_w", "_v", "_last"))
    spare = walked.where("NOT _in").join(edges.select("_q", "_c", "_rows"), mine).where(F.col("_rank") <= F.col("_rows") + SPARE)
    pool = spare.groupBy("_sources").agg(F.sort_array(F.collect_list(F.struct("_size", "_hash")), asc=False).alias("_pool"))
    gap = edges.groupBy(F.col("_q").alias("_g")).agg(F.sum(F.coalesce(F.col("_goal") - F.coalesce("_reached", "_before"), F.lit(0.0))).alias("_gap"))
    # at most SPARE documents of each size class, largest first: each that still fits
    start = F.struct(F.col("_gap").alias("left"), F.expr("cast(array() AS array<bigint>)").alias("took"))
    step = lambda a, d: F.when(
        d["_size"] <= a["left"],
        F.struct((a["left"] - d["_size"]).alias("left"), F.concat(a["took"], F.array(d["_hash"])).alias("took")),
    ).otherwise(a)
    extra = pool.join(gap, F.expr("_sources <=> _g")).select(
        F.col("_sources").alias("_e"), F.reduce("_pool", start, step, lambda a: a["took"]).alias("_extra"))
    # where the border's bucket gives none, all buckets below it do: the hash before its first
    edge = F.coalesce("_edge", F.when(F.col("_border") > -(2 ** (63 - shift)), F.shiftleft("_border", shift) - 1))
    plan_table = edges.join(extra, F.expr("_q <=> _e"), "left").select("_q", "_c", "_base", edge.alias("_edge"), "_extra")
    return stage(plan_table), source_table


def apply_mix(
    documents: DataFrame, plan_table: DataFrame, memberships: Column, size: Column, seed: int = 17,
    names: tuple[str, str, str] = ("_sources", "_size", "_copies"),
) -> DataFrame:
    """``documents`` with its sources, size and copies under ``names``: copies tell how often the mix takes a document, 0 to 3.

    The plan has a row per pattern and size class, so it is small and documents are not shuffled by it.
    Defined cases: a null or empty membership is a source of its own, named null, which comes last;
    documents of size 0 and those a plan does not know are never taken; rows that repeat a doc_id are taken
    alike; a null doc_id is an id like any other; no rows give no rows. A column that has one of the ``names`` already is
    an error, other columns go along.
    """
    if taken := {n.lower() for n in names} & {c.lower() for c in documents.columns}:
        raise ValueError(f"documents have a column {', '.join(sorted(taken))}: pass other names")
    keyed = _keyed(documents, memberships, size, seed)
    told = keyed.join(plan_table, F.expr("_sources <=> _q AND _class = _c"), "left")
    one_more = F.coalesce(F.col("_hash") <= F.col("_edge"), F.lit(False)) | F.coalesce(F.array_contains("_extra", F.col("_hash")), F.lit(False))
    copies = F.when((F.col("_size") > 0) & F.col("_base").isNotNull(), F.least(F.col("_base") + one_more.cast("int"), F.lit(MOST))).otherwise(0)
    return told.select("_row.*", F.col("_sources").alias(names[0]), F.col("_size").alias(names[1]), copies.cast("int").alias(names[2]))
