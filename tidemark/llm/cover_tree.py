"""Hard negatives by a cover tree over norm-augmented candidates.

Every row is a node of a cover tree in the space where a larger inner product is a shorter distance
(``vectors.Space``). Its upper level is a bounded set of routers fitted on a sample; each row hangs below the
nearest. Below a router the rows are split into blocks of bounded size, and every block is a cover tree of its
own: at each level, at half the radius of the one above, a node keeps what it covers and the rest gets new nodes
that lie farther apart than that radius. The tree is a written table, a row for each node.

A search bounds the inner products below a node by its covering radius. Routers and nodes outside a window of
scores are skipped, the others are taken best first, and what a node's children score is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import vectors as vc
from tidemark.plans.staging import stage

ROUTERS, ROUTER_SAMPLE = 64, 4096
#: Rows of a block, and searches worked on with a block at once.
BLOCK, PROBE_BLOCK = 4096, 4096
_LEAST = -(2**63) + 1


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points as nodes, level by level; first child, number of children and covering radius of each.

    The children of a node stand together; the radius is the largest distance to a point below the node.
    """
    if not len(points):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    middle = int(vc.distances(points, points.mean(0)[None])[:, 0].argmin())
    order = [middle]
    below = [np.delete(np.arange(len(points)), middle)]
    first, count, radius = [], [], []
    at = 0
    while at < len(order):
        node, rest = order[at], below[at]
        apart = vc.distances(points[rest], points[node][None])[:, 0]
        reach = float(apart.max(initial=0.0))
        radius.append(reach)
        first.append(len(order))
        least = 1e-9 * (1 + float(np.abs(points[node]).max(initial=0)))
        while len(rest):
            reach /= 2
            if reach <= least:  # copies of the node: children of their own
                order.extend(rest.tolist())
                below.extend([rest[:0]] * len(rest))
                break
            far = rest[apart > reach]
            while len(far):
                child, far = far[0], far[1:]
                near = vc.distances(points[far], points[child][None])[:, 0] <= reach
                order.append(int(child))
                below.append(far[near])
                far = far[~near]
            rest, apart = rest[apart <= reach], apart[apart <= reach]
        count.append(len(order) - first[-1])
        below[at] = rest[:0]
        at += 1
    return np.array(order), np.array(first), np.array(count), np.array(radius)


class Index:
    """The written tree: nodes by (dim, cell, block), and for each (dim, cell) its rows, blocks and covering radius."""

    def __init__(self, rows: DataFrame, keep: list[str], routers: int = ROUTERS, sample: int = ROUTER_SAMPLE, seed: int = 11, block: int = BLOCK):
        self.space = space = vc.Space(rows, routers, sample, seed)
        kept = rows.select("row", "dim", "vec", *keep)
        with_cell = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", cell int, apart double"

        def route(batches):
            for batch in batches:
                for dim, part in vc.by_dim(batch):
                    points = space.lifted(vc.decode(part.column(2), dim), dim)
                    cell, apart = space.nearest(points, dim)
                    if dim not in space.pivots:
                        apart = np.full(len(points), np.inf)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(apart)], names=[*part.schema.names, "cell", "apart"])

        routed = stage(kept.mapInArrow(route, with_cell))
        self.cells = routed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
        self.blocks = {(r["dim"], r["cell"]): -(-r["n"] // block) for r in self.cells}
        counts = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("cell") == c), n) for (d, c), n in self.blocks.items() if n > 1], F.lit(1))
        blocked = routed.withColumn("block", F.pmod(F.xxhash64("row"), counts).cast("int"))
        out = blocked.drop("apart").withColumns({"node": F.lit(0), "first_child": F.lit(0), "children": F.lit(0), "radius": F.lit(0.0)})

        def build(table: pa.Table) -> pa.Table:
            dim = table["dim"][0].as_py()
            table = table.sort_by("row")
            nodes, first, count, radius = cover_tree(space.lifted(vc.decode(table["vec"], dim), dim))
            table = table.drop_columns("apart").take(pa.array(nodes))
            extra = {"node": pa.array(np.arange(len(nodes)), pa.int32()), "first_child": pa.array(first, pa.int32()),
                     "children": pa.array(count, pa.int32()), "radius": pa.array(radius, pa.float64())}
            for name, values in extra.items():
                table = table.append_column(name, values)
            return table

        self.nodes = stage(blocked.groupBy("dim", "cell", "block").applyInArrow(build, out.schema))
        self.keep = keep


def search(index: Index, probes: DataFrame, same_label: bool, k: int, cells: str = "all", probe_block: int = PROBE_BLOCK) -> DataFrame:
    """(probe, row, id, score): of each probe the ``k`` best nodes whose score lies in [low, high].

    ``probes`` has probe, row, dim, vec, label, low, high; a node must have the probe's label, or any other label
    with ``same_label=False``, and not be its row. Ties go to the smaller id, null after all others. ``cells`` takes
    the router next to the probe (``home``), those but that one (``away``), or ``all``; always only routers whose
    bounds meet the window.
    """
    space = index.space
    # per dimension: cells, their radii and numbers of blocks; the centres are the pivots
    known: dict[int, tuple] = {}
    for dim in {r["dim"] for r in index.cells}:
        here = sorted((r for r in index.cells if r["dim"] == dim), key=lambda r: r["cell"])
        known[dim] = ([r["cell"] for r in here], np.array([r["radius"] for r in here]), np.array([index.blocks[dim, r["cell"]] for r in here]))
    fields = "probe bigint, row bigint, dim int, vec binary, label int, low bigint, high bigint"
    chosen = probes.select("probe", "row", "dim", "vec", "label", "low", "high").where("low <= high")
    slices = max(1, -(-chosen.count() // probe_block))

    def route(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                for dim, part in vc.by_dim(whole.slice(start, 1024)):
                    if dim not in known:
                        continue
                    cells_, radius, blocks = known[dim]
                    values = vc.decode(part.column(3), dim)
                    meets = np.ones((part.num_rows, len(cells_)), bool)
                    if dim in space.pivots:
                        centres = space.pivots[dim][np.array(cells_) - space.first[dim]]
                        apart = vc.distances(space.stretched(values, dim), centres)
                        length = np.sqrt((values.astype(float) ** 2).sum(1))[:, None]
                        least, most = vc.scores_between(np.maximum(0, apart - radius - space.slack(dim)), apart + radius + space.slack(dim), length, space.most[dim])
                        margin = 1e-6 * (np.abs(most) + np.abs(least) + 1)
                        meets = (most + margin >= part.column(5).to_numpy()[:, None]) & (least - margin <= part.column(6).to_numpy()[:, None])
                        home = apart.argmin(1)
                    else:
                        home = np.zeros(part.num_rows, np.int64)
                    if cells == "home":
                        meets &= np.arange(len(cells_)) == home[:, None]
                    elif cells == "away":
                        meets &= np.arange(len(cells_)) != home[:, None]
                    at, cell = np.nonzero(meets)
                    of = np.repeat(np.arange(len(at)), blocks[cell])
                    block = np.arange(len(of)) - np.repeat(np.cumsum(blocks[cell]) - blocks[cell], blocks[cell])
                    at, cell = at[of], np.array(cells_)[cell[of]]
                    for a in range(0, len(at), 1 << 15):
                        taken = part.take(pa.array(at[a : a + (1 << 15)]))
                        yield pa.RecordBatch.from_arrays(
                            [*taken.columns, pa.array(cell[a : a + (1 << 15)], pa.int32()), pa.array(block[a : a + (1 << 15)], pa.int32())],
                            names=[*part.schema.names, "cell", "block"])

    routed = chosen.mapInArrow(route, f"{fields}, cell int, block int").withColumn("slice", F.pmod(F.xxhash64("probe"), F.lit(slices)).cast("int"))
    nodes = index.nodes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    id_type = index.nodes.schema["id"].dataType.simpleString()
    unit = ["dim", "cell", "block", "slice"]

    def descend(probes_: pa.Table, tree: pa.Table) -> pa.Table:
        if not probes_.num_rows or not tree.num_rows:
            return _none(id_type)
        return _descend(probes_, tree.sort_by("node"), space, same_label, k)

    found = routed.groupBy(*unit).cogroup(nodes.groupBy(*unit)).applyInArrow(descend, f"probe bigint, row bigint, id {id_type}, score bigint")
    return best_of(found, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("probe").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _none(id_type: str) -> pa.Table:
    return pa.table({"probe": pa.array([], pa.int64()), "row": pa.array([], pa.int64()),
                     "id": pa.array([], pa.int32() if id_type == "int" else pa.string() if id_type == "string" else pa.int64()), "score": pa.array([], pa.int64())})


def _descend(probes: pa.Table, tree: pa.Table, space: vc.Space, same_label: bool, k: int) -> pa.Table:
    """All probes of a unit go down one tree together, each along its own best nodes."""
    dim = tree["dim"][0].as_py()
    asked, points = vc.decode(probes["vec"], dim), vc.decode(tree["vec"], dim)
    stretched, lifted = space.stretched(asked, dim), space.lifted(points, dim)
    length = np.sqrt((asked.astype(float) ** 2).sum(1))
    first, count, radius = (tree[c].to_numpy() for c in ("first_child", "children", "radius"))
    node_row, node_label = tree["row"].to_numpy(), tree["label"].to_numpy()
    row, label, high = (probes[c].to_numpy() for c in ("row", "label", "high"))
    least = probes["low"].to_numpy().copy()  # what a node must score to be among the probe's best
    null, value = vc.order_of(tree["id"].combine_chunks())
    rank = np.empty(len(points), np.int64)
    rank[np.lexsort((node_row, value, null))] = np.arange(len(points))
    best_score = np.full((len(asked), k), _LEAST)
    best_node = np.full((len(asked), k), -1)

    def weigh(who: np.ndarray, which: np.ndarray, scores: np.ndarray) -> None:
        """Takes the scores who x which into the best of ``who``."""
        fits = (scores >= least[who][:, None]) & (scores <= high[who][:, None]) & (node_row[which] != row[who][:, None])
        fits &= (node_label[which] == label[who][:, None]) == same_label
        for i in np.flatnonzero(fits.any(1)):
            new = np.flatnonzero(fits[i])
            score = np.concatenate([best_score[who[i]], scores[i, new]])
            node = np.concatenate([best_node[who[i]], which[new]])
            order = np.lexsort((np.where(node >= 0, rank[node], len(points)), -score))[:k]
            best_score[who[i]], best_node[who[i]] = score[order], node[order]
            least[who[i]] = max(least[who[i]], score[order][-1])

    def bounds(who: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = vc.distances(stretched[who], lifted[which])
        reach = radius[which] + space.slack(dim)
        low, top = vc.scores_between(np.maximum(0, apart - reach), apart + reach, length[who][:, None], space.most[dim])
        margin = 1e-6 * (np.abs(low) + np.abs(top) + 1)
        return low - margin, top + margin

    everyone, root = np.arange(len(asked)), np.zeros(1, np.int64)
    weigh(everyone, root, vc.inner_products(asked, points[:1]))
    # open nodes of the probes: (probe, node, bound from above)
    at, node = everyone, np.zeros(len(asked), np.int64)
    top = np.full(len(asked), np.inf)
    while len(at):
        # the best open node of each probe is opened, for all probes that chose the same node at once
        order = np.lexsort((node, -top, at))
        at, node, top = at[order], node[order], top[order]
        lead = np.ones(len(at), bool)
        lead[1:] = at[1:] != at[:-1]
        who, which = at[lead], node[lead]
        at, node, top = at[~lead], node[~lead], top[~lead]
        opened = []
        for n in np.unique(which):
            mine, children = who[which == n], np.arange(first[n], first[n] + count[n])
            for part in range(0, len(mine), 512):
                some = mine[part : part + 512]
                weigh(some, children, vc.inner_products(asked[some], points[children]))
                inner = children[count[children] > 0]
                if len(inner):
                    low, above = bounds(some, inner)
                    i, j = np.nonzero((above >= least[some][:, None]) & (low <= high[some][:, None]))
                    opened.append((some[i], inner[j], above[i, j]))
        if opened:
            at = np.concatenate([at, *[o[0] for o in opened]])
            node = np.concatenate([node, *[o[1] for o in opened]])
            top = np.concatenate([top, *[o[2] for o in opened]])
        still = top >= least[at]
        at, node, top = at[still], node[still], top[still]
    i, j = np.nonzero(best_node >= 0)
    return pa.table({"probe": probes["probe"].take(pa.array(i)), "row": pa.array(node_row[best_node[i, j]]),
                     "id": tree["id"].take(pa.array(best_node[i, j])), "score": pa.array(best_score[i, j])})


def hard_negatives(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, percent: int = 80,
    routers: int = ROUTERS, sample: int = ROUTER_SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``rows`` come from ``vectors.whole_numbers`` with columns ``id`` and ``label`` (int, not null). A row's score is
    its inner product with the anchor. Positives are the anchor's first ``n_positives`` other rows of its label,
    negatives the first ``n_negatives`` rows of other labels with percent * positive_score <= 100 * negative_score <=
    100 * positive_score; higher scores first, then the smaller id, null last. Fewer rows give fewer results, a
    positive without negatives none; rows of equal id or content are rows of their own; only rows of the anchor's
    dimension are compared. Without rows or anchors there are no rows. Routers are fitted on ``sample`` rows, all
    rows are indexed, and the result does not depend on the choice.
    """
    index = Index(rows, ["id", "label"], routers, sample, block=block)
    anchors = rows.where(is_anchor).select(F.col("row").alias("probe"), "row", "dim", "vec", "label", "id")
    everything = {"low": F.lit(_LEAST), "high": F.lit(2**63 - 1)}
    near = stage(search(index, anchors.withColumns(everything), True, n_positives, "home"))
    # elsewhere only what beats the last positive found at home
    known = near.groupBy("probe").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    others = anchors.withColumns(everything).join(known, "probe", "left").withColumn(
        "low", F.when(F.col("_n") >= n_positives, F.col("_least")).otherwise(F.col("low")))
    positives = stage(best_of(near.unionByName(search(index, others, True, n_positives, "away")), n_positives).join(
        anchors.select("probe", F.col("id").alias("anchor_id")), "probe"))
    # one window for each different score among the positives of an anchor
    windows = positives.select("probe", F.col("score").alias("high")).distinct().withColumn(
        # the smallest whole number not under percent / 100 of it; a negative score leaves no window
        "low", F.when(F.col("high") >= 0, F.expr(f"(high div 100) * {percent} + ((high % 100) * {percent} + 99) div 100")))
    windows = windows.where("low is not null").join(anchors, "probe").select(F.col("probe").alias("anchor"), "row", "dim", "vec", "label", "low", "high")
    windows = stage(windows.withColumn("probe", F.monotonically_increasing_id()))
    negatives = search(index, windows, False, n_negatives).select("probe", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("row").alias("negative_row"))
    found = negatives.join(windows.select("probe", "anchor", "high"), "probe")
    place = Window.partitionBy("anchor", "positive_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    pairs = positives.select(F.col("probe").alias("anchor"), "anchor_id", F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    return pairs.join(found, (pairs["anchor"] == found["anchor"]) & (pairs["positive_score"] == found["high"])).drop(found["anchor"]).withColumn(
        "rank", F.row_number().over(place)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
