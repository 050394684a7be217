"""Near-duplicates by min-max hashing.

Each of ``PERMUTATIONS`` random permutations of the shingle space gives two signature values, its
minimum and its maximum over a document's shingles, so half the hash evaluations make a signature of
the same length; both agree between two documents with the probability of their Jaccard similarity.
Bands of ``ROWS`` values, all minima or all maxima, are bucket keys: at similarity 0.8 two documents
miss all 32 buckets with probability (1 - 0.8^4)^32 = 5e-8.

Candidates are confirmed on their whole shingle sets. No bucket is expanded into all pairs: copies with
one set are one node; in a bucket every node is compared with the most ordinary one, and after the
components of these links only nodes outside the bucket's main component are compared with the rest of it.
A pair is left out only where an exact bound on the intersection rules a link out: shingles that one
candidate alone has are in none, and in each part of the shingle space the smaller count is the most. Two nodes that share a bucket are thus compared, or known to be in one component already,
or cannot link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.tables import unused
from tidemark.llm.words import distinct_windows, lists, mix, slices, windows, words
from tidemark.plans.staging import stage

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Parts of the shingle space in which two sets' sizes bound their intersection.
PARTS = 64
#: Rounds of comparing a bucket with one of the nodes outside its main component, before it is with all of them.
STAR_ROUNDS = 1

_random = np.random.default_rng(4242)
_FACTORS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows x 2 PERMUTATIONS: minima, then maxima. Every row must have a shingle."""
    out = np.empty((len(starts) - 1, 2 * PERMUTATIONS), np.uint64)
    for i, (a, b) in enumerate(zip(_FACTORS, _SHIFTS)):
        value = hashes * a + b
        value ^= value >> np.uint64(32)
        value *= np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = np.minimum.reduceat(value, starts[:-1])
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(value, starts[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS keys; each holds the number of its band."""
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(_BAND_SALTS, grouped.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0xC6A4A7935BD1E995) + grouped[:, :, j])
    return key


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = words(part.column(1))
    return distinct_windows(*windows(w.hashes(lower=True), w.first, k))


def _sketch(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys): 128 bits that name the set, and the bucket keys; none for an empty set."""

    def run(batches):
        for part in slices(batches):
            hashes, starts = _sets(part, k)
            n = np.diff(starts)
            some = np.flatnonzero(n)
            keys = np.zeros((len(some), BANDS), np.uint64)
            names = np.zeros((2, len(n)), np.uint64)
            if len(some):
                kept = np.append(starts[:-1][some], starts[-1])
                keys = band_keys(signatures(hashes, kept))
                for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                    names[i, some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), kept[:-1]) + n[some].astype(np.uint64))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
            yield pa.record_batch(
                [part.column(0), pa.array(n.astype(np.int64)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                 lists(keys.ravel().view(np.int64), ends, pa.int64())], ["doc_id", "n_shingles", "s1", "s2", "keys"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def _shingle_sets(documents: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            hashes, starts = _sets(part, k)
            rows = len(starts) - 1
            place = np.repeat(np.arange(rows), np.diff(starts)) * PARTS + (hashes % np.uint64(PARTS)).astype(np.int64)
            sizes = np.bincount(place, minlength=rows * PARTS).astype(np.int32)
            yield pa.record_batch(
                [part.column(0), lists(hashes.view(np.int64), starts, pa.int64()), lists(sizes, np.arange(rows + 1) * PARTS, pa.int32())],
                ["doc_id", "set", "sizes"])

    return documents.mapInArrow(run, "doc_id long, set array<long>, sizes array<int>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return met.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct()


def _pairs(entries: DataFrame, others: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """Candidates (a < b) of one bucket, each once, as far as their sizes allow a link.

    An intersection holds none of the shingles that only one of all candidates has, so it is no larger
    than the smaller number of shared shingles ``c``, nor, with ``apart``, than the sum of the smaller numbers
    ``sizes`` in each part of the shingle space; a link needs percent / (100 + percent) of both sizes.
    """
    more = [F.col("component").alias("p"), F.col("sizes").alias("other_sizes")] if apart else []
    other = others.select(F.col("key").alias("k"), F.col("node").alias("o"), F.col("n").alias("m"), F.col("c").alias("d"), *more)
    met = (F.col("key") == F.col("k")) & (F.col("node") != F.col("o")) & ((100 + percent) * F.least("c", "d") >= percent * (F.col("n") + F.col("m")))
    if apart:
        most = F.aggregate(F.zip_with("sizes", "other_sizes", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
        met &= (F.col("component") != F.col("p")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("m")))
    return entries.join(other, met).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``documents``.

    A document's set holds the distinct ``k``-word shingles of its text with A-Z lower-cased, or with
    fewer words the whole sequence; links join sets with 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable, the document's own included; kept is doc_id =
    component_id.

    Defined cases: null, empty and blank texts have an empty set, link with nothing and are kept. Rows
    with one doc_id are one vertex with each of their texts. A null doc_id joins the class of its text
    and names no component: it is kept only if that class has no id. Other columns are ignored.
    """
    sketch = stage(_sketch(documents, k))
    solid = sketch.where("n_shingles > 0")
    # copies with one set are one node, named by their smallest id
    classes = stage(solid.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")))
    named = classes.where("node IS NOT NULL").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "node", "n")
    of_class = (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))
    # buckets of two sets or more; copies fall together before the shuffle, and no bucket is gathered
    buckets = solid.select("s1", "s2", F.explode("keys").alias("key"))
    crowded = buckets.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    crowded = buckets.join(crowded, F.col("key") == F.col("k"), "left_semi").distinct()
    entries = stage(crowded.join(named, of_class).select("key", "node", "n"))
    nodes = entries.select("node").distinct()
    wanted = stage(documents.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("node"), "left_semi"))
    sets = stage(_shingle_sets(wanted, k).select(F.col("doc_id").alias("node"), "set", "sizes").where(F.size("set") > 0))

    # shingles that no other candidate has cannot be in an intersection
    lone = sets.select("node", F.explode("set").alias("h")).groupBy("h").agg(F.min("node").alias("w"), F.count("*").alias("df")).where("df = 1")
    lone = lone.groupBy("w", F.col("h").bitwiseAND(PARTS - 1).cast("int").alias("part")).agg(F.count("*").cast("int").alias("u")).groupBy("w").agg(
        F.sum("u").alias("u"), F.map_from_entries(F.collect_list(F.struct("part", "u"))).alias("by_part"))
    # an id with several texts keeps all of its shingles: they cannot be told apart here
    several = sets.groupBy("node").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("node").alias("x"))
    lone = lone.join(several, F.col("w") == F.col("x"), "left_anti")
    rest = F.transform("sizes", lambda s, i: s - F.coalesce(F.col("by_part")[i], F.lit(0)))
    shared = stage(sets.join(lone, F.col("node") == F.col("w"), "left").select(
        F.col("node").alias("w"), F.coalesce("u", F.lit(0)).alias("u"), F.when(F.col("by_part").isNull(), F.col("sizes")).otherwise(rest).alias("sizes")))
    counts = shared.groupBy("w").agg(F.min("u").alias("u"))
    entries = stage(entries.join(counts, F.col("node") == F.col("w")).withColumn("c", F.col("n") - F.col("u")).where(
        100 * F.col("c") >= percent * F.col("n")).select("key", "node", "n", "c"))

    # a bucket's most ordinary node, the one with the fewest shingles of its own, is compared with all
    ordinary = lambda e: e.groupBy("key").agg(F.min(F.struct(
        (F.col("n") - F.col("c")).alias("u"), *e.columns[1:])).alias("o")).select("key", *[F.col(f"o.{c}").alias(c) for c in e.columns[1:]])
    pairs = stage(_pairs(entries, ordinary(entries), percent))
    links = stage(_confirmed(pairs, sets, percent))
    for turn in range(STAR_ROUNDS + 1):
        parts = connected_components(links)
        placed = stage(entries.join(parts.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left").select(
            "key", "node", "n", "c", F.coalesce("component", "node").alias("component")))
        groups = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
        main = groups.groupBy("key").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("groups")).where("groups > 1").select(
            F.col("key").alias("k"), F.col("m.component").alias("main"))
        # of an id with several texts, each text's sizes
        open_ = stage(placed.join(main, F.col("key") == F.col("k")).join(shared.select("w", "sizes"), F.col("node") == F.col("w")).drop("k", "w"))
        outside = open_.where("component != main").drop("main")
        found = _pairs(open_, ordinary(outside) if turn < STAR_ROUNDS else outside, percent, True)
        fresh = stage(found.join(pairs, ["a", "b"], "left_anti"))
        if turn == STAR_ROUNDS and fresh.isEmpty():
            break
        links = links.unionByName(stage(_confirmed(fresh, sets, percent)))
        pairs = pairs.unionByName(fresh)
    else:
        parts = connected_components(links)
    # an id that names several classes ties them together, as links do
    repeated = solid.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("r"))
    ties = stage(solid.join(repeated, F.col("doc_id") == F.col("r"), "left_semi").join(named, of_class).select("doc_id", "node").distinct())
    if not ties.isEmpty():
        parts = connected_components(links.select("a", "b").union(ties))
    least = classes.join(parts.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left").select(
        F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("component", "node").alias("least"))
    solid = solid.join(least, of_class, "left")
    out = solid.select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(
        sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def dedup(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of rows that repeat one doc_id the one with the least text stays. Rows without an id always stay, and of rows with
    null, empty or blank texts each id. Other columns, whatever their names, go along; no rows give no rows.
    """
    keep, once, rank, n = (unused(name, documents) for name in ("_keep", "_once", "_rank", "_n"))
    kept = near_duplicates(documents, k, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(keep)).distinct()
    chosen = documents.join(kept, F.col("doc_id") == F.col(keep), "left_semi")
    twice = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1)
    many = twice.select(F.col("doc_id").alias(once))
    single = chosen.join(many, F.col("doc_id") == F.col(once), "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in documents.columns if c != "text"])
    of_many = chosen.join(many, F.col("doc_id") == F.col(once), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return single.unionByName(of_many).unionByName(documents.where("doc_id IS NULL"))
