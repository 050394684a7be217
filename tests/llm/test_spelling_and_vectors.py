"""Spelling variants, exact top-k search and hard negatives against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cover_tree, spelling, vectors, voronoi_topk
from tidemark.llm.queries import QUERIES


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    """(word, n, n_near, form, form_n, root) of (doc_id, text) rows."""
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= 7
    n = {w: c for w, c in seen.items() if c >= 2}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(around[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def variants(frame):
    return {tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_one_edit_over_all_pairs():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abÿ") for _ in range(n)) for n in (7, 8) for _ in range(300)})
    lengths = np.array([len(w) for w in words])
    codes = np.full((len(words), 9), spelling._PAD, np.uint8)
    for row, w in zip(codes, words):
        row[: len(w)] = spelling._CLASS[np.frombuffer(w.encode("latin-1"), np.uint8)]
    asks = np.flatnonzero(lengths == 7)
    query, word = spelling.one_edit(codes[asks], codes, lengths, 7)
    want = {(i, j) for i in asks for j in range(len(words)) if near(words[i], words[j])}
    assert set(zip(asks[query].tolist(), word.tolist())) == want


@pytest.fixture(scope="module")
def texts():
    """Few letters, so that many words are near each other; chains of forms; very long words one edit apart."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abÀ") for _ in range(rnd.randint(6, 10)))
    pool = [word() for _ in range(150)]
    rows = [(i, " ".join(rnd.choice(pool[: 1 + int(150 * rnd.random() ** 3)]) for _ in range(60)) + ". ABABABA-abababa") for i in range(60)]
    long = "".join(rnd.choice("abc") for _ in range(9000))
    rows += [(100, f"{long} {long}"), (101, f"{long[:5000]}{long[5001:]} " * 2), (102, f"{long}c {long}c")]
    rows += [(200, "chainsa " * 1200 + "chainsab " * 110 + "chainsabc " * 10), (None, "chainsa"), (3, None), (4, ""), (5, "short 12 ×÷ ☃")]
    return rows


@pytest.mark.parametrize("size", [(1 << 17, 1024), (40, 4)])
def test_variants_as_plain(spark, texts, monkeypatch, size):
    monkeypatch.setattr(spelling, "UNIT_LETTERS", size[0])
    monkeypatch.setattr(spelling.near_words, "__defaults__", (7, *size))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, word string, n int").repartition(5)
    assert variants(spelling.spelling_variants(frame)) == plain_variants(texts)


def test_variants_of_rough_rows(rough, nothing):
    from rough_rows import ROUGH

    assert variants(spelling.spelling_variants(rough)) == plain_variants([(r[0], r[1]) for r in ROUGH])
    assert spelling.spelling_variants(nothing).count() == 0


# --- vectors ------------------------------------------------------------------------------------

def some_vectors(seed=1, n=400):
    """Clusters, copies, equal ids, nulls, broken components, other dimensions, zero vectors, extra columns."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, 6))
    rows = []
    for i in range(n):
        v = centres[rnd.integers(8)] + rnd.normal(size=6) * rnd.choice([0.0, 0.05, 0.5])
        rows.append([i, [float(np.float32(x)) for x in v], int(rnd.integers(3))])
    for i in range(0, 120, 3):
        rows[i][1] = rows[0][1]  # a third of the rows alike
    rows += [[20, rows[5][1], 1], [20, rows[5][1], 1], [None, rows[7][1], 2], [None, rows[7][1], 0]]
    rows += [[400, None, 1], [500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1], [600, [float("nan")] * 6, 1], [700, [float("inf")] * 6, 0]]
    rows += [[800, [0.0] * 6, 1], [801, [0.0] * 6, 2], [900, [2.0, 1.0], 1], [901, [1.0, 1.0], 2], [902, [1.5, 1.0], 1], [1000, [], 1], [1001, [], 0], [1100, rows[3][1], None]]
    return [tuple(r) for r in rows]


def whole(rows, scale):
    ok = [(k, i, np.floor(scale * np.array(v, float)), label) for k, (i, v, label) in enumerate(rows)
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(k, i, v.astype(np.int64).tolist(), label) for k, i, v, label in ok]


def first(scored, k):
    """(score, id, ...) tuples: the first k by score, then id, null last."""
    return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, k):
    """(query_id, rank, score, id) as a multiset: rows of equal id stay apart."""
    out = Counter()
    for j, i, v, _ in whole(rows, 64):
        if i is not None and i % 20 == 0:
            best = first([(dot(v, w), c) for m, c, w, _ in whole(rows, 64) if m != j and len(w) == len(v)], k)
            out.update((i, r + 1, s, c) for r, (s, c) in enumerate(best))
    return out


SCHEMA = "id long, embedding array<float>, label int, score string, cell int, unit int, probe int, row string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, "x") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("pivots,blocks", [(16, (1 << 15, 1 << 17)), (6, (3, 50)), (20, (4096, 40))])
def test_top_k_as_plain(spark, pivots, blocks):
    rows = some_vectors()
    frame = vectors.whole_numbers(frame_of(spark, rows), "embedding", 64, ["id"])
    got = voronoi_topk.top_k(frame, vectors.divisible("id", 20), 7, pivots, query_block=blocks[0], data_block=blocks[1])
    assert Counter((r.query_id, r.rank, r.score, r.id) for r in got.collect()) == plain_top(rows, 7)


def test_top_k_of_nothing(spark):
    frame = vectors.whole_numbers(frame_of(spark, some_vectors()).limit(0), "embedding", 64, ["id"])
    assert voronoi_topk.top_k(frame, vectors.divisible("id", 20), 5).count() == 0
    frame = vectors.whole_numbers(frame_of(spark, some_vectors()[:5]), "embedding", 64, ["id"])
    assert voronoi_topk.top_k(frame, F.col("id") < 0, 5).count() == 0
    assert voronoi_topk.top_k(frame, F.col("id") == 1, 20).count() == 4


def test_voronoi_cells_rule_rows_out(spark):
    """Of well-parted clusters of vectors of one length a group needs few rows beyond its own cell."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(10, 16))
    centres *= 12 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 10] + rnd.normal(size=16) * 0.01).tolist(), 0) for i in range(1000)]
    frame = vectors.whole_numbers(frame_of(spark, rows), "embedding", 64, ["id"])
    space = vectors.Space(frame, 10, 500, 1)
    located = voronoi_topk._locate(frame, F.col("id") % 3 == 0, space)
    dealt = voronoi_topk._deal(located, voronoi_topk._plan(space, located, 5, 4096, 1 << 17)).where("is_data = 1")
    assert dealt.count() < 3 * len(rows)


def plain_negatives(rows):
    out = Counter()
    known = [(j, i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for j, i, v, label in whole(rows, 256) if label is not None]
    for j, i, v, label in known:
        if i is None or i % 100:
            continue
        others = [(dot(v, w), c, m, lab) for m, c, w, lab in known if m != j and len(w) == len(v)]
        for ps, p, *_ in first([o for o in others if o[3] == label], 5):
            found = first([o for o in others if o[3] != label and 80 * ps <= 100 * o[0] <= 100 * ps], 5)
            out.update((i, p, r + 1, o[1], ps, o[0]) for r, o in enumerate(found))
    return out


@pytest.mark.parametrize("routers,block", [(64, 4096), (3, 25)])
def test_hard_negatives_as_plain(spark, routers, block, monkeypatch):
    rows = [(i, v, label) for i, v, label in some_vectors(4, 900)]
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    frame = frame_of(spark, rows).where("label is not null").withColumn("label", label)
    frame = vectors.whole_numbers(frame, "embedding", 256, ["id", "label"])
    if block < 100:
        monkeypatch.setattr(cover_tree.search, "__defaults__", ("all", 4))
    got = cover_tree.hard_negatives(frame, vectors.divisible("id", 100), routers=routers, block=block)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == plain_negatives(rows)
    none = vectors.whole_numbers(frame_of(spark, rows).limit(0), "embedding", 256, ["id", "label"])
    assert cover_tree.hard_negatives(none, vectors.divisible("id", 100)).count() == 0


def test_cover_tree_covers():
    rnd = np.random.default_rng(8)
    points = np.concatenate([rnd.normal(size=(200, 5)), np.repeat(rnd.normal(size=(3, 5)), 40, 0)])
    order, begin, count, radius = cover_tree.cover_tree(points)
    assert sorted(order) == list(range(len(points)))

    def below(node):
        for child in range(begin[node], begin[node] + count[node]):
            yield child
            yield from below(child)

    assert sorted(below(0)) == list(range(1, len(points)))
    for node in range(len(points)):
        inside = list(below(node))
        if inside:
            assert np.linalg.norm(points[order[inside]] - points[order[node]], axis=1).max() <= radius[node] + 1e-6


def test_large_components_are_exact():
    a = np.array([[2**40, -(2**20), 3]])
    assert vectors.inner_products(a, np.array([[2**20, 5, 7]])).tolist() == [[2**60 - 5 * 2**20 + 21]]
    with pytest.raises(ValueError):
        vectors.inner_products(a, np.array([[2**40, 0, 0]]))
    assert vectors.decode([vectors.encode(a[0])], 3).tolist() == a.tolist()


def test_registered():
    assert {"op11_spelling_variants", "op12_exact_topk", "op13_hard_negatives"} <= set(QUERIES)
