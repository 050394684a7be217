"""Near-duplicates, components and benchmark decontamination."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from rough_rows import ROUGH, SF

from tidemark.llm import decontaminate, near_dedup, queries
from tidemark.llm.components import connected_components
from tidemark.llm.words import distinct_windows, windows, words


def test_words_and_windows():
    texts = ["a  b\tc", "", None, " x ", "é\x0b☃\x1fz\x85 q", "a b a b a b", "one"]
    w = words(pa.array(texts, pa.string()))
    bytes_of = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert [bytes_of[i:j] for i, j in zip(w.first, w.first[1:])] == [brute.words(t) for t in texts]
    for k in (1, 2, 3):
        hashes, starts = distinct_windows(*windows(w.hashes(), w.first, k))
        assert np.diff(starts).tolist() == [len(brute.shingles(t, k)) for t in texts]
    assert len(set(w.hashes(lower=False).tolist())) == len(set(bytes_of))


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that polynomial hashes modulo a power of two cannot tell apart."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return bits, bits.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_thue_morse_words_apart(spark):
    for n in (8, 64, 1024, 4096):
        one, two = thue_morse(n)
        w = words(pa.array([f"{one} {two} {one.upper()} {two}\n{one}"]))
        plain, folded = w.hashes(lower=False), w.hashes(lower=True)
        assert len(set(plain.tolist())) == 3 and plain[1] == plain[3] and plain[0] == plain[4]
        assert folded[0] == folded[2] != folded[1]
    # swapped and repeated blocks of eight bytes, and spans that differ in length only by zero bytes
    w = words(pa.array(["abcdefghABCDEFGH ABCDEFGHabcdefgh abcdefghabcdefgh abcdefgh a a\0 a\0\0"]))
    assert len(set(w.hashes(lower=False).tolist())) == 7
    one, two = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, k=1, percent=100).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, f"{one} a b c d e f g")], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"{two} a b c d e f g"), (2, f"{one} a b c d e f g")], "doc_id long, text string")
    found = {r["doc_id"]: r["similarity"] for r in decontaminate.leaks(texts, items).collect()}
    assert found.get(2) == 1.0 and found.get(1, 0) < 1.0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        sets = [np.concatenate([both, a]), np.concatenate([both, b])]
        s = near_dedup.signatures(np.concatenate(sets), np.array([0, 180, 360]))
        gaps.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(gaps)) < 0.03


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3), (7, 9), (9, 7)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def family(rng, n, size, changes, start):
    """``n`` variants of one text, each with a few words of its own."""
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(changes):
            ws[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        out.append((start + i, " ".join(ws)))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_links_match_all_pairs(spark, k):
    rng = random.Random(k)
    rows = []
    for size, changes in ((40, 1), (60, 1), (80, 2), (120, 3), (200, 4), (90, 3), (30, 1)):
        rows += family(rng, 14, size, changes, len(rows))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:20])]
    rows += [(1000 + i, t) for i, t in enumerate(["", " ", "one", "ONE", "one two", "one two three four", "x one two three"])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute.near_duplicates(rows, k)


def test_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op9_near_dedup"](spark, SF).collect()}
    assert got == brute.near_duplicates(rows)


def test_dedup_on_rough_rows(spark, rough, nothing):
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(rough).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == len(ROUGH)
    assert by[2] == (2, 8, 1, False) and by[1] == (1, 8, 1, True)
    assert by[3] == (3, 0, 3, True) and by[5] == (5, 0, 5, True)
    assert by[7] == (7, 1, 6, False) and by[6] == (6, 1, 6, True)
    assert by[9][2:] == (8, False)
    assert (None, 8, 1, False) in got and (None, 0, None, True) in got
    kept = near_dedup.dedup(rough)
    assert kept.columns == rough.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "10", "None", "None"])
    assert near_dedup.near_duplicates(nothing).count() == 0 and near_dedup.dedup(nothing).count() == 0


def test_one_id_with_two_texts_is_one_vertex(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again until the very end of day"), (2, "short one"), (3, None), (None, "no id here at all"),
         (4, " "), (1, "another text of the first item with eight words"), (5, "rep rep rep rep rep rep rep rep rep rep rep rep rep"), (6, "Ünï ☃ code words are words all the same 😀")]


def test_leaks_match_all_windows(spark, rough):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in ROUGH if r[1] is None or len(r[1]) < 1000]
    n = 100
    for _, item in ITEMS:
        ws = (item or "").split()
        for change in range(5):
            for _ in range(4):
                other = list(ws)
                for _ in range(change if ws else 0):
                    other[rng.randrange(len(other))] = rng.choice(["x", "Y", "the"])
                lead = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(20))]
                rows.append((n, " ".join(lead + [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in other] + lead[:3])))
                n += 1
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "'y' AS similarity")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.leaks(documents, benchmark).collect()
    want = brute.leaks([(str(i), t) for i, t in rows], [(i, t) for i, t in ITEMS if i is not None])
    assert {(str(r["doc_id"]), r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    texts = {str(i): brute.words((t or "").translate(brute.UPPER)) for i, t in rows}
    for r in got:
        assert r["first_word"] + r["n_words"] <= len(texts[str(r["doc_id"])])
    clean = decontaminate.drop_leaks(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in rows if str(i) not in {k[0] for k in want})


def test_leaks_in_blocks_and_without_rows(spark, rough, nothing, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.leaks(documents, benchmark).collect()))
    want = brute.leaks([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    assert {w[:2]: w[2] for w in whole} == want
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 7)
    assert sorted(map(tuple, decontaminate.leaks(documents, benchmark).collect())) == whole
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(rough, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(rough, benchmark.limit(0)).count() == len(ROUGH)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    items = decontaminate.Items([(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(20))) for i in range(60)])
    probes = []
    for p in items.prints:
        for n in range(0, 22, 3):
            flips = rng.choice(64, n, replace=False)
            probes.append(p ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if n else p)
    probes = np.array(probes, np.uint64)
    got = set(zip(*(a.tolist() for a in items.near(probes))))
    close = np.bitwise_count(probes[:, None] ^ items.prints[None]) <= decontaminate.RADIUS
    assert got == set(zip(*(a.tolist() for a in np.nonzero(close))))


@pytest.mark.parametrize("size", [20, 35, 55, 75, 100])
def test_items_cut_at_an_edge_are_found(size):
    rng = random.Random(size)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(size))) for i in range(300)]
    texts = []
    for _, text in items:
        ws, cut = text.split(), (size - decontaminate.K + 1) // 9
        other = [f"x{rng.randrange(10**6)}" for _ in range(cut)]
        texts.append(" ".join(ws[cut:] + other if rng.random() < 0.5 else other + ws[: size - cut]))
    got = {(r, int(o)): v for r, o, v, *_ in decontaminate.search(decontaminate.Items(items), pa.array(texts))}
    assert got == brute.leaks(list(enumerate(texts)), items) and len(got) == len(items)


def test_crowded_stretches():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, span, least = (int(v) for v in rng.integers(1, 30, 3))
        last = max(0, n - span)
        places = np.flatnonzero(rng.random(n) < 0.6)
        want = [s for s in range(last + 1) if ((places >= s) & (places < s + span)).sum() >= least]
        assert decontaminate.crowded(places, span, least, last).tolist() == want
