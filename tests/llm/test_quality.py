"""Quality rules, boosted trees and the quality classifier."""

import brute
import numpy as np
import pyarrow as pa
from rough_rows import ROUGH, SF

from tidemark.llm import boosting, cnn_quality, queries, quality_rules
from tidemark.llm.words import Words, words  # noqa: F401


def test_statistics_match_plain_counts():
    texts = [r[1] for r in ROUGH if r[1] is None or len(r[1]) < 1000] + ["a b c d e a b c d e x", "l\nl\n l\n\n\nl", "#|<>$%&* a", "a a a a a a a", "\x0b\x0c\x1c\x85 x"]
    counts, features = quality_rules.statistics(words(pa.array(texts, pa.string())))
    assert [tuple(c) for c in counts] == [brute.rule_counts(t)[:5] for t in texts]
    assert np.isfinite(features).all()


def test_lines_that_differ_are_no_duplicates():
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = bits.translate(str.maketrans("ab", "ba"))
    counts, _ = quality_rules.statistics(words(pa.array([f"{bits}\n{other}", f"{bits}\n{other}\n{bits}", f"{other}\n{other}"])))
    assert counts[:, 3].tolist() == [0, 1, 1]


def test_rules_query(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_quality_rules"](spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(source)
    for r in source:
        got = rows[r["doc_id"]]
        assert tuple(got[c] for c in (*quality_rules.COUNTS, "base_failed")) == brute.rule_counts(r["text"])
        assert not (got["base_failed"] and got["kept"])


def test_rules_on_rough_rows(spark, rough, nothing, documents, labels):
    trees = quality_rules.fit_rules(documents, labels)
    got = quality_rules.apply_rules(rough, trees).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in quality_rules.COUNTS), r["base_failed"]) for r in got) == sorted(
        (str(r[0]), *brute.rule_counts(r[1])) for r in ROUGH)
    assert quality_rules.apply_rules(nothing, trees).count() == 0
    untaught = quality_rules.fit_rules(nothing, labels.limit(0))
    assert {round(r["score"], 3) for r in quality_rules.apply_rules(rough, untaught).collect()} == {0.5}


def test_trees_learn_and_keep_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(3 * x[:, 1])) > 0).astype(float)
    y = np.where(rng.random(3000) < 0.1, 1 - y, y)
    trees = boosting.fit(x, y, monotone={0: 1})
    assert ((trees.probability(x) > 0.5) == (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) > 0)).mean() > 0.93
    for row in x[:50]:
        line = np.repeat(row[None], 60, 0)
        line[:, 0] = np.linspace(-3, 3, 60)
        assert (np.diff(trees.margin(line)) >= -1e-9).all()


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    trees = boosting.fit(x, (x[:, 1] * x[:, 2] > 0).astype(float), trees=7, depth=3)
    for row, got in zip(x, trees.margin(x)):
        want = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            want += v[at - len(f)]
        assert abs(want - got) < 1e-9


def test_network_scores_whole_texts_in_any_slicing():
    net = cnn_quality.Network.new(np.random.default_rng(2))
    texts = [b"", b"x", b"ab" * 70, bytes(range(256)) * 9, b"word " * 4000]
    pairs = net.pairs()
    flat = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]).astype(np.int64))
    together = cnn_quality.scores(net, pairs, *flat(texts))
    for t, s in zip(texts, together):
        assert abs(cnn_quality.scores(net, pairs, *flat([t]))[0] - s) < 1e-6
        # the plain form: responses at each position, maxima over chunks that overlap by half
        halves = max(1, -(-len(t) // cnn_quality.HALF))
        laid = t + bytes(halves * cnn_quality.HALF - len(t) + cnn_quality.WIDTH)
        z = np.array([sum(net.tables[j, laid[p + j]] for j in range(cnn_quality.WIDTH)) for p in range(0, halves * cnn_quality.HALF)]) + net.bias
        half = np.maximum(z.reshape(halves, cnn_quality.HALF, -1).max(1), 0)
        pool = np.array([np.maximum(half[i], half[min(i + 1, halves - 1)]) for i in range(max(1, halves - 1))])
        v = np.concatenate([pool.mean(0), pool.max(0), pool.min(0), [np.log1p(len(t)) / 8]])
        assert abs(cnn_quality.head(net, v[None])[0][0] - s) < 1e-5
    changed = cnn_quality.scores(net, pairs, *flat([texts[4][:-5] + b"\xff\xfe\xfd\xfc\xfb"]))[0]
    assert changed != together[4]


def test_network_gradient():
    """The step that training takes lowers the loss of what it saw."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"abc "), 300)) + (b"***" if i % 2 else b"") for i in range(60)]
    y = np.array([1 - i % 2 for i in range(60)], float)
    net = cnn_quality.fit(texts, y, steps=120, batch=30)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    assert ((cnn_quality.scores(net, net.pairs(), data, offsets) > 0.5) == (y == 1)).mean() > 0.95


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_quality_classifier"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    apart = got[got.held_out]
    assert ((apart.predicted == apart.quality).mean() > 0.9) and got.score.between(0, 1).all()
    import zlib

    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))


def test_classifier_on_rough_rows(rough, nothing, labels):
    net = cnn_quality.Network.new(np.random.default_rng(4))
    got = cnn_quality.classify(rough, net).collect()
    assert len(got) == len(ROUGH) and all(0 <= r["score"] <= 1 for r in got)
    empty = {round(r["score"], 9) for r in got if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    assert cnn_quality.classify(nothing, net).count() == 0
    kept = cnn_quality.keep_good(rough, net, least=0.0)
    assert kept.columns == rough.columns and kept.count() == len(ROUGH)
    assert cnn_quality.keep_good(rough, net, least=1.1).count() == 0
    assert isinstance(cnn_quality.train(nothing, labels.limit(0)), cnn_quality.Network)
