"""Quality rules: exact document statistics, hard limits, and boosted trees over the statistics.

The statistics are computed over flat byte arrays of whole texts. The trees are fitted on a bounded
sample of labelled documents and may only lower a score as symbols, repeated lines or repeated words
grow; they travel to the tasks as flat node arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import boosting
from tidemark.llm.tables import seeded_sample
from tidemark.llm.words import _SPACE, Words, mix, per_row, runs, slices, span_hashes, windows, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share",
    "digit_share", "exclaim_per_word", "pipe_per_word", "distinct_word_share", "same_as_before_share", "stop_per_word", "words_per_line",
)
#: A quality score may only fall with these.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1}
#: Labelled documents fitted on, at most.
TRAIN_ROWS = 20_000
WINDOW = 5

_SYMBOL, _UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[list(b".,;:?")] = True


def _again(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: equal to an earlier one of its row; in a group of two or more."""
    n = len(keys)
    own = mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    earlier, shared = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return earlier, shared


def _equal_to_earlier(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which spans have the bytes of an earlier one of their row: equal hashes next to each other are compared."""
    keys = mix(span_hashes(data, starts, ends) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    earlier = np.zeros(len(keys), bool)
    for at in np.flatnonzero(keys[order][1:] == keys[order][:-1]):
        one, two = order[at], order[at + 1]
        earlier[two] = np.array_equal(data[starts[one] : ends[one]], data[starts[two] : ends[two]])
    return earlier


def statistics(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Exact counts (rows x COUNTS) and features (rows x FEATURES) of a slice."""
    data, offsets, rows = w.data, w.offsets, len(w.offsets) - 1
    point = (data & 0xC0) != 0x80
    space = _SPACE[data]
    total = lambda m: per_row(m, offsets)
    n, chars, symbols = w.counts, total(point & ~space), total(_SYMBOL[data])
    hashes = w.hashes(lower=False)
    # lines with a word that equal an earlier line of the text
    starts, ends = runs(data != 10, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    worded = np.concatenate([[0], np.cumsum(~space)])
    keep = worded[ends] > worded[starts]
    starts, ends, row = starts[keep], ends[keep], row[keep]
    earlier = _equal_to_earlier(data, starts, ends, row)
    dup_lines, lines = np.bincount(row[earlier], minlength=rows), np.bincount(row, minlength=rows)
    # words inside windows that occur twice or more
    repeats = np.zeros(rows, np.int64)
    long_first = w.first
    keys, first = windows(hashes, long_first, WINDOW)
    if len(keys):
        at_row = np.repeat(np.arange(rows), np.diff(first))
        _, shared = _again(keys, at_row)
        place = long_first[at_row] + np.arange(len(keys)) - first[at_row]
        cover = np.zeros(len(hashes) + WINDOW + 1, np.int64)
        np.add.at(cover, place[shared], 1)
        np.add.at(cover, place[shared] + WINDOW, -1)
        repeats = per_row((np.cumsum(cover)[: len(hashes)] > 0), long_first)
    same_word, _ = _again(hashes, w.row)
    distinct = per_row(~same_word, w.first)
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (w.row[1:] == w.row[:-1])
    counts = np.stack([n, chars, symbols, dup_lines, repeats], axis=1).astype(np.int64)
    words_, chars_, lines_ = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    features = np.stack([
        np.log1p(n), chars / words_, symbols / words_, dup_lines / lines_, repeats / words_, total(_UPPER[data]) / chars_,
        total(_DIGIT[data]) / chars_, total(data == 33) / words_, total(data == 124) / words_,
        # the share of distinct words falls with length; against the square root it hardly does
        distinct / np.sqrt(words_), per_row(follows, w.first) / words_, total(_STOP[data]) / words_, n / lines_,
    ], axis=1).astype(float)
    return counts, features


@dataclass
class Rules:
    """Limits below which or above which a document fails, and the trees' least score to keep one."""

    least_words: int = 10
    most_repeat_percent: int = 20
    least_score: float = 0.5


def _train_features(documents: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    marked = labels.where("quality IN (0, 1)")
    chosen = marked.join(F.broadcast(seeded_sample(marked, most, seed)), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    # ``most`` rows of an id and a label: small enough for every task, and the texts are not shuffled
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_y")

    def measure(batches):
        for part in slices(batches):
            _, features = statistics(words(part.column(1)))
            yield pa.record_batch([part.column(0), part.column(2).cast(pa.int32()), pa.array(list(features), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return rows.mapInArrow(measure, "doc_id long, y int, x array<double>")


def fit_rules(documents: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, seed: int = 7) -> boosting.Trees:
    """Trees for ``labels.quality`` from at most ``most`` labelled documents, chosen by a seeded hash."""
    rows = sorted((tuple(r) for r in _train_features(documents, labels, most, seed).limit(2 * most).collect()))
    x = np.array([r[2] for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r[1] for r in rows], float)
    return boosting.fit(x, y, monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def apply_rules(documents: DataFrame, trees: boosting.Trees, rules: Rules | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, the five counts, base_failed, score, kept. One row out for each row in.

    Defined cases: a null or blank text has zero counts, fails and is not kept; a null id stays null;
    repeated rows are judged alike; other columns are ignored; no rows give no rows.
    """
    rules = rules or Rules()

    def judge(batches):
        for part in slices(batches):
            counts, features = statistics(words(part.column(1)))
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < rules.least_words) | (100 * repeats > rules.most_repeat_percent * n)
            score = trees.probability(features)
            yield pa.record_batch(
                [part.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= rules.least_score))],
                [id, *COUNTS, "base_failed", "score", "kept"],
            )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text).mapInArrow(
        judge, f"{id} {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean",
    )
