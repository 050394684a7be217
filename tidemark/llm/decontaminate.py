"""Benchmark decontamination with SimHash over item-sized windows.

For each benchmark item, every window of a document that has the item's number of words and shares at
least one of its five-word shingles is fingerprinted (a window that shares none has similarity 0). A
fingerprint has ``BITS`` bits; bit sums over any window are differences of running sums. Fingerprints are
cut into ``BLOCKS`` blocks: two within ``RADIUS`` bits agree in some block up to RADIUS // BLOCKS bits,
so an index of the items' blocks with all flips of that many bits finds every item within the radius.
A similar window may lie outside the radius, so windows are also found by an exact bound: one of similarity
``SIMILAR`` holds at least SIMILAR / (1 + SIMILAR) of both sides' shingles in common, and so has as many
places at which a shingle of the item stands. No similar window is missed.
Found items are confirmed by the exact similarity of window and item: the sum of the smaller over the sum
of the larger shingle weights, a weight being how often the shingle occurs.

The benchmark is the query set. It is read in blocks of ``ITEM_BLOCK`` items, each small enough to go to
every task, and each block passes over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import mix, slices, windows, words

K = 5
BITS, BLOCKS = 64, 4
WIDTH = BITS // BLOCKS
#: Most windows with 0.8 similar shingles are within it, not all: a long item's cut at an edge are outside in 1 to 2 %.
RADIUS = 15
SIMILAR = 0.8
#: Items, and words of items, sent to every task at a time.
ITEM_BLOCK, ITEM_WORDS = 2_000, 400_000
_FLIPS = np.array([sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), n)], np.int64)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the +1 / -1 bits of word hashes: words + 1 x BITS."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
    out = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=out[1:], dtype=np.int32)
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1).view(np.uint64).ravel()


def blocks(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)


class Items:
    """One block of benchmark items with its shingle and fingerprint indexes."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        w = words(pa.array([r[1] for r in rows], pa.string()))
        hashes = w.hashes(lower=True)
        self.sizes = w.counts
        grams, first = windows(hashes, w.first, K)
        self.grams = [grams[first[i] : first[i + 1]] for i in range(len(rows))]
        row = np.repeat(np.arange(len(rows)), np.diff(first))
        order = np.argsort(grams, kind="stable")
        self.gram, self.gram_item = grams[order], row[order]
        self.prints = fingerprints(bit_sums(hashes), w.first[:-1], self.sizes)
        # for each block of bits: all keys within reach, and their items
        self.index = []
        for keys in blocks(self.prints).T:
            near = (keys[:, None] ^ _FLIPS).ravel()
            order = np.argsort(near, kind="stable")
            self.index.append((np.searchsorted(near[order], np.arange(2**WIDTH + 1)), (order // len(_FLIPS)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print number, item number) of all within RADIUS bits, each pair once."""
        found = []
        for keys, (first, item) in zip(blocks(prints).T, self.index):
            count = first[keys + 1] - first[keys]
            which = np.repeat(np.arange(len(prints)), count)
            at = np.repeat(first[keys], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            other = item[at]
            close = np.bitwise_count(prints[which] ^ self.prints[other]) <= RADIUS
            found.append(which[close] * len(self.ids) + other[close])
        both = np.unique(np.concatenate(found))
        return both // len(self.ids), both % len(self.ids)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle lists."""
    keys, counts_a = np.unique(a, return_counts=True)
    other, counts_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(keys, other, assume_unique=True, return_indices=True)
    common = int(np.minimum(counts_a[i], counts_b[j]).sum())
    return common / (len(a) + len(b) - common)


def crowded(places: np.ndarray, span: int, least: int, last: int) -> np.ndarray:
    """The starts, from 0 to ``last``, of all stretches of ``span`` places that hold ``least`` of the ascending ``places`` or more."""
    if len(places) < least:
        return np.zeros(0, np.int64)
    lo = np.maximum(places[least - 1 :] - span + 1, 0)
    count = np.maximum(np.minimum(places[: len(places) - least + 1], last) - lo + 1, 0)
    return np.unique(np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum()))


def search(items: Items, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item number, similarity, first word, words): the best window of each row and item that is similar."""
    w = words(column)
    hashes = w.hashes(lower=True)
    grams, first = windows(hashes, w.first, K)
    if not len(grams) or not len(items.gram):
        return
    lo = np.searchsorted(items.gram, grams, "left")
    hit = np.flatnonzero(items.gram[np.minimum(lo, len(items.gram) - 1)] == grams)
    if not len(hit):
        return
    row_of = np.searchsorted(first, hit, "right") - 1
    for row in np.unique(row_of):
        mine = hit[row_of == row] - first[row]
        own = slice(w.first[row], w.first[row + 1])
        sums, count = bit_sums(hashes[own]), int(w.counts[row])
        own_grams = grams[first[row] : first[row + 1]]
        left = np.searchsorted(items.gram, own_grams[mine], "left")
        right = np.searchsorted(items.gram, own_grams[mine], "right")
        shared = np.repeat(mine, right - left)
        item = items.gram_item[np.repeat(left, right - left) + np.arange(len(shared)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)]
        # the places of each item's shingles: item by item, ascending
        held, at_place = np.divmod(np.unique(item * len(own_grams) + shared), len(own_grams))
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(items.sizes[item]):
            # all windows of this size that hold a shared shingle whole; a shorter text is one window
            size = int(size)
            places = np.unique(shared[items.sizes[item] == size])
            reach = min(size, count)
            span = min(K, reach)
            starts = np.unique((places[:, None] - np.arange(reach - span + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + reach <= count)]
            which, found = items.near(fingerprints(sums, starts, reach))
            pairs = [starts[which] * len(items.ids) + found]
            inside = max(1, reach - K + 1)
            least = math.ceil(SIMILAR * (inside + max(1, size - K + 1)) / (1 + SIMILAR) - 1e-9)
            numbers, counts = np.unique(held[items.sizes[held] == size], return_counts=True)
            for other in numbers[counts >= least]:
                own_places = at_place[np.searchsorted(held, other, "left") : np.searchsorted(held, other, "right")]
                pairs.append(crowded(own_places, inside, least, count - reach) * len(items.ids) + other)
            for at, other in zip(*np.divmod(np.unique(np.concatenate(pairs)), len(items.ids))):
                if items.sizes[other] != size:
                    continue
                value = similarity(own_grams[at : at + inside], items.grams[other])
                if value >= SIMILAR and value > best.get(other, (0.0,))[0]:
                    best[other] = (value, int(at), reach)
        for other, (value, at, reach) in sorted(best.items()):
            yield int(row), int(other), value, at, reach


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with a word, by id, in blocks bounded in items and words; the driver holds one block."""
    block, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        n = len(text.split())
        if block and (len(block) == ITEM_BLOCK or size + n > ITEM_WORDS):
            yield block
            block, size = [], 0
        if text.encode().split():
            block.append((item, text))
            size += n
    if block:
        yield block


_FOUND = "item_id long, similarity double, first_word long, n_words long"


def leaks(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the most similar window, for each document row
    and benchmark item with a similarity of 0.8 or more; of equals the first.

    Words are split at space and 0x09-0x0D and compared with A-Z lower-cased. An item of fewer than five
    words is one shingle, as is a text. Null and blank texts and items match nothing; items without an id
    are left out; an item's several texts are items of one id, and the best is told. Repeated documents
    give repeated rows; other columns are ignored.
    """
    kind = documents.schema[id].dataType.simpleString()

    def passing(block):
        def run(batches):
            items = Items(block)
            for part in slices(batches, text):
                best: dict[tuple[int, int], tuple] = {}
                for row, other, *rest in search(items, part.column(1)):
                    key = (row, int(items.ids[other]))
                    if key not in best or rest[0] > best[key][0]:
                        best[key] = tuple(rest)
                if best:
                    rows = [k[0] for k in best]
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(rows)), pa.array([k[1] for k in best], pa.int64()),
                         *(pa.array(c) for c in zip(*best.values()))], [id, "item_id", "similarity", "first_word", "n_words"],
                    )
        return documents.select(id, text).mapInArrow(run, f"{id} {kind}, {_FOUND}")

    passes = [passing(b) for b in item_blocks(benchmark)]
    if not passes:
        return documents.select(id, *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _FOUND.split(", "))]).limit(0)
    return reduce(DataFrame.unionByName, passes)


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns, in one pass for each block of items."""
    schema = documents.schema

    def passing(left, block):
        def run(batches):
            items = Items(block)
            for part in slices(batches, "text"):
                clean = np.ones(part.num_rows, bool)
                for row, *_ in search(items, part.column("text")):
                    clean[row] = False
                yield part.filter(pa.array(clean))
        return left.mapInArrow(run, schema)

    return reduce(passing, item_blocks(benchmark), documents)
