"""Spelling variants: words one edit apart, over a bit-sliced position index.

The vocabulary is dealt into cells whose words share half of their letters: two words of s and s or s + 1 letters
that differ by one edit share their first s // 2 letters or their last s - s // 2. A cell is an index: for every
position and letter a bitset of the words that have that letter there. A word then runs over its own letters
once, with two recurrences on whole bitsets: the words without an error so far, and those with one error, kept
apart by whether the positions are level (a letter replaced) or shifted by one (a letter more). Cells are cut into
units of bounded size, of a crowded cell every index slice meets every query slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.url_filters import LOWER, UPPER
from tidemark.plans.staging import stage

RUN = "[A-Za-z\\u00C0-\\u00FF]"
#: Letters of an index slice at most, and words; positions indexed at once.
UNIT_LETTERS, UNIT_WORDS, SPAN = 1 << 17, 1024, 2048
_LETTERS = 90
_PAD = 90
#: Class of each letter: a to z, then U+00C0 to U+00FF.
_CLASS = np.full(256, _PAD, np.uint8)
_CLASS[97:123] = np.arange(26)
_CLASS[192:256] = np.arange(26, 90)


def misspelt(run: Column, doc_id: Column) -> Column:
    """The run without the code point h % length where 31 divides h, the crc32 of ``<doc_id>:<run>``; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n): the distinct words of the whole texts of at least ``least`` letters, seen at least ``occurrences`` times.

    Words are the maximal runs of Latin letters with A-Z lower-cased, each as ``misspelt`` leaves it. A null text
    has none, an empty text neither.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    # shorter runs give no word: a run only loses a letter
    runs = F.explode(F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{least},}}"), F.lit(0)))
    words = docs.select(F.col(doc_id).alias("_id"), runs.alias("_run")).select(misspelt(F.col("_run"), F.col("_id")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


_CELL = ["s", "side", "key"]
_UNIT = [*_CELL, "slice", "query_slice"]


def _units(words: DataFrame, least: int, unit_letters: int, unit_words: int) -> DataFrame:
    """The words of every unit: (unit, word, n, indexed, asks), cells with nothing to find left out.

    A cell of s holds words of s and s + 1 letters; those of s letters ask.
    """
    m = F.length("word")
    half = F.floor(F.col("s") / 2).cast("int")
    told = words.withColumn("s", F.explode(F.filter(F.array(m, m - 1), lambda s: s >= least)))
    told = told.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("asks", F.length("word") == F.col("s"))
    told = told.withColumn("key", F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(
        F.substring(F.col("word"), F.length("word") - (F.col("s") - half) + 1, F.col("s") - half)))
    most = F.greatest(F.lit(2), F.least(F.lit(unit_words), F.floor(F.lit(unit_letters) / (F.col("s") + 1))))
    cells = told.groupBy(*_CELL).agg(F.count("*").alias("_n"), F.sum(F.col("asks").cast("int")).alias("_asking")).where("_n > 1 and _asking > 0")
    cells = cells.select(*_CELL, F.ceil(F.col("_n") / most).cast("int").alias("slices"))
    there = told.join(cells, _CELL)
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    one = F.struct(F.lit(0).alias("slice"), F.lit(0).alias("query_slice"), F.lit(True).alias("indexed"), F.col("asks").alias("asks"))
    indexed = F.transform(every, lambda q: F.struct(own.alias("slice"), q.alias("query_slice"), F.lit(True).alias("indexed"), F.lit(False).alias("asks")))
    asking = F.transform(F.filter(every, lambda q: F.col("asks")), lambda q: F.struct(q.alias("slice"), own.alias("query_slice"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    at = F.explode(F.when(F.col("slices") == 1, F.array(one)).otherwise(F.concat(indexed, asking)))
    return there.withColumn("_at", at).select(*_CELL, "_at.slice", "_at.query_slice", "word", "n", "_at.indexed", "_at.asks")


def position_index(codes: np.ndarray, start: int, span: int) -> np.ndarray:
    """Bitsets (uint64 words) of the rows of ``codes`` by position from ``start`` and by letter; one class more, for none."""
    rows = -(-len(codes) // 64) * 64
    here = codes[:, start : start + span]
    marks = np.zeros((span, _LETTERS + 1, rows), bool)
    row, place = np.nonzero(here != _PAD)
    marks[place, here[row, place], row] = True
    return np.packbits(marks, axis=2, bitorder="little").view(np.uint64)


def one_edit(queries: np.ndarray, index: np.ndarray, lengths: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, indexed word) pairs exactly one edit apart; queries have s letters, indexed words s or s + 1.

    ``clean`` holds the words equal so far, ``level`` those with one letter replaced, ``ahead`` those with one letter
    more, whose positions are one further on.
    """
    width = -(-len(index) // 64)
    clean = np.full((len(queries), width), ~np.uint64(0))
    level, ahead = np.zeros_like(clean), np.zeros_like(clean)
    span = max(1, min(SPAN, (1 << 24) // ((_LETTERS + 1) * width * 64)))
    for start in range(0, s, span):
        bits = position_index(index, start, min(span, s - start) + 1)
        for i in range(start, min(start + span, s)):
            letter = queries[:, i]
            here, after = bits[i - start, letter], bits[i - start + 1, letter]
            level = (level & here) | (clean & ~here)
            ahead = (ahead | clean) & after
            clean &= here
    same = np.zeros(width * 64, bool)
    same[: len(index)] = lengths == s
    longer = np.zeros(width * 64, bool)
    longer[: len(index)] = lengths == s + 1
    of = lambda mask: np.packbits(mask, bitorder="little").view(np.uint64)
    hits = (level & of(same)) | ((ahead | clean) & of(longer))
    some = np.flatnonzero(hits.any(1))
    query, word = np.nonzero(np.unpackbits(hits[some].view(np.uint8), axis=1, bitorder="little"))
    return some[query], word


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of the units: how many near words it has there and the most frequent of them."""
    held: list[pa.RecordBatch] = []
    n_held = 0
    for batch in batches:
        held.append(batch)
        n_held += batch.num_rows
        if n_held >= 1 << 14:
            table = pa.Table.from_batches(held).combine_chunks()
            ready = _last_border(table)
            if ready:
                yield from _near_in(table.slice(0, ready))
                table = table.slice(ready)
            held, n_held = table.to_batches(), table.num_rows
    if held:
        yield from _near_in(pa.Table.from_batches(held).combine_chunks())


def _borders(table: pa.Table) -> np.ndarray:
    """Where a unit begins, and the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for name in _UNIT:
        c = table[name].combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def _last_border(table: pa.Table) -> int:
    return int(_borders(table)[-2])


def _near_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Units of one s are worked on together, as many as make a full index."""
    borders = _borders(table)
    s_of = table["s"].to_numpy()
    at = 0
    while at < len(borders) - 1:
        to, a, s = at + 1, borders[at], int(s_of[borders[at]])
        most = max(2, min(UNIT_WORDS // 2, UNIT_LETTERS // (s + 1)))
        while to < len(borders) - 1 and s_of[borders[to]] == s and borders[to + 1] - a <= most:
            to += 1
        yield from _near_among(table.slice(a, borders[to] - a), borders[at : to + 1] - a, s)
        at = to


def _near_among(table: pa.Table, borders: np.ndarray, s: int) -> Iterator[pa.RecordBatch]:
    words = table["word"].to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _CLASS[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    codes = np.full((len(words), s + 2), _PAD, np.uint8)
    codes[np.arange(s + 2) < lengths[:, None]] = letters
    indexed = np.flatnonzero(table["indexed"].to_numpy())
    asks = np.flatnonzero(table["asks"].to_numpy())
    if not len(indexed) or not len(asks):
        return
    unit = np.searchsorted(borders, np.arange(len(words)), "right")
    query, word = one_edit(codes[asks], codes[indexed], lengths[indexed], s)
    query, word = asks[query], indexed[word]
    side = table["side"].to_numpy()
    keep = unit[query] == unit[word]
    query, word = query[keep], word[keep]
    # a pair that shares the first half is told by its cell of first halves alone
    half = s // 2
    twice = np.zeros(len(query), bool)
    last = np.flatnonzero(side[query] == 1)
    for a in range(0, len(last), 1 << 14):
        some = last[a : a + (1 << 14)]
        twice[some] = (codes[query[some], :half] == codes[word[some], :half]).all(1)
    query, word = query[~twice], word[~twice]
    # of words of s letters both ask; a longer word hears of the pair from the shorter one
    back = lengths[word] == s + 1
    of, near = np.concatenate([query, word[back]]), np.concatenate([word, query[back]])
    if not len(of):
        return
    n = table["n"].to_numpy()
    # rows stand in the order of their words within a unit
    order = np.lexsort((near, -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    count = np.diff(np.append(first, len(of)))
    column = table["word"].combine_chunks()
    yield pa.RecordBatch.from_arrays(
        [column.take(pa.array(of[first])), pa.array(count.astype(np.int64)), column.take(pa.array(near[first])), pa.array(n[near[first]])],
        names=["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame, least: int = 7, unit_letters: int = UNIT_LETTERS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """(word, n_near, best, best_n): for each word with a near word, their number and the most frequent one.

    ``words`` has distinct ``word`` of ``least`` Latin letters or more and ``n``. Near words differ by exactly one
    inserted, deleted or replaced letter; of equally frequent ones the smallest in code-point order is the best.
    """
    units = _units(words, least, unit_letters, unit_words).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "word")
    found = units.mapInArrow(_near, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("_m"), F.col("best").alias("best"))).alias("_b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("_b.best").alias("best"), (-F.col("_b._m")).alias("best_n"))


def spelling_variants(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 7, occurrences: int = 2, ratio: int = 10,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the ``vocabulary`` of ``docs``.

    A word's form is its best near word if that is at least ``ratio`` times as frequent, else null; its root is the
    last word along its forms, itself without one. Other columns of ``docs`` are not looked at, repeated rows count
    as often as they stand, no words give no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms may go in circles")
    words = stage(vocabulary(docs, text, doc_id, least, occurrences))
    near = near_words(words, least)
    has_form = F.col("best_n") >= ratio * F.col("n")
    told = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n")))
    # each hop multiplies n, so few rounds of doubling reach the end of every chain
    roots = told.where("form is not null").select("word", F.col("form").alias("root"))
    hops, most = 0, told.agg(F.max("n")).first()[0] or 1
    while ratio ** (2**hops) <= most:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = stage(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")))
        hops += 1
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
