"""Benchmark decontamination by a prefix-filtered containment join.

Benchmark items are cut into windows of `window` words (an item of fewer words is one window).  Words
are ordered by rarity in the corpus, and a window's prefix is its rarest word: a document that holds
the window must hold that word.  Documents meet windows on the prefix word alone; the word's place in
the window fixes where the window would start, which gives the length and positional bounds (the
window must lie inside the document), and the candidates are verified word by word.

The benchmark is a stated query set: it is read in blocks of at most `block_windows` windows, each of
which is broadcast (a proven bound), and every block is held against all documents.  Corpus counts
are taken for the benchmark's own words only, a block of at most `block_words` at a time.

Defined results: null text, or no words: n_words 0, no hits, not contaminated.  Null items have no
windows; a null item_id is written as an empty string.  Repeated items count once.  An empty benchmark
hits nothing.  Extra columns of documents pass through; one called as `out` is kept as `out`_input.
Words are compared as 64-bit hashes, window by window.  An empty table of documents gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .columns import cleared, fresh

WINDOW = 13
BLOCK_WINDOWS = 1 << 18
BLOCK_WORDS = 1 << 20
MIN_PERMILLE = 50

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("whole", T.BooleanType())])


@dataclass
class Block:
    """Windows sorted by prefix word: their words (padded), lengths, the prefix word's place, and their item."""

    prefix: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    place: np.ndarray
    item: np.ndarray
    names: list[str]


def item_windows(items: list[tuple[str, str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Distinct (item, window): word hashes padded with 0, lengths and item numbers."""
    names = sorted({n for n, _ in items})
    number = {n: k for k, n in enumerate(names)}
    rows: set[tuple] = set()
    column = pa.array([t for _, t in items], pa.string())
    for lo, hi, data, off in X.slices(column):
        w = X.words(data, off, X.NON_ALNUM)
        for k in range(lo, hi):
            h = tuple(w.hashes[w.first[k - lo] : w.first[k - lo + 1]].tolist())
            for i in range(max(1, len(h) - window + 1) if h else 0):
                rows.add((number[items[k][0]], h[i : i + window]))
    rows_ = sorted(rows)
    words = np.zeros((len(rows_), window), np.uint64)
    for k, (_, h) in enumerate(rows_):
        words[k, : len(h)] = h
    return words, np.array([len(h) for _, h in rows_], np.int64), np.array([n for n, _ in rows_], np.int64), names


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """How often each word of a bounded, sorted vocabulary occurs in all documents."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        probe, total = Probe(table), np.zeros(len(table), np.int64)
        for batch in batches:
            for _, _, data, off in X.slices(batch.column(0)):
                h = X.words(data, off, X.NON_ALNUM).hashes
                _, at = probe(h)
                total += np.bincount(at, minlength=len(table))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["at", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for at, n in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).toLocalIterator():
        out[at] = n
    return out


class Probe:
    """Membership of hashes in a sorted table: one bit test drops most words before the exact search."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        bits = max(16, int(np.ceil(np.log2(len(table) + 1))) + 5)
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[(table >> self.shift).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and their places in the table."""
        maybe = np.flatnonzero(self.flags[(h >> self.shift).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.table, h[maybe]), len(self.table) - 1)
        found = self.table[at] == h[maybe]
        return maybe[found], at[found]


def _find(data: np.ndarray, off: np.ndarray, block: Block, probe: Probe, first_window: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of a slice's documents, and (document, start, window) of every verified occurrence."""
    w = X.words(data, off, X.NON_ALNUM)
    where, at = probe(w.hashes)
    sizes = first_window[at + 1] - first_window[at]
    cand = np.repeat(first_window[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    where = np.repeat(where, sizes)
    doc = np.searchsorted(w.first, where, side="right") - 1
    start = where - block.place[cand]
    fits = (start >= w.first[doc]) & (start + block.lengths[cand] <= w.first[doc + 1])
    cand, start, doc = cand[fits], start[fits], doc[fits]
    for k in range(window):
        inside = block.lengths[cand] > k
        ok = ~inside
        ok[inside] = w.hashes[start[inside] + k] == block.words[cand[inside], k]
        cand, start, doc = cand[ok], start[ok], doc[ok]
    return w.counts, doc, start - w.first[doc], cand


def search(docs: DataFrame, block: Block, window: int, text: Column, out: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(block)
    made: list = []

    def scan(texts: pa.Array) -> pa.Array:
        b: Block = shipped.value
        if not made:
            table, first = np.unique(b.prefix, return_index=True)
            made.extend([Probe(table), np.append(first, len(b.prefix))])
        counts, hits, hit_off, items, item_off, whole = [], [], [0], [], [0], []
        for lo, hi, data, off in X.slices(texts):
            n, doc, start, cand = _find(data, off, b, made[0], made[1], window) if len(b.prefix) else (X.words(data, off, X.NON_ALNUM, False).counts, *[np.zeros(0, np.int64)] * 3)
            counts.append(n)
            order = np.lexsort((start, doc))
            doc, start, end, item = doc[order], start[order], (start + b.lengths[cand])[order] if len(cand) else start, b.item[cand][order] if len(cand) else cand
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            whole.append(np.bincount(doc, weights=end - start >= window, minlength=hi - lo) > 0)
            for k in range(hi - lo):
                i, j = bounds[k], bounds[k + 1]
                if i < j:
                    s, e = start[i:j], np.maximum.accumulate(end[i:j])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    stop = np.append(np.flatnonzero(new)[1:] - 1, j - i - 1)
                    hits.extend(zip(s[new].tolist(), e[stop].tolist(), strict=True))
                    items.extend(b.names[x] for x in np.unique(item[i:j]))
                hit_off.append(len(hits))
                item_off.append(len(items))
        spans = pa.StructArray.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["s", "e"])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64()), pa.ListArray.from_arrays(pa.array(hit_off, pa.int32()), spans), pa.ListArray.from_arrays(pa.array(item_off, pa.int32()), pa.array(items, pa.string())), pa.array(np.concatenate(whole) if whole else np.zeros(0, bool), pa.bool_())], names=RESULT.fieldNames())

    return docs.withColumn(out, F.arrow_udf(scan, RESULT).asNondeterministic()(text))


def blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_windows: int) -> Iterator[Block]:
    """The benchmark in blocks whose windows are bounded, prefix words by corpus rarity (ties by hash)."""
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()

    def made(items: list[tuple[str, str]]) -> Block:
        words, lengths, item, names = item_windows(items, window)
        vocabulary = np.unique(words[words > 0])
        rank = np.zeros(len(vocabulary), np.int64)
        for lo in range(0, len(vocabulary), BLOCK_WORDS):
            rank[lo : lo + BLOCK_WORDS] = word_counts(docs, vocabulary[lo : lo + BLOCK_WORDS], text_col)
        inside = np.arange(window)[None, :] < lengths[:, None]
        rarity = np.where(inside, rank[np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))] if len(vocabulary) else 0, np.iinfo(np.int64).max)
        place = rarity.argmin(axis=1) if len(words) else np.zeros(0, np.int64)
        prefix = words[np.arange(len(words)), place] if len(words) else np.zeros(0, np.uint64)
        order = np.argsort(prefix, kind="stable")
        return Block(prefix[order], words[order], lengths[order], place[order], item[order], names)

    for r in rows.toLocalIterator():
        items.append((r["i"], r["t"]))
        size += len(r["t"]) // 2
        if size > block_windows:
            yield made(items)
            items, size = [], 0
    if items:
        yield made(items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", out: str = "decon", *, window: int = WINDOW, min_permille: int = MIN_PERMILLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, items (sorted), hits (merged word spans, end exclusive), whole (holds a window of full length) and contaminated."""
    docs = cleared(docs, out)
    found = list(blocks(docs, benchmark, item_col, text_col, window, block_windows)) or [Block(*[np.zeros(0, np.uint64), np.zeros((0, window), np.uint64)], *[np.zeros(0, np.int64)] * 3, [])]
    names = [fresh(docs, f"{out}_block_{k}") for k in range(len(found))]
    for name, block in zip(names, found, strict=True):
        docs = search(docs, block, window, F.col(text_col), name)
    hits = F.array_sort(F.concat(*[F.col(n)["hits"] for n in names]))
    merged = F.aggregate(hits, F.array().cast("array<struct<s:bigint,e:bigint>>"), lambda done, h: F.when((F.size(done) > 0) & (h["s"] <= F.element_at(done, -1)["e"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], h["e"]).alias("e"))))).otherwise(F.concat(done, F.array(h)))) if len(names) > 1 else F.col(names[0])["hits"]
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(n)["items"] for n in names])))
    docs = docs.withColumn(out, F.struct(F.col(names[0])["n_words"].alias("n_words"), items.alias("items"), merged.alias("hits"), F.greatest(*[F.col(n)["whole"] for n in names], F.lit(False)).alias("whole")))
    n_hit = F.aggregate(F.col(out)["hits"], F.lit(0).cast("long"), lambda s, h: s + h["e"] - h["s"])
    docs = docs.withColumn(out, F.col(out).withField("n_hit", n_hit))
    rule = (F.col(out)["n_hit"] > 0) & (1000 * F.col(out)["n_hit"] >= min_permille * F.col(out)["n_words"])
    return docs.withColumn(out, F.col(out).withField("contaminated", rule)).drop(*names)
