"""Language-model scoring with a probabilistic suffix tree.

Symbols are bytes: a text is its lower-case words, each spelled out and closed by a separator, the last
one by an end symbol, so the model gives every sequence of words a probability, unseen words included.
Contexts are the last 0 to 5 symbols.  Counts cover every training text.  A context is a candidate if
it is seen MIN_COUNT times, whatever the corpus, and is retained if its next-symbol distribution
diverges from its parent's by more than it costs to write down (likelihood gain over half a log-count
for each successor).  All suffixes of a retained context are retained.  Next-symbol distributions are
smoothed towards the parent's by the Witten-Bell weight, and each symbol is scored in its longest
suffix state.

The tree grows with the corpus, so it stays in a table.  Its buckets follow the last TRUNK + 1 symbols
of a context, so a bucket holds whole branches: every context longer than TRUNK with all its suffixes
longer than TRUNK.  What is collected and broadcast does not grow with the corpus: the trunk (contexts of up
to TRUNK symbols, a matter of the alphabet), and the scores of the frequent runs of DEPTH + 1 symbols
(share p_run or more, at most 1 / p_run).  All other runs meet their branch in a shuffle by bucket.
The unigram base needs the count of every distinct word, which has no bound: words of share p_head or
more (at most 1 / p_head) are broadcast, all others meet their counts in the same shuffle.

Counts travel as sorted numpy blobs, one for each task and bucket; buckets follow the number of shuffle
partitions.  A word below p_head has at most that share of all tokens, so no bucket is hot; a bucket of
runs gets each run's distinct key only.

A worker's memory has to fit beside its executor's heap, so what it holds besides its Arrow batch does not
grow with its partition: texts are taken in slices of SLICE bytes (a longer one is a slice of its own), counts
are merged in place after each PENDING new ones, and FLUSH distinct counts, or words and runs that look for
theirs, leave in blobs that are made a few MB at a time.  At a partition's end freed memory goes back to the
system, as workers outlive their tasks.

Defined results: null text is empty and scores its end symbol alone; an id whose crc32 is null trains
and is not held out; repeated rows get equal scores, a row each; no training rows: the uniform model.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .store import shuffle_buckets, written

DEPTH = 5
TRUNK = 2
P_RUN = 5e-7
P_HEAD = 1e-6
MIN_COUNT = 8
SLICE = 1 << 18
PENDING = 400_000
FLUSH = 2_000_000
PAD, GAP = 10, 32

_SCHEMA = "bucket int, kind int, keys binary, vals binary"
#: Kinds of rows that look for their counts; they sort after those of counts and branches.
_WORDS, _RUNS = 50, 60


def spelled(w: X.Words, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a slice, whether each is scored, and its document: DEPTH pads, then words with their closing symbols."""
    n = len(off) - 1
    lens, counts = w.ends - w.starts, w.counts
    word_doc = np.repeat(np.arange(n), counts)
    empty = counts == 0
    pads = DEPTH * np.arange(1, n + 1) + np.concatenate([[0], np.cumsum(empty)[:-1]])
    place = np.concatenate([[0], np.cumsum(lens)]) + np.arange(len(lens) + 1)
    begin = place[:-1] + pads[word_doc]
    total = int(lens.sum()) + len(lens) + DEPTH * n + int(empty.sum())
    out = np.full(total, PAD, np.uint8)
    reach = np.repeat(w.starts - begin, lens)
    at = np.ones(int(lens.sum()), np.int64)
    if len(lens):
        at[0] = begin[0]
        heads = np.cumsum(lens)[:-1]
        at[heads] = begin[1:] - (begin[:-1] + lens[:-1] - 1)
        at = np.cumsum(at)
    out[at] = w.data[at + reach]
    closing = begin + lens
    last = np.zeros(len(lens), bool)
    last[w.first[1:][counts > 0] - 1] = True
    out[closing[~last]] = GAP
    doc_len = np.bincount(word_doc, weights=lens + 1, minlength=n).astype(np.int64) + DEPTH + empty
    doc = np.repeat(np.arange(n), doc_len)
    scored = np.ones(total, bool)
    starts = np.concatenate([[0], np.cumsum(doc_len)[:-1]])
    for k in range(DEPTH):
        scored[starts + k] = False
    return out, scored, doc


def codes(symbols: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """DEPTH + 1 symbols up to each scored one, the scored one in the low byte."""
    s = symbols.astype(np.uint64)
    c = s.copy()
    for k in range(1, DEPTH + 1):
        c[k:] |= s[:-k] << np.uint64(8 * k)
    return c[scored]


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def counted(keys: np.ndarray, vals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts or sums."""
    if vals is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, vals = keys[order], vals[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if vals is None else np.add.reduceat(vals, at)


def _blobs(kind: int, keys: np.ndarray, vals: np.ndarray, where: np.ndarray, n: int, wide: int = 8) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; rows leave in batches of at most about 4 MB."""
    order = np.argsort(where, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))])
    step = max(1, int(n * (4 << 20) / max(1, len(keys) * (8 + wide))))
    for lo in range(0, n, step):
        rows = [b for b in range(lo, min(n, lo + step)) if ends[b + 1] > ends[b]]
        cut = [(int(ends[b] - ends[lo]), int(ends[b + 1] - ends[lo])) for b in rows]
        if rows:
            at = order[ends[lo] : ends[min(n, lo + step)]]
            x, y = keys[at], vals[at]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([y[a:b].tobytes() for a, b in cut], pa.binary())], names=["bucket", "kind", "keys", "vals"])


def _freed(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then what numpy and Arrow have freed, but their allocators keep, goes back to the system (numpy's where the C library is glibc)."""
    yield from made
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def _branch_bucket(codes: np.ndarray, n: int) -> np.ndarray:
    return (X.mix((codes >> np.uint64(8)) & _mask(TRUNK + 1)) % np.uint64(n)).astype(np.int64)


def _word_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


class Tally:
    """Sums by key, sorted; what is added waits in pieces of PENDING entries, so a merge needs little beside the result."""

    def __init__(self) -> None:
        self.keys, self.vals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.pieces.append((keys, vals))
        self.pending += len(keys)
        if self.pending > PENDING:
            self.merge()

    def merge(self) -> None:
        if not self.pieces:
            return
        keys, vals = counted(np.concatenate([p[0] for p in self.pieces]), np.concatenate([p[1] for p in self.pieces]))
        self.pieces, self.pending = [], 0
        at, found = _find(self.keys, keys)
        self.vals[at[found]] += vals[found]
        keys, vals = keys[~found], vals[~found]
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.vals = np.insert(self.vals, at, vals)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All sums; none stay."""
        self.merge()
        out = self.keys, self.vals
        self.__init__()
        return out


def _gather(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's words (kind -1) and runs of DEPTH + 1 symbols (kind DEPTH), in blobs by bucket."""
    words, runs = Tally(), Tally()

    def flush() -> Iterator[pa.RecordBatch]:
        h, c = words.taken()
        yield from _blobs(-1, h, c, _word_bucket(h, n), n)
        g, c = runs.taken()
        yield from _blobs(DEPTH, g, c, _branch_bucket(g, n), n)

    for batch in batches:
        for _, _, data, off in X.slices(batch.column(0), SLICE):
            w = X.words(data, off)
            words.add(*counted(w.hashes))
            symbols, scored, _ = spelled(w, off)
            runs.add(*counted(codes(symbols, scored)))
            if len(words.keys) + len(runs.keys) > FLUSH:
                yield from flush()
    yield from flush()


def _blob_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Buffer, pa.Buffer]]:
    """(bucket, kind, keys, vals) of each row; the blobs are not copied."""
    return zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), (x.as_buffer() for x in batch.column("keys")), (y.as_buffer() for y in batch.column("vals")), strict=True)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[pa.Buffer], list[pa.Buffer]]]:
    """Runs of rows of equal (bucket, kind)."""
    now, keys, vals = None, [], []
    for batch in batches:
        for b, k, x, y in _blob_rows(batch):
            if now is not None and now != (b, k):
                yield *now, keys, vals
                keys, vals = [], []
            now = (b, k)
            keys.append(x)
            vals.append(y)
    if now is not None:
        yield *now, keys, vals


def _starts(runs: np.ndarray) -> np.ndarray:
    """Where each context begins in sorted runs."""
    ctx = runs >> np.uint64(8)
    return np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(runs) else np.zeros(0, int)


def _often(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose context is seen MIN_COUNT times or more."""
    at = _starts(g)
    keep = np.repeat(np.add.reduceat(c, at) >= MIN_COUNT, np.diff(np.append(at, len(g)))) if len(g) else np.zeros(0, bool)
    return g[keep], c[keep]


def _row(bucket: int, kind: int, keys: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([vals.tobytes()], pa.binary())], names=["bucket", "kind", "keys", "vals"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket and kind: distinct words and their totals; of runs, each length above TRUNK without contexts under MIN_COUNT, and the bucket's part of the trunk's runs whole."""
    for b, k, keys, vals in _grouped(batches):
        x, c = counted(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(vals), np.int64))
        if k < 0:
            yield _row(b, k, x, c)
            continue
        for level in range(DEPTH, TRUNK, -1):
            x, c = counted(x & _mask(level + 1), c)
            yield _row(b, level, *_often(x, c))
        yield _row(b, TRUNK, *counted(x & _mask(TRUNK + 1), c))


@dataclass
class Model:
    """For each context length: retained contexts with their log10 weight of backing off, and (context, symbol) runs with log10 probabilities, both sorted."""

    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    runs: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0

    def score(self, code: np.ndarray, first: int = 0) -> np.ndarray:
        """log10 probability of each code's low symbol after its other symbols; lists begin at contexts of `first` symbols."""
        out, open_ = np.zeros(len(code)), np.arange(len(code))
        for k in range(len(self.contexts) - 1, -1, -1):
            c = code[open_]
            at, here = _find(self.contexts[k], (c >> np.uint64(8)) & _mask(first + k))
            run, seen = _find(self.runs[k], c & _mask(first + k + 1))
            seen &= here
            out[open_[seen]] += self.logs[k][run[seen]]
            miss = here & ~seen
            out[open_[miss]] += self.backoff[k][at[miss]]
            open_ = open_[~seen]
        out[open_] += self.unseen
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def _level(k: int, g: np.ndarray, c: np.ndarray, runs: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of one length, their log10 weights of backing off, whether they diverge from their parents', and the probabilities of their runs; runs and probs are the parents'."""
    at = _starts(g)
    t = np.diff(np.append(at, len(g)))
    n = np.add.reduceat(c, at).astype(float) if len(g) else np.zeros(0)
    parent = probs[_find(runs, g & _mask(k))[0]] if len(g) else np.zeros(0)
    gain = np.add.reduceat(c * np.log(c / np.repeat(n, t) / parent), at) if len(g) else np.zeros(0)
    return g[at] >> np.uint64(8), np.log10(t / (n + t)), gain > 0.5 * t * np.log(np.maximum(n, 2)), (c + np.repeat(t, t) * parent) / np.repeat(n + t, t)


def _closed(contexts: list[np.ndarray], kept: list[np.ndarray], first: int) -> None:
    """Mark the suffixes of kept contexts as kept, from the longest down to lengths of `first`; lists begin at length `first`."""
    for i in range(len(contexts) - 1, 0, -1):
        up, found = _find(contexts[i - 1], contexts[i][kept[i]] & _mask(first + i - 1))
        kept[i - 1][up[found]] = True


def _only(g: np.ndarray, values: np.ndarray, contexts: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of kept contexts with their values."""
    keep = np.repeat(kept, np.diff(np.append(np.searchsorted(g >> np.uint64(8), contexts), len(g))))
    return g[keep], values[keep]


@dataclass
class Trunk:
    """The candidates of up to TRUNK symbols: the root, then for each length (runs, contexts, weights, divergence, probabilities)."""

    root: Model
    levels: list[tuple[np.ndarray, ...]]

    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the longest contexts and their probabilities."""
        return (self.levels[-1][0], self.levels[-1][4]) if self.levels else (self.root.runs[0], 10.0 ** self.root.logs[0])

    def model(self, suffixes: np.ndarray) -> Model:
        """The retained part, with all suffixes of `suffixes` (contexts of TRUNK symbols whose branches are retained)."""
        r = self.root
        out = Model(list(r.contexts), list(r.backoff), list(r.runs), list(r.logs), r.unseen)
        contexts, kept = [x[1] for x in self.levels], [x[3].copy() for x in self.levels]
        if kept:
            kept[-1][_find(contexts[-1], suffixes)[0]] = True
        _closed(contexts, kept, 1)
        for (g, ctx, weights, _, probs), keep in zip(self.levels, kept, strict=True):
            runs, logs = _only(g, np.log10(probs), ctx, keep)
            out.contexts.append(ctx[keep])
            out.backoff.append(weights[keep])
            out.runs.append(runs)
            out.logs.append(logs)
        return out


def trunk(runs: np.ndarray, counts: np.ndarray) -> Trunk:
    """Smoothing and divergence tests from the root down, from the counts of all runs of TRUNK + 1 symbols."""
    alphabet = 257.0
    g, c = counted(runs & _mask(1), counts)
    total = float(c.sum())
    root = np.log10((c + 0.5) / (total + 0.5 * alphabet))
    out = Trunk(Model([np.zeros(1, np.uint64)], [np.zeros(1)], [g], [root], float(np.log10(0.5 / (total + 0.5 * alphabet)))), [])
    for k in range(1, TRUNK + 1):
        g, c = _often(*counted(runs & _mask(k + 1), counts))
        if not len(g):
            break
        out.levels.append((g, *_level(k, g, c, *out.parents())))
    return out


def branches(levels: dict[int, tuple[np.ndarray, np.ndarray]], runs: np.ndarray, probs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, weights, runs, logs) of the retained contexts of a bucket for each length above TRUNK; runs and probs are the trunk's."""
    made, kept = [], []
    for k in range(TRUNK + 1, DEPTH + 1):
        g, c = levels[k]
        ctx, weights, diverge, probs = _level(k, g, c, runs, probs)
        made.append((g, ctx, weights, probs))
        kept.append(diverge)
        runs = g
    _closed([m[1] for m in made], kept, TRUNK + 1)
    return [(ctx[keep], weights[keep], *_only(g, np.log10(p), ctx, keep)) for (g, ctx, weights, p), keep in zip(made, kept, strict=True)]


@dataclass
class Fitted:
    """The retained trunk, the scores of frequent runs, the table of branches, the head words (hash -> count), the totals of the unigram base, and the table of word counts."""

    model: Model
    often: np.ndarray
    often_logs: np.ndarray
    tree: DataFrame
    head: np.ndarray
    head_counts: np.ndarray
    tokens: int
    types: int
    ends: int
    counts: DataFrame
    buckets: int


def fit(texts: DataFrame, text_col: str = "text", *, p_run: float = P_RUN, p_head: float = P_HEAD) -> Fitted:
    """Count all rows of texts and grow the tree."""
    spark = texts.sparkSession
    n = shuffle_buckets(spark)
    gathered = texts.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _freed(_gather(it, n)), _SCHEMA)
    counts = written(gathered.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda it: _freed(_summed(it)), _SCHEMA), "suffix-counts")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [np.frombuffer(v, np.int64) for v in batch.column("vals").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array([len(x) for x in c], pa.int64()), pa.array([int(x.sum()) for x in c], pa.int64())], names=["kind", "types", "total"])

    sums = {r["kind"]: r for r in counts.where(f"kind in (-1, {TRUNK})").select("kind", "vals").mapInArrow(total, "kind int, types long, total long").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("total").alias("total")).collect()}
    ends = texts.count()
    words = sums[-1]["total"] if -1 in sums else 0
    tokens, symbols = words + ends, sums[TRUNK]["total"] if TRUNK in sums else 0

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], names=["run", "n"])

    short = counts.where(F.col("kind") == TRUNK).select("keys", "vals").mapInArrow(flat, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    base = trunk(short.column("run").to_numpy().astype(np.uint64), short.column("n").to_numpy())
    shipped = spark.sparkContext.broadcast(base)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket: contexts with weights (kind k), their runs with logs (kind 10 + k), the trunk's contexts that branches hang on (kind 20), frequent runs with their scores, NaN where the trunk scores them (kind 30)."""
        now, levels = None, {}

        def made() -> Iterator[pa.RecordBatch]:
            grown = branches(levels, *shipped.value.parents())
            for k, (ctx, weights, runs, logs) in enumerate(grown, TRUNK + 1):
                yield _row(now, k, ctx, weights)
                yield _row(now, 10 + k, runs, logs)
            hang = np.unique(grown[0][0] & _mask(TRUNK))
            yield _row(now, 20, hang, np.zeros(0))
            often = levels[DEPTH][0][levels[DEPTH][1] >= p_run * symbols]
            tree = Model([g[0] for g in grown], [g[1] for g in grown], [g[2] for g in grown], [g[3] for g in grown], np.nan)
            yield _row(now, 30, often, tree.score(often, TRUNK + 1))

        for batch in batches:
            for b, k, x, y in _blob_rows(batch):
                if now is not None and b != now:
                    yield from made()
                    levels = {}
                now = b
                levels[k] = (np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64))
        if now is not None:
            yield from made()

    tree = written(counts.where(F.col("kind") > TRUNK).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda it: _freed(grow(it)), _SCHEMA), "suffix-tree")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, x, y in _blob_rows(batch):
                h, c = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)
                keep = c >= p_head * tokens
                if keep.any():
                    yield _row(b, k, h[keep], c[keep])

    def collected(rows: DataFrame, of: type) -> tuple[np.ndarray, np.ndarray]:
        got = [(bytes(r["keys"]), bytes(r["vals"])) for r in rows.select("keys", "vals").toLocalIterator()]
        keys, vals = np.frombuffer(b"".join(x for x, _ in got), np.uint64), np.frombuffer(b"".join(y for _, y in got), of)
        order = np.argsort(keys)
        return keys[order], vals[order] if len(vals) else vals

    head, head_counts = collected(counts.where("kind = -1").mapInArrow(heads, _SCHEMA), np.int64)
    model = base.model(np.unique(collected(tree.where("kind = 20"), float)[0]))
    often, logs = collected(tree.where("kind = 30"), float)
    rest = np.isnan(logs)
    logs = logs.copy()
    logs[rest] = model.score(often[rest])
    return Fitted(model, often, logs, tree.where("kind < 20"), head, head_counts, tokens, (sums[-1]["types"] if -1 in sums else 0) + (ends > 0), ends, counts, n)


_TYPES = {"bucket": pa.int32(), "rid": pa.int64(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "keys": pa.binary(), "vals": pa.binary()}
_PART = "kind int, bucket int, rid long, n long, known long, base double, score double, keys binary, vals binary"


def _part(kind: int, ids: pa.Array, **cols: np.ndarray | list) -> pa.RecordBatch:
    size = len(ids)
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), *(pa.array(cols[k], t) if k in cols else pa.nulls(size, t) for k, t in _TYPES.items()), ids], names=["kind", *_TYPES, "id"])


def _measure(batches: Iterator[pa.RecordBatch], broadcast: tuple[np.ndarray, ...], n: int, norm: float, ends: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition (kind 0) with what the frequent words and runs tell, then the other words and runs in blobs by bucket."""
    often, often_log, head, head_log = broadcast
    end_log, end_known = float(np.log10(ends + 0.5)), int(ends > 0)
    late: dict[int, list] = {_WORDS: [], _RUNS: []}
    size, id_type = 0, [pa.null()]

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, where in ((_WORDS, _word_bucket), (_RUNS, _branch_bucket)):
            x, r = np.concatenate([p[0] for p in late[kind]]), np.concatenate([p[1] for p in late[kind]])
            late[kind] = []
            for b in _blobs(kind, x, r, where(x, n), n):
                yield _part(kind, pa.nulls(b.num_rows, id_type[0]), bucket=b.column("bucket"), keys=b.column("keys"), vals=b.column("vals"))

    for batch in batches:
        rid, ids = batch.column("rid").to_numpy(zero_copy_only=False), batch.column("id")
        id_type[0] = ids.type
        for lo, hi, data, off in X.slices(batch.column("text"), SLICE):
            w = X.words(data, off)
            docs_of = w.docs
            order = np.argsort(w.hashes)
            h, d = w.hashes[order], docs_of[order]
            u, c = counted(h)
            at, found = _find(head, u)
            logs = np.repeat(np.where(found, head_log[at] if len(head) else 0.0, 0.0), c)
            is_head = np.repeat(found, c)
            m = hi - lo
            base = np.bincount(d, weights=logs, minlength=m)
            known = np.bincount(d[is_head], minlength=m)
            symbols, scored, doc = spelled(w, off)
            packed = np.sort(codes(symbols, scored) << np.uint64(16) | doc[scored].astype(np.uint64))
            u, c = counted(packed >> np.uint64(16))
            at, found = _find(often, u)
            logs = np.repeat(np.where(found, often_log[at] if len(often) else 0.0, 0.0), c)
            is_often = np.repeat(found, c)
            d_run = (packed & np.uint64(0xFFFF)).astype(np.int64)
            total = np.bincount(d_run, weights=logs, minlength=m)
            yield _part(0, ids.slice(lo, m), rid=rid[lo:hi], n=w.counts + 1, known=known + end_known, base=base + end_log - (w.counts + 1) * norm, score=total)
            late[_WORDS].append((h[~is_head], rid[lo:hi][d[~is_head]]))
            late[_RUNS].append((packed[~is_often] >> np.uint64(16), rid[lo:hi][d_run[~is_often]]))
            size += len(late[_WORDS][-1][0]) + len(late[_RUNS][-1][0])
            if size > FLUSH:
                yield from flush()
                size = 0
    if late[_WORDS]:
        yield from flush()


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id as `id`, n_tokens, n_known, base_score and score."""
    spark, n, norm = docs.sparkSession, fitted.buckets, float(np.log10(fitted.tokens + 0.5 * (fitted.types + 1)))
    shipped = spark.sparkContext.broadcast((fitted.often, fitted.often_logs, fitted.head, np.log10(fitted.head_counts + 0.5)))
    trunk_of = spark.sparkContext.broadcast(fitted.model)
    ends = fitted.ends
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("rid", F.monotonically_increasing_id())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a bucket's words and its branches, then the words and runs that look for theirs, summed by row."""
        top = trunk_of.value
        keys, logs, tree, bucket = np.zeros(0, np.uint64), np.zeros(0), {}, None
        model = top
        for batch in batches:
            for b, kind, x, y in _blob_rows(batch):
                if b != bucket:
                    keys, logs, tree, bucket, model = np.zeros(0, np.uint64), np.zeros(0), {}, b, top
                if kind < 0:
                    keys, logs = np.frombuffer(x, np.uint64), np.log10(np.frombuffer(y, np.int64) + 0.5)
                    continue
                if kind < _WORDS:
                    tree[kind] = (np.frombuffer(x, np.uint64), np.frombuffer(y, float))
                    if kind == 10 + DEPTH:
                        own = range(TRUNK + 1, DEPTH + 1)
                        model = Model(top.contexts + [tree[k][0] for k in own], top.backoff + [tree[k][1] for k in own], top.runs + [tree[10 + k][0] for k in own], top.logs + [tree[10 + k][1] for k in own], top.unseen) if len(top.contexts) > TRUNK else top
                    continue
                h, rid = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)
                if kind == _RUNS:
                    ids, back = np.unique(rid, return_inverse=True)
                    u, same = np.unique(h, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.zeros(len(ids), np.int64)), pa.array(np.zeros(len(ids))), pa.array(np.bincount(back, weights=model.score(u)[same]))], names=["rid", "known", "base", "score"])
                    continue
                order = np.argsort(h)
                at, found = _find(keys, h[order])
                value = np.where(found, logs[at] if len(keys) else 0.0, float(np.log10(0.5)))
                ids, back = np.unique(rid[order], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.bincount(back, weights=found).astype(np.int64)), pa.array(np.bincount(back, weights=value)), pa.array(np.zeros(len(ids)))], names=["rid", "known", "base", "score"])

    # The measuring pass is written once: its rows by document and its words and runs by bucket are read apart.
    kind = rows.schema["id"].dataType.simpleString()
    parts = written(rows.select("rid", "id", "text").mapInArrow(lambda it: _freed(_measure(it, shipped.value, n, norm, ends)), f"{_PART}, id {kind}"), "suffix-parts")
    late = parts.where("kind > 0").select("bucket", "kind", "keys", "vals").unionByName(fitted.counts.where("kind = -1")).unionByName(fitted.tree)
    settled = late.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda it: _freed(settle(it)), "rid long, known long, base double, score double")
    whole = parts.where("kind = 0").select("rid", "id", "n", "known", "base", "score")
    both = whole.unionByName(settled, allowMissingColumns=True)
    return both.groupBy("rid").agg(F.max("id").alias("id"), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.round(F.sum("score"), 9).alias("score")).drop("rid")
