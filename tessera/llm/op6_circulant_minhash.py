"""Near-duplicate detection by circulant MinHash.

A document's set is its distinct runs of `shingle` words.  Two permutations of the 64-bit integers make
every signature coordinate: the first scatters a shingle, the second is applied to that value shifted
circularly by k for coordinate k.  `bands` bands of `rows` coordinates give the candidate buckets, and
candidates are confirmed by exact Jaccard similarity of the full sets.

Documents of equal sets collapse to one class first, by both 64-bit halves of a digest, so thousands of exact
copies are one node.  Shingles are compared as 64-bit hashes throughout.  Within a bucket no pairs are enumerated: each member is compared with one hub, in even
bands the member that is smallest under the band's own hash, in odd bands the one that shares the largest
buckets, which is the middle of a group of copies.  Different bands have different hubs, and they
connect a group.  Members of buckets that still span several components go through an exact second
pass, a similarity join on prefixes: shingles in one fixed order, rarest first, meet only where size and
position still allow the threshold, so members that no one resembles cost no comparisons.

Hot groups: keys that hold more than a ten-thousandth of the rows (so at most 10,000 of them) meet their one row
on the other side by broadcast, all others by shuffle; a text that many pairs need is dealt to several tasks.

A pair at the threshold of 0.8 shares no band with a chance of 3e-5 (20 bands of 4 rows).

Defined results: null text, or text without words: n_shingles 0, linked with nothing.  Rows that repeat
a doc_id are rows of their own and get the component of their set.  A null doc_id never becomes the
component of others while they have one.  Very long texts are read whole.  An empty table gives an empty one;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components

from . import text as X
from .store import written

SHINGLE = 5
BANDS, ROWS = 20, 4
THRESHOLD = 80
#: Bounds (powers of 2) of the counters of the shingle-frequency sketch that orders prefixes, four for each shingle; any order gives right results.
LEAST_SLOTS, MOST_SLOTS = 16, 22
#: Keys of more rows than this share of all are hot, if they hold more than FEW.
HOT, FEW = 10_000, 64
_SEEDS = np.random.default_rng(61).integers(1, 2**63, 4, dtype=np.uint64)


def signature(sets: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Circulant signatures (documents x size) of non-empty sets."""
    first = X.mix(sets ^ _SEEDS[0])
    out = np.empty((len(ends) - 1, size), np.uint64)
    for k in range(size):
        shifted = (first - np.uint64(k)) * np.uint64(0xD1342543DE82EF95) ^ _SEEDS[1]
        shifted ^= shifted >> np.uint64(32)
        shifted *= np.uint64(0xAF251AF3B0F025B5)
        shifted ^= shifted >> np.uint64(29)
        out[:, k] = np.minimum.reduceat(shifted, ends[:-1])
    return out


_SKETCH = "id {id}, hash long, n int, d1 long, d2 long, bands array<long>"


def _sketcher(shingle: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in X.slices(batch.column("text")):
                values, ends = X.unique_per_doc(*X.grams(X.words(data, off), shingle))
                n = np.diff(ends)
                some = n > 0
                m = hi - lo
                d1, d2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                keys = np.zeros((0, bands), np.uint64)
                if some.any():
                    cut = np.concatenate([ends[:-1][some], ends[-1:]])
                    d1[some] = np.add.reduceat(X.mix(values ^ _SEEDS[2]), cut[:-1])
                    d2[some] = np.add.reduceat(X.mix(values + _SEEDS[3]), cut[:-1]) ^ n[some].astype(np.uint64)
                    sig = signature(values, cut, bands * rows)
                    parts = sig.reshape(len(sig), bands, rows)
                    keys = np.full((len(sig), bands), 7, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        keys = X.mix(keys * np.uint64(31) + parts[:, :, r])
                nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys.view(np.int64).reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, m), batch.column("hash").slice(lo, m), pa.array(n.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), nested], names=["id", "hash", "n", "d1", "d2", "bands"])

    return sketch


def _confirm(shingle: int, threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            sets: dict[int, np.ndarray] = {}
            for ids, texts in ((a, batch.column("ta")), (b, batch.column("tb"))):
                u, at = np.unique(ids, return_index=True)
                fresh = np.array([x not in sets for x in u.tolist()], bool)
                u, at = u[fresh], at[fresh]
                column = texts.take(pa.array(at))
                for lo, hi, data, off in X.slices(column):
                    values, ends = X.unique_per_doc(*X.grams(X.words(data, off), shingle))
                    for k in range(lo, hi):
                        sets[int(u[k])] = values[ends[k - lo] : ends[k - lo + 1]]
            keep = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                p, q = sets[x], sets[y]
                if 100 * min(len(p), len(q)) >= threshold * max(len(p), len(q)):
                    merged = np.sort(np.concatenate([p, q]))
                    both = int((merged[1:] == merged[:-1]).sum())
                    keep[k] = 100 * both >= threshold * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return confirm


def _sketch_counts(shingle: int, slots: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for _, _, data, off in X.slices(batch.column("text")):
                values, _ = X.unique_per_doc(*X.grams(X.words(data, off), shingle))
                total += np.bincount((values % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return count


def _prefixes(shingle: int, threshold: int, shipped):
    """(node, size, token, place) of the first shingles of each set: as many as a partner of any allowed size could need."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for lo, _, data, off in X.slices(batch.column("text")):
                values, ends = X.unique_per_doc(*X.grams(X.words(data, off), shingle))
                sizes = np.diff(ends)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, counts[(values % np.uint64(len(counts))).astype(np.int64)], doc))
                place = np.arange(len(values)) - ends[:-1][doc]
                keep = place < (sizes - (threshold * sizes + 99) // 100 + 1)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[lo + doc[keep]]), pa.array(sizes[doc[keep]].astype(np.int32)), pa.array(values[order][keep].view(np.int64)), pa.array(place[keep].astype(np.int32))], names=["node", "size", "token", "place"])

    return cut


def hot_bound(total: int) -> int:
    """Rows above which a key is hot: so at most HOT keys of `total` rows are."""
    return max(FEW, total // HOT)


def met(left: DataFrame, right: DataFrame, keys: list[str], weight: str, bound: int) -> DataFrame:
    """left joined to right's one row for each of its keys; weight counts the rows of left that a row of right meets."""
    hot, rest = right.where(F.col(weight) > bound), right.where(F.col(weight) <= bound)
    cool = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(cool.join(rest, keys))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each row of docs: id, hash (xxhash64 of the text), n_shingles, component_id and links (confirmed links of its class: with hubs, and those of the exact pass)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    sketches = written(source.mapInArrow(_sketcher(shingle, bands, rows), _SKETCH.format(id=source.schema["id"].dataType.simpleString())), "minhash-sketches")
    # One node for each distinct set, numbered as it is written; a row of it lends its text.
    full = sketches.where("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.min(F.struct("id", "hash")).alias("row"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    total = nodes.count()
    # Buckets of two nodes or more, their members, and a hub for each.
    bound = hot_bound(total * bands)
    member = nodes.select("node", "d1", F.posexplode("bands").alias("band", "key"))
    buckets = written(member.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "minhash-sizes")
    member = written(met(member, buckets, ["band", "key"], "size", bound), "minhash-buckets")
    middle = member.groupBy("node").agg(F.sum("size").alias("share"))
    order = F.struct(F.when(F.col("band") % 2 == 1, F.col("share")).otherwise(0).alias("share"), F.xxhash64("d1", "band").alias("mixed"), F.col("node").alias("hub"))
    hubs = written(member.join(middle, "node").groupBy("band", "key").agg(F.max(order)["hub"].alias("hub"), F.first("size").alias("size")), "minhash-hubs")
    compared = met(member.drop("size"), hubs, ["band", "key"], "size", bound).where("node <> hub")
    pairs = written(compared.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "minhash-pairs")

    def lent(wanted: DataFrame, tag: str) -> DataFrame:
        """One text of each wanted node; copies of a text share id and hash with no other class."""
        rows_of = nodes.join(wanted, "node").select("node", F.col("row.id").alias("rid"), F.col("row.hash").alias("hash"))
        found = source.join(rows_of, (source["hash"] == rows_of["hash"]) & F.col("id").eqNullSafe(F.col("rid"))).select("node", "text")
        return written(found.groupBy("node").agg(F.first("text").alias("text")), tag)

    def with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, end: str, other: str, each: int) -> DataFrame:
        """rows (of pairs) with the text of one end; a text that more than `each` pairs need goes to several tasks."""
        busy = pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > each).select("node", F.ceil(F.col("n") / each).cast("int").alias("tasks"))
        busy = F.broadcast(written(busy, "minhash-busy"))
        dealt = rows.withColumnRenamed(end, "node").join(busy, "node", "left").withColumn("task", F.coalesce(F.pmod(F.xxhash64(other), F.col("tasks")), F.lit(0).cast("long")))
        copies = texts.join(busy, "node", "left").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1)).cast("long") - 1)))
        both = dealt.drop("tasks").join(copies.drop("tasks").withColumnRenamed("text", f"t{end}"), ["node", "task"])
        return both.drop("task").withColumnRenamed("node", end)

    def linked(pairs: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        each = hot_bound(pairs.count())
        both = with_text(with_text(pairs, pairs, texts, "a", "b", each), pairs, texts, "b", "a", each)
        return written(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, threshold), "a long, b long"), tag)

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = lent(ends, "minhash-texts")
    edges = linked(pairs, texts, "minhash-links")
    roots = components(edges)
    # The exact way for the rest: members of buckets that still span several components.
    placed = member.where("size > 2").join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "key", "size")
    rest = written(met(placed, written(split, "minhash-split"), ["band", "key"], "size", bound).select("node", "root").distinct(), "minhash-rest")
    left = rest.join(texts, "node")
    shingles = rest.join(nodes.select("node", "n"), "node").agg(F.sum("n")).collect()[0][0] or 0
    slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, int(4 * shingles).bit_length()))
    counts = np.zeros(slots, np.int64)
    for r in left.select("text").mapInArrow(_sketch_counts(shingle, slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["slot"]] = r["n"]
    shipped = spark.sparkContext.broadcast(counts)
    prefix = left.select("node", "text").mapInArrow(_prefixes(shingle, threshold, shipped), "node long, size int, token long, place int").join(rest, "node")
    prefix = written(prefix, "minhash-prefixes")
    # A set meets a partner of its own size or smaller only on the partner's shorter prefix.
    need = F.ceil(threshold * (F.col("x.size") + F.col("y.size")) / (100 + threshold) - 1e-9)
    short = prefix.where(F.col("place") < F.col("size") - F.ceil(2 * threshold * F.col("size") / (100 + threshold) - 1e-9) + 1)
    fits = (100 * F.col("y.size") >= threshold * F.col("x.size")) & (F.col("y.size") <= F.col("x.size")) & (1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) - 1 >= need)
    second = prefix.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & fits)
    second = second.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    second = written(second.join(pairs, ["a", "b"], "left_anti"), "minhash-second")
    if second.take(1):
        late = linked(second, texts, "minhash-links-2")
        edges = edges.unionByName(late)
        # The first pass's components are nodes now: its own edges need not be walked again.
        of = rest.select(F.col("node"), "root")
        joined = late.join(of.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        over = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        every = nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = every.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    degree = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    known = nodes.select("node", "d1", "d2", "copies", "low").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = written(known, "minhash-known")
    lows = written(known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size")), "minhash-lows")
    answer = met(known, lows, ["root"], "size", hot_bound(total)).select("d1", "d2", "copies", "component_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    out = met(full.select("id", "hash", "n", "d1", "d2"), written(answer, "minhash-answers"), ["d1", "d2"], "copies", hot_bound(total))
    out = out.select("id", "hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "links")
    none = sketches.where("n = 0").select("id", "hash", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    return out.unionByName(none)
