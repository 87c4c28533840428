"""Identity and near-duplicate operators: sorted neighbourhoods, masked Hamming distance, barcode clusters, components, keepers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.components import components
from tessera.operators.order import global_rank
from tessera.sources.shared import cut_lineage


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each one reaches over undirected edges (a, b); a node without edges is its own."""
    roots = components(edges.select("a", "b")).withColumnRenamed("root", "component")
    return nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def packed(calls: DataFrame, keys: tuple[str, ...], position: str, call: str, width: int) -> DataFrame:
    """Calls of each read in bit words of 63 positions: `bits` (value is not 0) and `valid` (observed)."""
    words = -(-width // 63)
    word, bit = F.floor(F.col(position) / 63).cast("int"), F.expr(f"shiftleft(1L, cast({position} % 63 as int))")
    per = calls.select(*keys, word.alias("_w"), F.when(F.coalesce(F.col(call) != 0, F.lit(False)), bit).otherwise(F.lit(0)).alias("_b"), F.when(F.col(call).isNotNull(), bit).otherwise(F.lit(0)).alias("_v"))
    per = per.groupBy(*keys).agg(*[F.bit_or(F.when(F.col("_w") == k, F.col(c)).otherwise(F.lit(0))).alias(f"{c}{k}") for c in ("_b", "_v") for k in range(words)])
    return per.select(*keys, F.array(*[f"_b{k}" for k in range(words)]).alias("bits"), F.array(*[f"_v{k}" for k in range(words)]).alias("valid"))


def masked_hamming(a: str, b: str) -> tuple[Column, Column]:
    """(mismatches, overlap) of two packed rows, by population counts."""
    both = F.zip_with(f"{a}.valid", f"{b}.valid", lambda x, y: x.bitwiseAND(y))
    diff = F.zip_with(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: x.bitwiseXOR(y)), both, lambda x, m: x.bitwiseAND(m))
    count = lambda arr: F.aggregate(arr, F.lit(0).cast("int"), lambda s, x: s + F.bit_count(x))
    return count(diff), count(both)


def sorted_neighbours(reads: DataFrame, group: tuple[str, ...], key: Column, identity: str, words: int, window: int, least_overlap: int, threshold: float, block: int = 4096) -> DataFrame:
    """Pairs (a, b, mismatches, overlap) that agree and lie at most `window` places apart in the order of key within a group.

    Ranks run through all groups, numbered range by range, so a group of any size is ranked by many tasks.
    They fall into blocks of `block` rows, each with the first `window` rows of the next, and a block is
    compared place by place, a shift at a time: work is rows times window, and no task holds more than a block.
    """
    block = max(block, window)
    flat = [F.col(c)[k].alias(f"{c[0]}{k}") for c in ("bits", "valid") for k in range(words)]
    ranked = global_rank(reads.dropna(subset=list(group)).select(*group, identity, *flat, key.alias("_o")), *group, "_o", identity, out="_r")
    at = F.floor((F.col("_r") - 1) / block)
    shared = F.when(((F.col("_r") - 1) % block < window) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    dealt = ranked.drop("_o").withColumn("_k", F.explode(shared))
    kind = dict(reads.dtypes)[identity]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        ids, of = pdf[identity].to_numpy(), pdf.groupby(list(group), sort=False).ngroup().to_numpy()
        bits, valid = (pdf[[f"{c}{k}" for k in range(words)]].to_numpy(np.int64).view(np.uint64) for c in "bv")
        own = int(((pdf["_r"].to_numpy() - 1) // block == pdf["_k"].iloc[0]).sum())
        found = []
        for d in range(1, window + 1):
            n = min(own, len(ids) - d)
            if n <= 0:
                break
            both = valid[:n] & valid[d : n + d]
            overlap = np.bitwise_count(both).sum(axis=1, dtype=np.int32)
            differ = np.bitwise_count((bits[:n] ^ bits[d : n + d]) & both).sum(axis=1, dtype=np.int32)
            i = np.flatnonzero((of[:n] == of[d : n + d]) & (overlap >= least_overlap) & (differ < threshold * overlap))
            x, y = ids[i], ids[i + d]
            found.append(pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "mismatches": differ[i], "overlap": overlap[i]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("a", "b", "mismatches", "overlap")})

    return dealt.groupBy("_k").applyInPandas(compare, f"a {kind}, b {kind}, mismatches int, overlap int")


def near_duplicate_reads(calls: DataFrame, group: tuple[str, ...], width: int, *, window: int = 50, least_overlap: int = 20, threshold: float = 0.07, passes: int = 4) -> DataFrame:
    """Pairs of reads that agree: sorted-neighbourhood passes over call strings and permutations of their positions, then masked Hamming distance."""
    rows = packed(calls, (*group, "read_id"), "position", "call", width)
    code = F.coalesce(F.col("call").cast("string"), F.lit("-"))
    text = calls.groupBy(*group, "read_id").agg(F.array_sort(F.collect_list(F.struct("position", code.alias("c")))).alias("s"))
    rows = cut_lineage(rows.join(text, [*group, "read_id"]))
    found = None
    for k in range(passes + 1):
        step = (2 * k + 1) * 7919 if k else 1
        moved = F.array_sort(F.transform("s", lambda x: F.struct((x["position"] * F.lit(step) % 1000003).alias("o"), x["position"].alias("p"), x["c"].alias("c"))))
        order = F.array_join(F.transform(moved, lambda x: F.concat(x["p"].cast("string"), x["c"])), "")
        got = sorted_neighbours(rows, group, order, "read_id", -(-width // 63), window, least_overlap, threshold)
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def duplicate_reads(calls: DataFrame, group: tuple[str, ...], width: int, *, window: int = 50, least_overlap: int = 20, threshold: float = 0.07, passes: int = 4) -> DataFrame:
    """A row for each read: its cluster (smallest read reached over pairs that agree), the cluster's size, and whether another read stands for it.

    Reads of equal calls are one read in all passes, so copies use up no window; read ids are unique over groups.
    """
    calls = cut_lineage(calls.select(*group, "read_id", "position", "call"))
    rows = cut_lineage(packed(calls, (*group, "read_id"), "position", "call", width))
    same = cut_lineage(rows.groupBy(*group, "bits", "valid").agg(F.min("read_id").alias("node"), F.count("*").alias("copies")))
    whole = calls.join(same.select(F.col("node").alias("read_id")), "read_id", "left_semi")
    pairs = near_duplicate_reads(whole, group, width, window=window, least_overlap=least_overlap, threshold=threshold, passes=passes).select("a", "b")
    found = same.join(connected(same.select("node"), pairs), "node")
    sizes = found.groupBy("component").agg(F.sum("copies").alias("cluster_size"))
    known = found.join(sizes, "component").select(*group, "bits", "valid", "component", "cluster_size")
    out = rows.join(known, [*group, "bits", "valid"])
    return out.select(*group, "read_id", F.col("component").alias("cluster"), "cluster_size", (F.col("read_id") != F.col("component")).alias("is_duplicate"))


def keepers(rows: DataFrame, cluster: str, order: list[Column]) -> DataFrame:
    """`is_duplicate`: false for the first row of each cluster in the order of preference."""
    k = F.row_number().over(Window.partitionBy(cluster).orderBy(*order))
    return rows.withColumn("is_duplicate", k > 1).withColumn("cluster_size", F.count("*").over(Window.partitionBy(cluster)))


def one_edit_apart(values: DataFrame, group: tuple[str, ...], value: str) -> DataFrame:
    """Pairs of distinct equal-length values with one substitution: values meet on what is left when a place is masked."""
    rows = values.select(*group, value).distinct()
    masks = rows.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(F.col(value), F.lit(1), i - 1), F.lit("."), F.substring(F.col(value), i + 1, F.length(value))))).alias("_m"))
    x, y = masks.alias("x"), masks.alias("y")
    same = F.col("x._m") == F.col("y._m")
    for g in group:
        same = same & (F.col(f"x.{g}") == F.col(f"y.{g}"))
    return x.join(y, same & (F.col(f"x.{value}") < F.col(f"y.{value}"))).select(*[F.col(f"x.{g}").alias(g) for g in group], F.col(f"x.{value}").alias("a"), F.col(f"y.{value}").alias("b")).distinct()


def umi_clusters(rows: DataFrame, group: tuple[str, ...], value: str) -> DataFrame:
    """Barcodes within one substitution of each other as clusters: representative (commonest, then smallest), cluster size in barcodes and reads."""
    per = cut_lineage(rows.groupBy(*group, value).agg(F.count("*").alias("reads")).withColumn("node", F.concat_ws("|", *group, value)))
    edges = one_edit_apart(per, group, value).select(F.concat_ws("|", *group, "a").alias("a"), F.concat_ws("|", *group, "b").alias("b"))
    comp = connected(per.select("node"), edges)
    whole = per.join(comp, "node")
    heads = whole.groupBy("component").agg(F.max_by(value, F.struct("reads", F.translate(value, "ACGTN", "TGCA0"))).alias("representative"), F.count("*").alias("barcodes"), F.sum("reads").alias("cluster_reads"))
    return whole.join(heads, "component").select(*group, value, "reads", "representative", "barcodes", "cluster_reads")


def pairwise_differences(rows: DataFrame, block: str, key: str, text: str) -> DataFrame:
    """Hamming distance of all pairs of equal-length strings within a bounded block."""
    x, y = rows.alias("x"), rows.alias("y")
    d = F.aggregate(F.zip_with(F.split(f"x.{text}", ""), F.split(f"y.{text}", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + v)
    return x.join(y, (F.col(f"x.{block}") == F.col(f"y.{block}")) & (F.col(f"x.{key}") < F.col(f"y.{key}"))).select(F.col(f"x.{block}").alias(block), F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), d.alias("distance"))
