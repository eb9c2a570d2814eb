"""Operator 5: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.llm.common import hash31, hash_bucket
from molsift.session import materialise


def differencing(vectors: list[list[int]], ways: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions.

    ``vectors[i]`` holds the ``ways`` sums of partial partition i (a single
    group is its size and zeros). Returns for each i the final slot of each of
    its sums. Two partial partitions with the largest spread are combined, one
    in descending and the other in ascending order, until one is left.
    """
    def entry(sums, order, node):
        ranked = sorted(range(ways), key=lambda j: (-sums[j], j))
        return (-(sums[ranked[0]] - sums[ranked[-1]]), node, [sums[j] for j in ranked], [order[j] for j in ranked])

    identity = list(range(ways))
    heap = [entry(v, identity, i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    made: list[tuple] = []  # combination i is node len(vectors) + i
    while len(heap) > 1:
        _, a, sums_a, slots_a = heapq.heappop(heap)
        _, b, sums_b, slots_b = heapq.heappop(heap)
        made.append((a, slots_a, b, slots_b))
        joined = [x + y for x, y in zip(sums_a, reversed(sums_b))]
        heapq.heappush(heap, entry(joined, identity, len(vectors) + len(made) - 1))
    final: dict[int, list[int]] = {}
    if heap:
        _, root, _, slots = heap[0]
        final[root] = [0] * ways
        for place, slot in enumerate(slots):
            final[root][slot] = place
    for i in range(len(made) - 1, -1, -1):
        a, slots_a, b, slots_b = made[i]
        out = final.pop(len(vectors) + i)
        final[a], final[b] = [0] * ways, [0] * ways
        for j in range(ways):
            final[a][slots_a[j]] = out[j]
            final[b][slots_b[ways - 1 - j]] = out[j]
    return [final[i] for i in range(len(vectors))]


def assign_groups(groups: DataFrame, ways: int, per_bucket: int = 4096, fan_in: int = 256) -> DataFrame:
    """Shard of each group of ``groups`` (gk binary, bytes long): gk, shard.

    Groups are dealt into buckets of about ``per_bucket`` by hash, and each
    bucket is partitioned by differencing in one task. Every bucket is then a
    partial partition itself; ``fan_in`` of them at a time are combined by the
    same rule, level by level, until one is left. What a task holds is bounded
    by the two parameters; the number of levels grows with the logarithm.
    """
    n_buckets = max(1, -(-groups.count() // per_bucket))
    zeros = [0] * (ways - 1)

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gk"], ascending=[False, True], ignore_index=True)
        slots = differencing([[int(b), *zeros] for b in pdf["bytes"]], ways)
        return pdf[["gk", "bytes", "node"]].assign(slot=[s[0] for s in slots])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        vectors = []
        for have in pdf["sums"]:
            v = [0] * ways
            for s in have:
                v[int(s["slot"])] = int(s["bytes"])
            vectors.append(v)
        slots = differencing(vectors, ways)
        return pd.DataFrame([(n, u, j, s[j]) for n, u, s in zip(pdf["node"], pdf["up"], slots) for j in range(ways)],
                            columns=["node", "up", "slot", "up_slot"])

    node = F.pmod(F.xxhash64("gk"), F.lit(n_buckets)).cast("long")
    leaf = materialise(groups.select("gk", "bytes", node.alias("node")).groupBy("node")
                       .applyInPandas(leaves, "gk binary, bytes long, node long, slot int"), "shard-leaves")
    sums = leaf.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"))
    levels, width = [], n_buckets
    while width > 1:
        vectors = sums.groupBy("node").agg(F.collect_list(F.struct("slot", "bytes")).alias("sums"))
        level = materialise(vectors.withColumn("up", F.expr(f"node div {fan_in}")).groupBy("up")
                            .applyInPandas(combine, "node long, up long, slot int, up_slot int"), "shard-level")
        sums = (sums.join(level, ["node", "slot"]).groupBy(F.col("up").alias("node"), F.col("up_slot").alias("slot"))
                .agg(F.sum("bytes").alias("bytes")))
        levels.append(level)
        width = -(-width // fan_in)
    place = None  # (node, slot) of the leaves -> shard, composed from the top down
    for level in reversed(levels):
        if place is None:
            place = level.select("node", "slot", F.col("up_slot").alias("shard"))
        else:
            place = level.join(place.select(F.col("node").alias("up"), F.col("slot").alias("up_slot"), "shard"),
                               ["up", "up_slot"]).select("node", "slot", "shard")
    if place is None:
        return leaf.select("gk", F.col("slot").alias("shard"))
    return leaf.join(materialise(place, "shard-places"), ["node", "slot"]).select("gk", "shard")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", ways: int = 16,
          per_bucket: int = 4096, fan_in: int = 256, slot_rows: int = 10_000) -> DataFrame:
    """Put rows into shards 0..ways-1 of near equal bytes; equal texts stay together.

    Returns one row per input row: ``key``, size (UTF-8 bytes plus 1),
    text_crc32, law ("bytes"), shard, slot (gapless from 0 in its shard) and
    grown_shard (null). A group weighs the sizes of all its rows. Groups are
    made by a SHA-256 of the text and pre-aggregated, so a text with a third of
    all rows is one weight; its rows meet that weight in a join, which AQE
    splits when skewed, and number themselves by ranges of a hash of the key.
    A group above the mean shard can't be balanced whole and is kept whole.

    A null text counts as the empty text (size 1); null and repeated keys are
    rows like any other; an empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("_k"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("gk"))
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("gk").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = rows.join(assign_groups(groups, ways, per_bucket, fan_in), "gk")
    placed = placed.withColumn("_h", hash31(F.col("_k"), F.col("gk")))
    ranges = F.lit(max(1, -(-rows.count() // (ways * slot_rows))))
    placed = materialise(placed.withColumn("_b", hash_bucket(F.col("_h"), ranges.cast("long"))), "shard-placed")
    before = W.partitionBy("shard").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "_b").agg(F.count("*").alias("_rows"))
               .select("shard", "_b", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off")))
    place = F.row_number().over(W.partitionBy("shard", "_b").orderBy("_h", "_k", "gk", "size")) - 1
    return (placed.withColumn("_in", place).join(offsets, ["shard", "_b"])
            .select(F.col("_k").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("_off") + F.col("_in")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
