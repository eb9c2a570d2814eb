"""Operator 8: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.llm.common import bounded_batches, unused_names
from molsift.session import broadcast_below, materialise

MIX = np.uint64(0x9E3779B97F4A7C15)
# Characters stripped from the ends of words before they are compared.
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, lower-cased and without signs at their ends."""
    words = [w for w in (x.strip(EDGES) for x in (text or "").lower().encode().split()) if w]
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ngrams(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the n-gram at each place; a shorter text is one n-gram."""
    width = min(width, len(h))
    if not width:
        return h
    acc = h[:len(h) - width + 1] + np.uint64(width)
    for j in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * MIX + h[j:len(h) - width + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * MIX
    return acc ^ (acc >> np.uint64(31))


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a filter of ``bits`` (a power of two)."""
    mask = np.uint64(bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(31)) & mask).astype(np.int64)


def build_filter(grams: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """Bloom filter of ``grams`` (gram long), 64 bits a key and at most ``most_bits`` in all.

    Its words are made by an aggregate on the executors, so that only the
    filter, of bounded size, reaches the driver. One that is fuller than
    planned lets more n-grams through to the join and loses none.
    """
    bits = min(most_bits, 1 << max(12, (64 * grams.count()).bit_length()))
    second = F.shiftrightunsigned("gram", 31)
    at = grams.select(F.explode(F.array("gram", second)).alias("g")).select(F.col("g").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value")).collect()
    table = np.zeros(bits // 64, np.uint64)
    for word, value in words:
        table[word] = np.array([value], np.int64).view(np.uint64)[0]
    return table, bits


def passes(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter may hold."""
    first, second = _places(keys, bits)
    hit = np.flatnonzero(table[first >> 6] >> (first & 63).astype(np.uint64) & np.uint64(1))
    at = second[hit]
    return hit[(table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman over words: (best score, place in the passage after its end).

    Row by row over the item; within a row the gap along the passage is a
    running maximum, so each row is a few array operations.
    """
    m = len(passage)
    prev = np.zeros(m + 1, np.int64)
    ramp = -gap * np.arange(m + 1)
    best, end = 0, 0
    for w in item:
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(prev[:-1] + np.where(passage == w, match, mismatch), prev[1:] + gap)
        row = np.maximum(row, 0)
        row = np.maximum(row, np.maximum.accumulate(row + ramp) - ramp)
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        prev = row
    return best, end


def passages(at: np.ndarray, gram: np.ndarray, need: int, length: int, width: int) -> list[tuple[int, int]]:
    """Where ``need`` different n-grams lie within twice the item's length of each other: (from, to) places to align.

    ``at`` ascends. A passage reaches an item's length beyond its hits on both
    sides; those that overlap are one.
    """
    out: list[list[int]] = []
    for j, place in enumerate(at.tolist()):
        end = int(np.searchsorted(at, place + 2 * length, side="right"))
        if len(set(gram[j:end].tolist())) >= need:
            begin, stop = max(0, place - length), int(at[end - 1]) + width + length
            if out and begin <= out[-1][1]:
                out[-1][1] = max(stop, out[-1][1])
            else:
                out.append([begin, stop])
    return [tuple(x) for x in out]


def seed_grams(items: DataFrame, rare_items: int, least_grams: int, min_seeds: int) -> DataFrame:
    """The n-grams that stand for each item (i, gram, need): those that at most ``rare_items`` items have.

    An item of which fewer than ``least_grams`` are so rare gets its rarest
    ones. ``need`` is how many of them a passage has to share: ``min_seeds``,
    or all of an item that has fewer.
    """
    grams = materialise(items.select("i", F.explode("grams").alias("gram")).distinct(), "leak-grams")
    families = grams.groupBy("gram").agg(F.count("*").alias("n_items"))
    rank = F.row_number().over(W.partitionBy("i").orderBy("n_items", "gram"))
    kept = grams.join(families, "gram").withColumn("r", rank).filter((F.col("n_items") <= rare_items) | (F.col("r") <= least_grams))
    return materialise(kept.select("i", "gram", F.least(F.lit(min_seeds), F.count("*").over(W.partitionBy("i"))).alias("need")), "leak-seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", width: int = 3, rare_df: int = 32, rare_items: int = 16, least_grams: int = 8, min_seeds: int = 2,
                 min_score: float = 0.5, filter_bits: int = 1 << 26) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited.

    Returns one row per row of ``docs`` and item that align: ``key``, text_hash
    (xxhash64 of the text, which tells rows of one key apart), item (its key), score (Smith-Waterman score over the item's score with itself,
    0 to 1), seeds (shared n-grams that at most ``rare_df`` documents have) and
    end (the passage's end among the document's words). A pair aligns at a score
    of ``min_score`` or more.

    Seeds are the ``width``-word n-grams that few items have (``seed_grams``),
    chosen before the join, so an n-gram of all documents and most items joins
    nothing and a hit joins a bounded number of items. How often documents have
    an n-gram doesn't exclude it: a passage that is copied often keeps its seeds
    in every copy. A Bloom filter of the seeds, of bounded size, travels with
    the scan of the documents; what passes it is joined on the n-gram. Where
    ``min_seeds`` different ones of an item lie close together (``passages``),
    the document is aligned with the item, there alone.

    Null and empty texts on either side, and items of fewer than ``width``
    words, give nothing; equal words score at any place, so ties end first;
    repeated rows and items and null keys are rows like any other; empty tables
    give no rows. Other columns are not read.
    """
    bounded_batches(docs)
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item_key]
    items = benchmark.select(benchmark[item_key].alias("item"), benchmark[item_text].alias("t"))

    def item_rows(batches):
        for b in batches:
            hashes = [word_hashes(t) for t in b.column(1).to_pylist()]
            grams = [ngrams(h, width).view(np.int64) if len(h) >= width else np.empty(0, np.int64) for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array(grams, pa.list_(pa.int64()))],
                                             names=["item", "words", "grams"])

    items = items.mapInArrow(item_rows, f"item {item_kind}, words binary, grams array<long>").filter(F.size("grams") > 0)
    items = materialise(items.withColumn("i", F.monotonically_increasing_id()), "leak-items")
    seeds = seed_grams(items, rare_items, least_grams, min_seeds)
    wanted = materialise(seeds.select("gram").distinct(), "leak-wanted")
    table, bits = build_filter(wanted, filter_bits)
    body = docs.select(docs[key].alias("k"), docs[text].alias("t"), F.xxhash64(docs[text]).alias("h")).filter("length(t) > 0")

    def hits(batches):
        for b in batches:
            who, gram, place = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for j, t in enumerate(b.column(1).to_pylist()):
                h = word_hashes(t)
                if len(h) < width:
                    continue
                g = ngrams(h, width)
                at = passes(table, bits, g)
                if len(at):
                    who.append(np.full(len(at), j))
                    gram.append(g[at].view(np.int64))
                    place.append(at)
            who, gram, place = (np.concatenate(x).astype(np.int64) for x in (who, gram, place))
            who = pa.array(who)
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(2).take(who), pa.array(gram), pa.array(place)], names=["k", "h", "gram", "at"])

    seen = body.mapInArrow(hits, f"k {kind}, h long, gram long, at long")
    seen = materialise(seen.join(broadcast_below(wanted), "gram", "left_semi"), "leak-hits")
    counts = materialise(seen.select("k", "h", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df")), "leak-counts")
    hit = F.struct("at", "gram", (F.col("df") <= rare_df).alias("rare"))
    pairs = (seen.join(broadcast_below(counts), "gram").join(broadcast_below(seeds), "gram").groupBy("k", "h", "i")
             .agg(F.sort_array(F.collect_set(hit)).alias("hits"), F.max("need").alias("need")))
    grams = F.array_distinct("hits.gram")
    pairs = pairs.filter(F.size(grams) >= F.col("need"))
    rare = F.size(F.array_distinct(F.filter("hits", lambda x: x["rare"])["gram"])).cast("long")
    pairs = pairs.join(broadcast_below(items.select("i", "item", "words")), "i").withColumn("seeds", rare)
    tasks = pairs.groupBy(F.col("k").alias("pk"), F.col("h").alias("ph")).agg(F.collect_list(F.struct("item", "words", "seeds", "need", F.col("hits.at").alias("at"), F.col("hits.gram").alias("gram"))).alias("items"))
    tasks = broadcast_below(materialise(tasks, "leak-pairs"), 64 << 20)

    def score(batches):
        for b in batches:
            out = []
            for k, t, found, ph in zip(b.column(0), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                h = word_hashes(t)
                for x in found.as_py():
                    item, top = np.frombuffer(x["words"], np.uint64), (0, 0)
                    for lo, hi in passages(np.array(x["at"]), np.array(x["gram"]), x["need"], len(item), width):
                        best, end = align(item, h[lo:hi])
                        top = max(top, (best, -(lo + end)))
                    if top[0] >= min_score * 2 * len(item) and top[0]:
                        out.append((k.as_py(), ph, x["item"], top[0] / (2 * len(item)), x["seeds"], -top[1]))
            cols = list(zip(*out)) if out else [()] * 6
            types = (b.schema.field(0).type, pa.int64(), b.schema.field(2).type.value_type.field("item").type, pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "text_hash", "item", "score", "seeds", "end"])

    again = body.join(tasks, body.k.eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph"))).select("k", "t", "items", "h")
    return again.mapInArrow(score, f"`{key}` {kind}, text_hash long, item {item_kind}, score double, seeds long, end long")


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns."""
    gk, gh = unused_names(docs, "gk", "gh")
    found = contaminated(docs, benchmark, key, text, **options)
    found = materialise(found.select(F.col(key).alias(gk), F.col("text_hash").alias(gh)).distinct(), "leak-found")
    return docs.join(broadcast_below(found), docs[key].eqNullSafe(F.col(gk)) & (F.xxhash64(docs[text]) == F.col(gh)), "left_anti")
