"""Operator 9: exact n-gram Jaccard join by pivots, Voronoi regions and distance windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molsift.llm.common import bounded_batches, unused_names
from molsift.llm.graph import components
from molsift.session import broadcast_below, hint_if_small, materialise

MIX = np.uint64(0x9E3779B97F4A7C15)
SMALL = 64 << 20  # bytes of nodes that may be broadcast, so that sets need no shuffle


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    On bytes, lower() changes A-Z alone and split() cuts at the six ASCII
    white-space characters alone.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    acc = h[:len(h) - width + 1] + np.uint64(width)
    for j in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * MIX + h[j:len(h) - width + 1 + j]
    acc = (acc ^ (acc >> np.uint64(32))) * MIX
    return np.unique(acc ^ (acc >> np.uint64(31)))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of n shares, at the least, with a set that it links to."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int, spare: int = 0) -> int:
    """How many first shingles, in one order for all sets, show a link.

    Two linked sets share at least one of their first n - least_shared + 1.
    With ``spare`` hundredths of the set more they share the smaller of the two
    sets' spare counts.
    """
    return min(n, n - least_shared(n, percent) + max(1, -(-spare * n // 100)))


def need_shared(n: int, percent: int, spare: int) -> int:
    """How many shingles of its prefix a set shares with others if it links at all.

    A partner has at least percent / 100 of its size, and so of its spare.
    """
    return max(1, -(-spare * percent * n // 10_000))


class Region:
    """Shingle sets that can be compared with one pivot at a time."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.n = sets, percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.starts = np.append(self.starts, len(tokens))
        self.owner = owner[order]

    def overlap(self, p: int) -> np.ndarray:
        """Shingles that each set shares with set p."""
        at = np.searchsorted(self.tokens, self.sets[p])
        first, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(self.owner[np.repeat(first, count) + place], minlength=self.n)

    def link_all(self) -> np.ndarray:
        """Component number of every set, exact.

        Sets become pivots in turn. A pivot's distances to all sets link those
        within reach and give each set its nearest pivot so far (its Voronoi
        region). A set can only link to sets whose distance from that pivot
        lies in a window of the reach around its own, in whatever region; if
        all of those are in its component already, it never becomes a pivot.
        """
        reach = 1 - self.percent / 100 + 1e-6  # windows are widened by rounding, links use integers
        comp = np.arange(self.n)
        nearest = np.full(self.n, 2.0, np.float32)
        region = np.full(self.n, -1)
        rows: dict[int, np.ndarray] = {}
        limit = max(4, min(256, (1 << 22) // self.n))
        for x in np.argsort(-self.sizes, kind="stable"):
            if region[x] >= 0:
                row = rows[region[x]]
                near = np.abs(row - row[x]) <= reach
                if (comp[near] == comp[x]).all():
                    continue
            shared = self.overlap(x)
            union = self.sizes + self.sizes[x] - shared
            linked = 100 * shared >= self.percent * union
            for c in np.unique(comp[linked]):
                comp[comp == c] = comp[x]
            if (comp == comp[x]).all():
                break
            row = (1 - shared / union).astype(np.float32)
            closer = (row < nearest) & (row < 1)
            nearest[closer], region[closer] = row[closer], x
            rows[int(x)] = row
            if len(rows) > limit:  # pivots without a region are forgotten
                used = set(region.tolist())
                rows = {p: r for p, r in rows.items() if p in used}
                while len(rows) > limit:
                    gone = min(rows, key=lambda p: int((region == p).sum()))
                    del rows[gone]
                    lost = region == gone
                    nearest[lost], region[lost] = 2.0, -1
        return comp


def _grouped(tok: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, node) pairs once each, sorted; starts and lengths of the tokens' groups."""
    order = np.lexsort((node, tok))
    tok, node = tok[order], node[order]
    new = np.ones(len(tok), bool)
    new[1:] = tok[1:] != tok[:-1]
    once = new.copy()
    once[1:] |= node[1:] != node[:-1]
    tok, node, new = tok[once], node[once], new[once]
    starts = np.flatnonzero(new)
    return tok, node, starts, np.diff(np.append(starts, len(tok)))


def combine_shared(tok: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-aggregate postings of one batch: (token, node, known), (node, count).

    Of each token one row goes on, so a token of very many sets is a row per
    batch in the shuffle; ``known`` if the batch itself shows that it is
    shared, which is counted here for all its nodes.
    """
    tok, node, starts, lengths = _grouped(tok, node)
    many = lengths > 1
    nodes, counts = np.unique(node[np.repeat(many, lengths)], return_counts=True)
    order = np.argsort(node[starts], kind="stable")  # rows of a node together compress well
    return tok[starts][order], node[starts][order], many[order], nodes, counts


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of (token with known as its last bit, node) sorted by token -> (node, count) of shared tokens not known before."""
    held = None  # the last row, if its token has had one row so far; else its token alone
    for b in batches:
        tok, node = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(tok):
            continue
        tok, known = tok >> 1, (tok & 1).astype(bool)
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        lengths = np.diff(np.append(starts, len(tok)))
        shared = np.repeat(lengths > 1, lengths)
        extra = np.empty(0, np.int64)
        if held is not None and held[0] == tok[0]:
            shared[:lengths[0]] = True
            if held[1] is not None and not held[2]:
                extra = np.array([held[1]], np.int64)
        alone = lengths[-1] == 1 and not shared[-1]
        held = (tok[-1], node[-1] if alone else None, bool(known[-1]))
        nodes, counts = np.unique(np.concatenate([node[shared & ~known], extra]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["node", "c"])


def _shared_counts(rows: DataFrame) -> DataFrame:
    """node, shared from pre-aggregated rows (token, node, c); rows with a null token are counts."""
    met = (rows.filter("token is not null").select("token", "node").repartition(F.shiftright("token", 1)).sortWithinPartitions("token")
           .mapInArrow(_count_shared, "node long, c long"))
    return met.union(rows.filter("token is null and c is not null").select("node", "c")).groupBy("node").agg(F.sum("c").alias("shared"))


SHORT = np.uint64(24)  # bits of a shingle's hash that postings leave out


def _posting_batch(sets: list[np.ndarray], node: np.ndarray) -> pa.RecordBatch:
    """Pre-aggregated rows of a batch of sets in their order, as _shared_counts takes them.

    Postings are most of what this operator shuffles, so of a shingle they hold
    the upper 40 bits, with ``known`` as the last one. Shingles that then look
    equal only make a set seem to share more: those of other sets do by
    themselves, and those of one set, neighbours in it, are counted on top.
    """
    tok = np.concatenate([np.empty(0, np.int64), *sets])
    tok = (tok.view(np.uint64) >> SHORT).view(np.int64)
    node = np.repeat(node, [len(x) for x in sets])
    same = np.flatnonzero((tok[1:] == tok[:-1]) & (node[1:] == node[:-1]))
    t, n, known, nodes, counts = combine_shared(tok, node)
    more, again = np.unique(node[same], return_counts=True)
    nodes, counts = np.concatenate([nodes, more]), np.concatenate([counts, again])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([2 * t + known, np.zeros(len(nodes), np.int64)]), mask=np.arange(len(t) + len(nodes)) >= len(t)),
         pa.array(np.concatenate([n, nodes])), pa.array(np.concatenate([np.zeros(len(t), np.int64), counts]))], names=["token", "node", "c"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 3000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, to bound what a worker holds."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of an array<long> column."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[at[i]:at[i + 1]] for i in range(len(column))]


def thin_out(members: DataFrame, percent: int, rounds: int = 3) -> DataFrame:
    """Drop from members (node, set) those that share too little with all others together.

    A set that links shares ``percent`` of its shingles with one other, so at
    least as many with the others at large. Dropping sets makes others fall
    short, so this repeats, as long as it drops many.
    """
    def postings(batches):
        for b in _slices(batches):
            yield _posting_batch(_arrays(b.column(1)), b.column(0).to_numpy())

    for _ in range(rounds):
        before = members.count()
        counts = _shared_counts(members.select("node", "set").mapInArrow(postings, "token long, node long, c long"))
        enough = counts.join(members.select("node", F.size("set").alias("n")), "node").filter(100 * F.col("shared") >= percent * F.col("n"))
        enough = materialise(enough.select("node"), "join-enough")
        few = enough.count() > 0.9 * before
        members = members.join(broadcast_below(enough, SMALL), "node", "left_semi")
        if few:
            break
        members = materialise(members, "join-thin")
    return members


def once_each(members: DataFrame) -> DataFrame:
    """One row of each node of members (node, set, place), which must have been written; only nodes are shuffled."""
    first = members.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("node", "first")
    first = materialise(first, "join-repeated")
    if first.isEmpty():
        return members.drop("place")
    return members.join(broadcast_below(first, SMALL), "node", "left").filter("first is null or place = first").select("node", "set")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, prefix) -> (token, first node of the batch), and (null, node, first) links inside the batch."""
    for b in batches:
        sets = _arrays(b.column(1))
        node = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
        tok, node, starts, lengths = _grouped(np.concatenate(sets) if sets else node, node)
        first = np.repeat(node[starts], lengths)
        pairs = np.unique(np.stack([node, first], 1)[node != first], axis=0) if len(node) else np.empty((0, 2), np.int64)
        cut = len(starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([tok[starts], np.zeros(len(pairs), np.int64)]), mask=np.arange(cut + len(pairs)) >= cut),
             pa.array(np.concatenate([node[starts], pairs[:, 0]])), pa.array(np.concatenate([node[starts], pairs[:, 1]]))], names=["token", "a", "b"])


def first_regions(members: DataFrame, percent: int) -> DataFrame:
    """Regions of members (node, set) such that linked sets are in one: node, root.

    Shingles are put in the order of how many members have them, rarest first;
    members that share one of their first shingles in that order are joined.
    What many documents have in common comes last, so it joins only those that
    have little else.
    """
    pairs = members.select("node", F.explode("set").alias("token"))
    df = pairs.groupBy("token").agg(F.count("*").alias("df"))
    ranked = pairs.join(df, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    least = F.ceil(F.size("s") * percent / 100)
    firsts = ranked.select("node", F.slice("s", F.lit(1), (F.size("s") - least + 1).cast("int")).alias("p"))
    firsts = firsts.select("node", F.expr("transform(filter(p, x -> x.df > 1), x -> x.token)").alias("p")).filter(F.size("p") > 0)
    local = materialise(firsts.mapInArrow(_local_stars, "token long, a long, b long"), "join-stars")
    tokens = local.filter("token is not null").select("token", "a")
    low = tokens.groupBy("token").agg(F.min("a").alias("b"), F.max("a").alias("top")).filter("b < top").select("token", "b")
    links = tokens.join(low, "token").select("a", "b").union(local.filter("token is null").select("a", "b"))
    return components(links)


def _pick_pivots(members: DataFrame, pivots: int, salts: int, level: int) -> DataFrame:
    """The ``pivots`` nodes of each region with the smallest hashes, others at every level: region, node.

    Taken per part of a region first, so a large region is not ranked in one task.
    """
    ranked = members.select("region", "node", F.xxhash64("node", F.lit(level)).alias("h")).withColumn("s", F.pmod("h", F.lit(salts)))
    for by in (["region", "s"], ["region"]):
        ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= pivots)
    return ranked.select("region", "node")


def _distances(percent: int):
    """Stream of (part, region, node, set, is_pivot), pivots first -> each set with its distances to the pivots."""
    def run(batches):
        at, known = None, []
        for b in batches:
            part, region, node, is_pivot = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
            out = []
            for p, r, v, mine, pivot in zip(part, region, node, _arrays(b.column(3)), is_pivot):
                if (p, r) != at:
                    at, known = (p, r), []
                if pivot:
                    known.append((v, mine))
                    continue
                shared = [len(np.intersect1d(mine, q, assume_unique=True)) for _, q in known]
                union = [len(mine) + len(q) - n for n, (_, q) in zip(shared, known)]
                out.append((r, v, mine, [w for w, _ in known], [1 - n / u for n, u in zip(shared, union)],
                            [100 * n >= percent * u for n, u in zip(shared, union)]))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                                                       pa.list_(pa.float64()), pa.list_(pa.bool_())))],
                names=["region", "node", "set", "pivots", "d", "linked"])
    return run


def split_regions(members: DataFrame, percent: int, pivots: int, salts: int, level: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of the recursion: (links, members of smaller regions, members that pivots cannot part).

    Every member meets the pivots of its region and is linked to those within
    reach. A member x near pivot p cannot link to a set that is not within
    reach of p if none of these is within d(x, p) + reach of p; x is finished
    then. The others go to the Voronoi cell of each pivot not farther than the
    nearest by twice the reach, so two linked sets meet in the cell of the
    nearest pivot of either. Where a cell would hold most of its region, the
    region's unfinished members are returned apart.
    """
    reach = 1 - percent / 100 + 1e-9
    chosen = _pick_pivots(members, pivots, salts, level)
    parts = members.select(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(salts)).cast("int").alias("part"), "region", "node", "set", F.lit(False).alias("is_pivot"))
    heads = (members.join(chosen, ["region", "node"], "left_semi")
             .select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"), "region", "node", "set", F.lit(True).alias("is_pivot")))
    met = (parts.unionByName(heads).repartition("region", "part").sortWithinPartitions("part", "region", F.desc("is_pivot"), "node")
           .mapInArrow(_distances(percent), "region string, node long, set array<long>, pivots array<long>, d array<double>, linked array<boolean>"))
    met = materialise(met, "join-distances")
    links = met.select("node", F.explode(F.arrays_zip("pivots", "linked")).alias("x")).filter("x.linked and node <> x.pivots").select(
        F.col("node").alias("a"), F.col("x.pivots").alias("b"))
    gaps = met.groupBy("region").agg(F.array(*[F.min(F.expr(f"if(not get(linked, {j}), get(d, {j}), null)")) for j in range(pivots)]).alias("gap"))
    left = met.join(hint_if_small(gaps), "region").filter(~F.expr(
        f"exists(sequence(0, size(d) - 1), j -> linked[j] and (gap[j] is null or d[j] + {reach} < gap[j]))")).drop("gap")
    left = materialise(left, "join-left")
    cells = left.select("*", F.explode(F.expr(f"filter(sequence(0, size(d) - 1), j -> d[j] <= array_min(d) + {2 * reach})")).alias("cell"))
    size = left.groupBy("region").count()
    stuck = (cells.groupBy("region", "cell").agg(F.count("*").alias("c")).groupBy("region").agg(F.max("c").alias("c"))
             .join(size, "region").filter("c > 0.7 * count").select("region"))
    stuck = hint_if_small(materialise(stuck, "join-stuck"))
    smaller = cells.join(stuck, "region", "left_anti").select(F.concat_ws("/", "region", "cell").alias("region"), "node", "set")
    smaller = materialise(smaller, "join-cells")
    return links, smaller, left.join(stuck, "region", "left_semi").select("region", "node", "set")


def _in_task(members: DataFrame, percent: int) -> DataFrame:
    """Exact links in regions that fit a task, as stars of components: a, b."""
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        comp = Region(list(pdf["set"]), percent).link_all()
        root = pdf["node"].groupby(comp).transform("min")
        out = pd.DataFrame({"a": pdf["node"], "b": root})
        return out[out["a"] != out["b"]]

    return members.groupBy("region").applyInPandas(link, "a long, b long")


def link_regions(members: DataFrame, percent: int, max_tokens: int, pivots: int = 8, salts: int = 32, depth: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all links inside the regions of ``members`` (region, node, set).

    Regions of at most ``max_tokens`` shingles are joined in one task each.
    Larger ones are split by pivots, level by level. What pivots cannot part
    keeps its unfinished members and gets other pivots at the next level: near
    copies are linked to a pivot and finished, so few stay. Only what is too
    large after ``depth`` levels is dealt into chunks of half that size, and
    every two chunks are joined in a task of their own.
    """
    links = None
    for level in range(depth + 1):
        sizes = members.groupBy("region").agg(F.sum(F.size("set")).alias("tokens"))
        large = hint_if_small(materialise(sizes.filter(F.col("tokens") > max_tokens), "join-large"))
        found = _in_task(members.join(large, "region", "left_anti"), percent)
        links = found if links is None else links.union(found)
        if large.isEmpty():
            return links
        members = members.join(large, "region", "left_semi")
        if level < depth:
            near, smaller, stuck = split_regions(members, percent, pivots, salts, level)
            links, members = links.union(near), smaller.union(stuck)
            continue
        stuck = members
        chunks = stuck.groupBy("region").agg(F.ceil(F.sum(F.size("set")) / (max_tokens / 2)).alias("chunks"))
        dealt = stuck.join(hint_if_small(chunks), "region").withColumn("c", F.pmod(F.xxhash64("node", F.lit(2)), "chunks"))
        pairs = dealt.select("region", "node", "set", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
        pairs = pairs.select(F.concat_ws("/", "region", F.least("c", "o"), F.greatest("c", "o")).alias("region"), "node", "set")
        links = links.union(_in_task(pairs, percent))
    return links


def _scan(body: DataFrame, kind: str, percent: int, width: int, spare: int, half: int) -> DataFrame:
    """Read every text (k, t, h) once: document rows (dig not null) and pre-aggregated prefix postings."""
    def describe(batches):
        done: set[bytes] = set()
        for b in _slices(batches):
            ids = pa.array(b.column(0))
            n, dig, pre = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                n.append(len(s))
                dig.append(digest(s))
                fresh = len(s) and dig[-1] not in done  # copies that a task has seen give no postings
                pre.append(s[:prefix_length(len(s), percent, spare)].view(np.int64) if fresh else np.empty(0, np.int64))
                if fresh and len(done) < 50_000:
                    done.add(dig[-1])
            node = np.frombuffer(b"".join(x[half:half + 8] for x in dig), np.int64)
            rest = _posting_batch(pre, node)
            m, r = len(rest), len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.concat_arrays([b.column(2), pa.nulls(m, pa.string())]),
                 pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(m, pa.int64())]),
                 pa.concat_arrays([pa.array(dig, pa.binary()), pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.array(node), rest.column(1)]),
                 pa.concat_arrays([pa.nulls(r, pa.int64()), rest.column(0)]), pa.concat_arrays([pa.nulls(r, pa.int64()), rest.column(2)])],
                names=["k", "h", "n", "dig", "node", "token", "c"])

    return materialise(body.mapInArrow(describe, f"k {kind}, h string, n long, dig binary, node long, token long, c long"), "join-scan")


def placed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, spare: int = 5,
                max_tokens: int = 1_500_000, pivots: int = 8, salts: int = 32) -> DataFrame:
    """Rows k, h (MD5 of the text), n and root, the number of the component, null without shingles."""
    bounded_batches(docs)
    kind = dict(docs.dtypes)[key]
    body = docs.select(docs[key].alias("k"), docs[text].alias("t"), F.md5(F.coalesce(docs[text], F.lit(""))).alias("h"))

    def again(batches):
        for b in _slices(batches):
            dig, node = b.column(1).to_pylist(), b.column(2).to_pylist()
            sets = [shingle_set(x, width) for x in b.column(0).to_pylist()]
            fit = [i for i, s in enumerate(sets) if digest(s) == dig[i]]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in fit], pa.int64()), pa.array([sets[i].view(np.int64) for i in fit], pa.list_(pa.int64()))],
                                             names=["node", "set"])

    # Half a digest numbers the classes. Should two classes share that half,
    # the other half is taken.
    for half in (0, 8):
        scanned = _scan(body, kind, percent, width, spare, half)
        rows = scanned.filter("dig is not null").select("k", "h", "n", "dig", "node")
        classes = materialise(rows.filter("n > 0").groupBy("dig").agg(F.min("k").alias("rep"), F.first("n").alias("n"), F.first("node").alias("node")), "join-classes")
        if classes.groupBy("node").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("two classes share either half of their digests")
    counts = _shared_counts(scanned.filter("dig is null").select("token", "node", "c"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * (spare * percent) / 10_000))
    some = classes.join(counts, "node").filter(F.col("shared") >= need).select("rep", "dig", "node")
    some = broadcast_below(materialise(some, "join-some"), SMALL)
    members = body.join(some, body.k.eqNullSafe(some.rep)).select("t", "dig", "node").mapInArrow(again, "node long, set array<long>")
    members = once_each(materialise(members.withColumn("place", F.monotonically_increasing_id()), "join-members"))
    members = thin_out(members, percent)
    regions = broadcast_below(materialise(first_regions(members, percent), "join-first"), SMALL)
    members = members.join(regions, "node").select(F.col("root").cast("string").alias("region"), "node", "set")
    linked = components(link_regions(materialise(members, "join-regions"), percent, max_tokens, pivots, salts))
    linked = hint_if_small(linked)
    return (rows.join(linked, "node", "left")
            .select("k", "h", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root")))


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, spare: int = 5,
               max_tokens: int = 1_500_000, pivots: int = 8, salts: int = 32) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets, exact.

    Returns one row per input row: ``key``, n_shingles and component_id, the
    smallest key reachable by links. Two documents link when
    100 * shared >= ``percent`` * union of their distinct ``width``-word shingles.

    Equal sets are one class from the start. With random pivots nearly all
    documents are at distance 1 from every pivot and no window would part them,
    so sets that cannot link are dropped first, by exact bounds: those that
    share too few shingles of a prefix with others, then of the whole set. What
    stays falls into regions by its rarest shingles. Jaccard distance is a
    metric, so inside a region pivots decide: windows by the triangle
    inequality say which sets can still link, and large regions are split into
    Voronoi cells whose boundary sets are replicated, again and again. Texts
    are read once for all, and again for the sets that passed the prefix.

    A text without words has no shingles and is alone, as is a null text; rows
    with equal sets, repeated rows included, share a component; a null key
    takes part but is never the smallest (a component of null keys alone has a
    null id); an empty table gives no rows. Other columns are not read.
    """
    rows = materialise(placed_rows(docs, key, text, percent, width, spare, max_tokens, pivots, salts), "join-placed")
    best = rows.filter("root is not null").groupBy("root").agg(F.min("k").alias("component_id"), F.count("*").alias("m"))
    best = hint_if_small(best.filter("m > 1").select("root", "component_id"))
    return (rows.join(best, "root", "left")
            .select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``: that of the smallest key (nulls last), then text hash.

    Rows without words are no copies of one another and all stay. Rows that go
    are found by key and text hash; they, and not those that stay, are joined
    to the texts, so that texts are not shuffled while those are few.
    """
    gk, gh = unused_names(docs, "gk", "gh")
    rows = materialise(placed_rows(docs, key, text, **options), "join-placed").filter("root is not null")
    row = F.struct(F.col("k").isNull().alias("last"), F.col("k").alias("k"), F.col("h").alias("h"))
    groups = rows.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("m")).filter("m > 1").select("root", "first")
    marked = materialise(rows.join(hint_if_small(groups), "root").groupBy(F.col("k").alias(gk), F.col("h").alias(gh), "first").agg(F.count("*").alias("m"))
                         .select(gk, gh, "m", ((F.col(gh) == F.col("first.h")) & F.col(gk).eqNullSafe(F.col("first.k"))).alias("stays")), "join-marked")
    same = docs[key].eqNullSafe(F.col(gk)) & (F.md5(F.coalesce(docs[text], F.lit(""))) == F.col(gh))
    out = docs.join(broadcast_below(marked.filter("not stays or m > 1").select(gk, gh)), same, "left_anti")
    many = marked.filter("stays and m > 1").select(gk, gh)
    if many.isEmpty():
        return out
    return out.unionByName(docs.join(broadcast_below(many), same).dropDuplicates([gk, gh]).select(*[docs[c] for c in docs.columns]))
