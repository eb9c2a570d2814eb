"""Operator 11: cross-tokenizer alignment with inverted bitmaps per pair of token ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molsift.llm.common import bounded_batches
from molsift.session import materialise

#: Documents per chunk of the bitmaps; a place in a chunk takes 16 bits.
CHUNK = 1 << 13
# Fixed value: the public pattern that cuts texts into words before byte-level merges.
BYTE_LEVEL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: byte-level merges; ids of a text and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if piece not in special}
        # Ids of such a vocabulary are in the order of the merges.
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.path = path

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the fast library gives up on some texts of extreme length
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            import tokenizers
            slow = tokenizers.Tokenizer.from_file(self.path)
            slow.encode_special_tokens = True
            return slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: pieces with byte fallback, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def digit_table(n: int) -> np.ndarray:
    """Row i: the decimal digits of i, after zero bytes, and a place for the sign that follows."""
    width = len(str(max(n - 1, 0)))
    table = np.zeros((n, width + 1), np.uint8)
    for i in range(n):
        s = str(i).encode()
        table[i, width - len(s):width] = np.frombuffer(s, np.uint8)
    return table


class Aligner:
    """Both tokenizers and what the alignment of one text needs."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = max(self.a.bytes) + 1, max(self.b.bytes) + 1
        self.len_a, self.len_b = (np.array([len(t.bytes.get(i, b"")) for i in range(n)], np.int64) for t, n in ((self.a, self.size_a), (self.b, self.size_b)))
        self.digits = digit_table(max(self.size_a, self.size_b))

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers; None where a text is empty or either doesn't give its bytes back."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.ids(" " + text), self.b.ids(text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The linked ids of A and of B, a link for each byte offset where tokens of both end, and the groups as text."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        group = np.concatenate([np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        place = (2 * group + side)[order]
        signs = np.full(len(order), ord(","), np.uint8)
        ends = np.flatnonzero(place[1:] != place[:-1])
        signs[ends] = np.where(place[ends] % 2 == 0, ord("|"), ord(";"))
        signs[-1] = 0
        digits = self.digits[np.concatenate([a, b])[order]]
        digits[:, -1] = signs
        return a[at_a], b[at_b], digits[digits != 0].tobytes()


# --- compressed bitmaps: 16-bit places in a chunk, as a list or as bits, whichever is shorter


def pack(places: np.ndarray) -> bytes:
    """Distinct ascending places -> a list of places, or bits behind a mark (which no ascending list can begin with)."""
    if 2 * len(places) <= CHUNK // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[places] = 1
    return b"\xff\xff" + np.packbits(bits, bitorder="little").tobytes()


def unpack(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bitmaps and the number of the bitmap that each is in."""
    dense = np.array([len(x) == 2 + CHUNK // 8 and x[:2] == b"\xff\xff" for x in bitmaps], bool)
    lists = [b"" if d else x for x, d in zip(bitmaps, dense)]
    places, owner = [np.frombuffer(b"".join(lists), "<u2").astype(np.int64)], [np.repeat(np.arange(len(lists)), [len(x) // 2 for x in lists])]
    for i in np.flatnonzero(dense):
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bitmaps[i], np.uint8, offset=2), bitorder="little"))
        places.append(on)
        owner.append(np.full(len(on), i))
    return np.concatenate(places), np.concatenate(owner)


def planes(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Multiplicity planes of postings (pair, document, times): bit j of the times is in plane j.

    One row per pair, chunk of documents and plane; doc = chunk * CHUNK + place.
    """
    cols: list[list] = [[], [], [], []]
    j = 0
    while len(pair):
        on = (times >> j) & 1 == 1
        p, d = pair[on], doc[on]
        order = np.lexsort((d, p))
        p, d = p[order], d[order]
        if len(p):
            starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] // CHUNK != d[:-1] // CHUNK)]))
            low = (d % CHUNK).astype(np.int64)
            cols[0].append(p[starts])
            cols[1].append(d[starts] // CHUNK)
            cols[2].append(np.full(len(starts), j))
            cols[3] += [pack(low[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(p)])]
        left = times >> (j + 1) > 0
        pair, doc, times, j = pair[left], doc[left], times[left], j + 1
    ints = [np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64) for c in cols[:3]]
    return pa.RecordBatch.from_arrays([pa.array(ints[0]), pa.array(ints[1]), pa.array(ints[2].astype(np.int32)), pa.array(cols[3], pa.binary())],
                                      names=["pair", "chunk", "plane", "bits"])


def _merge_bitmaps(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows (pair, chunk, plane, bits) sorted by these -> one row each, bits OR-merged, and (popcount) n."""
    def merged(parts):
        pair, chunk, plane = (np.concatenate([p[i] for p in parts]) for i in range(3))
        bits = [x for p in parts for x in p[3]]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (chunk[1:] != chunk[:-1]) | (plane[1:] != plane[:-1])])
        starts = np.flatnonzero(new)
        places, owner = unpack(bits)
        group = (np.cumsum(new) - 1)[owner]
        both = np.unique(group * CHUNK + places)  # OR
        counts = np.bincount(both // CHUNK, minlength=len(starts))
        ends = np.cumsum(counts)
        out = [pack(both[e - c:e] % CHUNK) for e, c in zip(ends.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(pair[starts]), pa.array(chunk[starts]), pa.array(plane[starts].astype(np.int32)),
                                           pa.array(out, pa.binary()), pa.array(counts.astype(np.int64))], names=["pair", "chunk", "plane", "bits", "n"])

    held: list = []
    for b in batches:
        for at in range(0, len(b), rows):
            s = b.slice(at, rows)
            now = [*(s.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)), s.column(3).to_pylist()]
            if held and tuple(x[0] for x in now[:3]) != tuple(x[-1] for x in held[-1][:3]):
                yield merged(held)
                held = []
            # All but the last key are complete.
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield merged([*held, [x[:cut] for x in now]])
                held = []
            held.append([x[cut:] for x in now])
    if held:
        yield merged(held)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, plane, bits, count, best) sorted by chunk -> per document (doc, n_best, count_sum)."""
    at, n_best, count_sum = None, None, None

    def rows():
        some = np.flatnonzero(count_sum)
        return pa.RecordBatch.from_arrays([pa.array(at * CHUNK + some), pa.array(n_best[some]), pa.array(count_sum[some])], names=["doc", "n_best", "count_sum"])

    for b in batches:
        chunk, plane, count, best = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
        bits = b.column(2).to_pylist()
        starts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(b)]
        for s, e in zip(starts, starts[1:]):
            if s == e:
                continue
            if chunk[s] != at:
                if at is not None:
                    yield rows()
                at, n_best, count_sum = int(chunk[s]), np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
            places, owner = unpack(bits[s:e])
            times = np.left_shift(1, plane[s:e].astype(np.int64))
            np.add.at(n_best, places, (times * best[s:e])[owner])
            np.add.at(count_sum, places, (times * count[s:e].astype(np.int64))[owner])
    if at is not None:
        yield rows()


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hold: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows of the documents (doc, k, n_a, n_b, n_groups, groups), and their postings as planes (pair, chunk, plane, bits).

    Every text is read once. ``doc`` numbers the rows: the task's number, then
    the place in it; the table is written before anything else reads it.
    A pair is (id of A) * 2^20 + id of B. Postings are held until there are
    ``hold`` of them and then go on as bitmaps.
    """
    bounded_batches(docs, 1000)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        both = Aligner(path_a, path_b)
        first, seen, held, n_held = TaskContext.get().partitionId() << 33, 0, [], 0

        def flushed():
            found = planes(*(np.concatenate(c) for c in zip(*held)))
            m = len(found)
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, kinds), *([pa.nulls(m, pa.int64())] * 3), pa.nulls(m, pa.binary()), *found.columns],
                                              names=["doc", "k", "n_a", "n_b", "n_groups", "groups", *found.schema.names])

        for b in batches:
            kinds, out = b.schema.field(0).type, []
            for t in b.column(1).to_pylist():
                got = both.tokens(t)
                if got is None:
                    out.append((0, 0, 0, None))
                else:
                    la, lb, groups = both.align(*got)
                    out.append((len(got[0]), len(got[1]), len(la), hashlib.sha256(groups).digest()))
                    pair, times = np.unique((la << 20) | lb, return_counts=True)
                    held.append((pair, np.full(len(pair), first + seen), times))
                    n_held += len(pair)
                seen += 1
                if n_held >= hold:
                    yield flushed()
                    held, n_held = [], 0
            n, cols = len(out), list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first + seen - n, first + seen)), b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc", "k", "n_a", "n_b", "n_groups", "groups", "pair", "chunk", "plane", "bits"])
        if held:
            yield flushed()

    schema = f"doc long, k {kind}, n_a long, n_b long, n_groups long, groups binary, pair long, chunk long, plane int, bits binary"
    read = materialise(docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema), "align-scan")
    return read.filter("doc is not null").select("doc", "k", "n_a", "n_b", "n_groups", "groups"), read.filter("doc is null").select("pair", "chunk", "plane", "bits")


def pair_index(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index (pair, chunk, plane, bits, n) and its counts: pair, a, b, n_docs, n_links, best.

    Bitmaps of a pair, chunk and plane are OR-merged, and popcounted: a plane's
    count times its weight, summed, is the number of links; the number of
    documents is the count of the OR over the planes. A pair of very many
    documents is a row per chunk, never one group. ``best`` marks the pairs
    whose links are the most of their id of B.
    """
    index = materialise(postings.repartition("pair", "chunk").sortWithinPartitions("pair", "chunk", "plane")
                        .mapInArrow(_merge_bitmaps, "pair long, chunk long, plane int, bits binary, n long"), "align-index")
    links = F.sum(F.expr("shiftleft(1L, plane) * n"))
    counts = index.groupBy("pair").agg(links.alias("n_links"))
    counts = materialise(counts.withColumns({"a": F.shiftright("pair", 20), "b": F.col("pair").bitwiseAND(F.lit((1 << 20) - 1))}), "align-counts")
    top = counts.groupBy("b").agg(F.max("n_links").alias("top"))  # at most one row per id of B
    return index, counts.join(F.broadcast(top), "b").select("pair", "a", "b", "n_links", (F.col("n_links") == F.col("top")).cast("long").alias("best"))


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, chunk, bits) sorted by pair and chunk -> (pair, n_docs) of each chunk: the planes' OR, popcounted."""
    def planes_as_one():
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.zeros(len(b), np.int64)), b.column(2)], names=["pair", "chunk", "plane", "bits"])

    for b in _merge_bitmaps(planes_as_one()):
        yield b.select(["pair", "n"])


def pair_documents(index: DataFrame) -> DataFrame:
    """In how many documents each pair is linked: pair, n_docs."""
    per_chunk = (index.select("pair", "chunk", "bits").repartition("pair", "chunk").sortWithinPartitions("pair", "chunk")
                 .mapInArrow(_documents_of, "pair long, n long"))
    return per_chunk.groupBy("pair").agg(F.sum("n").alias("n_docs"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", hold: int = 2_000_000) -> DataFrame:
    """How the tokens of two tokenizers meet in every document, and how common its links are.

    Returns one row per input row: ``key``, n_a, n_b, n_groups, n_links,
    n_best, count_sum and groups_sha256. Tokens of A (``path_a``, a byte-level
    vocabulary in JSON; over a space and the text) and of B (``path_b``, a model
    of pieces, which adds the space) that end at the same byte offset are
    linked; a text's groups lie between these offsets. A pair of ids counts all
    links of all documents; n_best is the number of links whose pair has the
    highest count of its id of B, count_sum the sum of the counts over the links.

    The links go into an inverted index: for every pair compressed bitmaps of
    the documents, one for each bit of the multiplicity, OR-merged across tasks
    and popcounted. Scores return along the postings: each bitmap takes its
    pair's count to the documents of its chunk, where they add up.

    A null or empty text, or one that either tokenizer doesn't give back byte by
    byte, has no tokens: zeros and ''. Strings of special tokens are plain text.
    Repeated rows and null keys are documents like any other; an empty table
    gives no rows. Texts are tokenized whole. Other columns are not read.
    """
    rows, postings = aligned_rows(docs, path_a, path_b, key, text, hold)
    index, counts = pair_index(postings)
    scored = index.select("pair", "chunk", "plane", "bits").join(counts.select("pair", "n_links", "best"), "pair")
    back = (scored.select("chunk", "plane", "bits", "n_links", "best").repartition("chunk").sortWithinPartitions("chunk")
            .mapInArrow(_scores, "doc long, n_best long, count_sum long"))
    back = materialise(back, "align-scores")
    zero = F.lit(0).cast("long")
    return rows.join(back, "doc", "left").select(
        F.col("k").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), F.coalesce(F.lower(F.hex("groups")), F.lit("")).alias("groups_sha256"))
