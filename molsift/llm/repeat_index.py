"""Operator 12: repeated passages by a run-length Burrows-Wheeler index and matching statistics."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molsift.llm.common import bounded_batches
from molsift.llm.decontaminate import build_filter, passes
from molsift.session import broadcast_below, materialise

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of an anchor.
ANCHOR = 16
LAST = (1 << 63) - 1


# --- the index


def suffix_order(text: np.ndarray, end: np.ndarray, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of all suffixes of the strings in ``text``, and ranks by their first letters (how many: at most ``length``).

    Letters are 1 to 256; each string ends in a 0 at ``end``, and the ends are
    ordered as the strings are (``which``). Ranks by the first h letters give
    those by 2 h, until no two are equal.
    """
    n, m = len(text), int(which[-1]) + 1
    at = np.arange(n)
    # As many letters as fit into one key, numbered by those that occur.
    present = np.flatnonzero(np.bincount(text, minlength=257))
    code = np.zeros(257, np.uint64)
    code[present] = np.arange(len(present))
    bits = max(1, int(len(present) - 1).bit_length())
    letters, packed = code[text], min(63 // bits, length)
    key, have = letters, 1
    for more in f"{packed:b}"[1:]:  # doubled, and one letter more where the number asks for it
        for extra in (key, *[letters] * int(more)):
            width = have if extra is key else 1
            key = key << np.uint64(bits * width)
            key[:n - have] |= extra[have:]
            have += width
    beyond = np.maximum(packed - (end - at), 0).astype(np.uint64) * np.uint64(bits)
    key = key >> beyond << beyond  # what follows the string's end is not its own
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    # A rank is the first row of those equal so far; ends are told apart by their strings.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    ends = end[at == end]
    rank[ends], order[:m], new[:m] = which[ends], ends, True
    h, head, width = packed, rank.copy(), packed
    while True:
        # Only rows that have equals are sorted on; they stay within their rows.
        last = np.append(new[1:], True)
        open_rows = np.flatnonzero(~(new & last))
        if not len(open_rows):
            return order, head, width
        some = order[open_rows]
        key = rank[some] << 32 | rank[np.minimum(some + h, end[some])]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[open_rows] = some
        first = np.ones(len(some), bool)
        first[1:] = key[1:] != key[:-1]
        new[open_rows] = first
        rank[some] = np.maximum.accumulate(np.where(first, open_rows, 0))
        h *= 2
        if h <= length:
            head, width = rank.copy(), h


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, with samples at the ends of its runs.

    For every interval of suffixes that share their first ``length`` letters it
    also keeps the first of the strings that they are in.
    """

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) + 1 for s in strings])
        ends = np.cumsum(sizes) - 1
        self.n, self.length = int(ends[-1]) + 1, length
        self.text = np.zeros(self.n, np.uint16)
        inner = np.ones(self.n, bool)
        inner[ends] = False
        self.text[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        self.window = sliding_window_view(np.append(self.text, np.zeros(length, np.uint16)), length)
        end, which = np.repeat(ends, sizes), np.repeat(np.arange(len(strings)), sizes)
        order, head, width = suffix_order(self.text, end, which, length)
        # Runs of equal letters before the suffixes, in their order.
        before = self.text[order - 1]
        self.run = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.letter = before[self.run].astype(np.int64)
        run_end = np.append(self.run[1:], self.n) - 1
        self.first_sample, self.last_sample, self.run_end = order[self.run], order[run_end], run_end
        # Where the row before a run's first row lies: rows by letter, then as they come.
        self.by_letter = np.argsort(self.letter, kind="stable")
        lengths = (run_end - self.run + 1)[self.by_letter]
        self.step = np.empty(len(self.run), np.int64)
        self.step[self.by_letter] = np.cumsum(lengths) - lengths
        self.shift = self.step - self.run
        # A bucket is small, so the run of a row is looked up, not searched.
        self.run_of = np.repeat(np.arange(len(self.run), dtype=np.int32), run_end - self.run + 1)
        self.keys = (self.letter * self.n + self.run)[self.by_letter]
        # Intervals of suffixes with equal first letters.
        whole = end[order] - order >= length
        a, b = order[1:], order[:-1]
        far = length - width
        same = whole[1:] & whole[:-1] & (head[a] == head[b])
        same[same] = head[a[same] + far] == head[b[same] + far]
        interval = np.flatnonzero(np.concatenate([[True], ~same]))
        self.earliest = np.repeat(np.minimum.reduceat(which[order], interval), np.diff(np.append(interval, self.n))).astype(np.int32)

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at p and q share, up to ``length``."""
        unlike = self.window[p] != self.window[q]
        return np.where(unlike.any(1), unlike.argmax(1), self.length)

    def matches(self, patterns: list[bytes], below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (pattern, place) where ``length`` letters match a string numbered less than ``below`` of the pattern.

        The patterns are streamed from the right, all at once, with their
        matching statistics: a row whose suffix begins with the longest match,
        that match's place in the text, and its length. A letter that does not
        precede the row sends it to the end of the nearest run of that letter
        above or below, whichever sample shares more with the match. What
        ``length`` letters match hangs on these letters only, so a long pattern
        is streamed in pieces that overlap by one letter less, and none has
        many steps to itself.
        """
        most, length = 3 * self.length, self.length
        step = most - length + 1
        whole = np.array([len(p) for p in patterns], np.int64)
        cuts = np.maximum(1, -(-(whole - length + 1) // step))
        of = np.repeat(np.arange(len(patterns)), cuts)
        offset = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * step
        sizes = np.minimum(whole[of] - offset, most)
        by_size = np.argsort(-sizes, kind="stable")
        of, offset, sizes = of[by_size], offset[by_size], sizes[by_size]
        data = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        end = (np.cumsum(whole) - whole)[of] + offset + sizes - 1
        below = below[of]
        # Of the place and the length of a match, what they are t steps on is kept less what t steps add to them.
        row, at, got = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.first_sample[0]), np.zeros(len(sizes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        steps = int(sizes.max(initial=0))
        alive = np.searchsorted(-sizes, -np.arange(steps), "left")
        for t, live in enumerate(alive.tolist()):
            letter = data[end[:live] - t]
            r = self.run_of[row[:live]]
            m = np.flatnonzero(self.letter[r] != letter)
            dead = None
            if len(m):
                wanted = letter[m]
                after = np.searchsorted(self.keys, wanted * self.n + row[m])
                down, up = self.by_letter[np.minimum(after, len(self.keys) - 1)], self.by_letter[np.maximum(after - 1, 0)]
                down_ok, up_ok = (self.letter[down] == wanted) & (after < len(self.keys)), (self.letter[up] == wanted) & (after > 0)
                place, long = at[m] - t, got[m] + t
                share = [np.where(ok, np.minimum(self._common(place, s[x]), long), -1) for ok, s, x in
                         ((down_ok, self.first_sample, down), (up_ok, self.last_sample, up))]
                below_row = share[0] >= share[1]
                r[m] = np.where(below_row, down, up)
                row[m] = np.where(below_row, self.run[down], self.run_end[up])
                at[m] = np.where(below_row, self.first_sample[down], self.last_sample[up]) + t
                best = np.maximum(share[0], share[1])
                dead = m[best < 0]  # a letter that no string has
                got[m] = np.maximum(best, 0) - t
            row[:live] += self.shift[r]
            if dead is not None and len(dead):
                row[dead], at[dead], got[dead] = 0, self.first_sample[0] + t + 1, -t - 1
            if t + 1 >= length:
                full = np.flatnonzero(got[:live] + t + 1 >= length)
                full = full[self.earliest[row[full]] < below[full]]
                found.append((of[full], offset[full] + sizes[full] - 1 - t))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


# --- anchors: where windows are looked for


def _hash_at(data: bytes, at: np.ndarray | None, width: int) -> np.ndarray:
    """Hash (48 upper bits, the rest 0) of the ``width`` bytes at the given places, or at all."""
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))
    count = len(data) - width + 1
    if at is None:
        words = words.copy()  # in memory as words, so that they are fast to work on
    h = np.zeros(count if at is None else len(at), np.uint64)
    rest = np.empty_like(h)

    def fold(bits: int) -> None:
        np.right_shift(h, np.uint64(bits), out=rest)
        np.bitwise_xor(h, rest, out=h)

    for shift in sorted({*range(0, width - 7, 8), width - 8}):
        np.bitwise_xor(h, words[shift:shift + count] if at is None else words[at + shift], out=h)
        np.multiply(h, MIX, out=h)
        fold(29)
    np.multiply(h, MIX, out=h)
    fold(32)
    return np.bitwise_and(h, ~np.uint64(0xFFFF), out=h)


def anchor_hashes(data: bytes) -> np.ndarray:
    return _hash_at(data, None, ANCHOR)


def may_match(strings: list[bytes], length: int, grid: int = 8) -> np.ndarray:
    """Which of the strings may have ``length`` bytes in common with another one; the strings are those of ``anchors``.

    Two that do have their anchor in common and so many bytes on both sides of
    it. With the count on the left cut down to a multiple of ``grid``, they have
    all but ``grid`` - 1 of those bytes at that place, whose hash is looked for
    in the others at each such count.
    """
    data = b"".join(strings)
    sizes = np.array([len(s) for s in strings])
    start = np.cumsum(sizes) - sizes
    h = np.append(anchor_hashes(data), np.zeros(ANCHOR - 1, np.uint64))
    h[(start + sizes)[:, None] - np.arange(1, ANCHOR)] = ~np.uint64(0)
    hits = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, start), sizes))
    first = np.searchsorted(hits, start)
    place, keep = hits[first], np.diff(np.append(first, len(hits))) > 1
    rest = length - ANCHOR
    for left in range(0, rest + 1, grid):
        begin, width = place - left, max(ANCHOR, ANCHOR + left + max(0, rest - left - grid + 1))
        some = np.flatnonzero((begin >= start) & (begin + width <= start + sizes))
        h = _hash_at(data, begin[some], width)
        order = np.argsort(h)
        equal = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        keep[some[order[equal]]] = keep[some[order[equal + 1]]] = True
    return keep


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes of a text with one anchor: its hash (48 upper bits), the text, the first window, the end.

    A window's anchor is the least hash of the ANCHOR bytes at its places, so
    equal windows have equal anchors wherever they are. Texts, of ``length``
    bytes at least, are worked on end to end; windows over two are left out.
    """
    h = anchor_hashes(b"".join(texts))
    width, s = length - ANCHOR + 1, 1
    while 2 * s <= width:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    if s < width:
        h = np.minimum(h[:len(h) - (width - s)], h[width - s:])
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    stop = begin + size - length + 1
    new = np.empty(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[begin] = new[stop[:-1]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(h))
    text = np.searchsorted(begin, start, "right") - 1
    own = np.flatnonzero(start < stop[text])
    text, start, end = text[own], start[own], end[own]
    return h[start], text, start - begin[text], end - begin[text]


def grouped(batches: Iterator[pa.RecordBatch], most_bytes: int = 32 << 10, most: int = 1000) -> Iterator[list[tuple]]:
    """The rows of batches, whose third column is a text, in groups that together fit a processor's cache; no (o, h) comes twice in a group."""
    some, size = {}, 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:2] in some:
                continue
            some[row[:2]] = row
            size += len(row[2])
            if size >= most_bytes or len(some) == most:
                yield list(some.values())
                some, size = {}, 0
    if some:
        yield list(some.values())


def bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each value; anchors are minima, so their bits are mixed once more."""
    mixed = (values ^ (values >> np.uint64(31))) * MIX
    return ((mixed >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def six_bytes(values: np.ndarray) -> np.ndarray:
    """The 48 bits of each anchor."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).ravel()


def eight_bytes(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, 2:] = packed.reshape(-1, 6)
    return out.view("<u8").ravel()


def held_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


# --- rows between the steps: (src, kind, bucket, body), kind 0 what a source keeps, 1 what it asks or is told

ROWS = "src long, kind int, bucket int, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return zstandard.compress(b"".join([len(head).to_bytes(4, "little"), head, *(a.tobytes() for a in arrays)]), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    body = zstandard.decompress(body)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for kind, n in json.loads(body[4:at]):
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                      names=["src", "kind", "bucket", "body"])


def _batches(rows: Iterable[tuple], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most_bytes``, as a batch costs more than a short row."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[3])
        if size >= most_bytes or len(some) == 10_000:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def _per_bucket(work):
    """Rows sorted by bucket: what a source keeps passes; each bucket's questions go to ``work`` at once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, held = None, []
        for b in batches:
            for src, kind, bucket, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    yield src, 0, 0, body
                    continue
                if bucket != at and held:
                    yield from work(held)
                    held = []
                at = bucket
                held.append((src, body))
        if held:
            yield from work(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches))
    return run


def _per_source(work, schema: list[tuple[str, pa.DataType]]):
    """Rows sorted by src and kind: what the source kept and what it is told go to ``work``, which gives columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(work(held[0], held[1:]), schema)], names=[n for n, _ in schema])

        for b in batches:
            for src, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if src != at and held:
                    yield done()
                    held = []
                at = src
                held.append(body)
        if held:
            yield done()
    return run


def _exchange(rows: DataFrame, buckets: int, work, label: str) -> DataFrame:
    return materialise(rows.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(_per_bucket(work), ROWS), label)


# --- first pass: anchors that two documents have


def _scan_anchors(length: int, buckets: int, hold: int):
    """(o, h, t) -> per source: its documents; per bucket the anchors (value, document)."""
    def run(batches):
        src, docs, values, n = TaskContext.get().partitionId() << 33, {}, [], 0

        def flush():
            # The 16 lower bits of an anchor are free for its document's number.
            both = np.sort(np.concatenate(values))
            both = both[np.append(True, both[1:] != both[:-1])]
            value, doc = both & ~np.uint64(0xFFFF), (both & np.uint64(0xFFFF)).astype("<u2")
            bucket = bucket_of(value, buckets)
            if buckets > 1:
                order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
                value, doc, bucket = value[order], doc[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            yield _batch([(src, 0, src % buckets, pack(np.array([o for o, _ in docs], "<i8"), np.frombuffer(b"".join(h for _, h in docs), np.uint8)))])
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                at = slice(cuts[k], cuts[k + 1])
                yield _batch([(src, 1, k, pack(six_bytes(value[at]), doc[at]))])

        for some in grouped(batches):
            some = [x for x in some if x[:2] not in docs]
            if not some:
                continue
            value, text, _, _ = anchors([t for _, _, t in some], length)
            values.append(value | (len(docs) + text).astype(np.uint64))
            docs |= dict.fromkeys(x[:2] for x in some)
            n += len(value)
            if n >= hold or len(docs) > (1 << 16) - 1000:
                yield from flush()
                src, docs, values, n = src + 1, {}, [], 0
        if docs:
            yield from flush()
    return run


def _shared_anchors(often: int):
    """What sources of a bucket have -> to each, those of its anchors that another document has, and those that more than ``often`` have."""
    def work(held):
        got = [(eight_bytes(v), d) for v, d in (unpack(body) for _, body in held)]
        values, inverse, counts = np.unique(np.concatenate([v for v, _ in got]), return_inverse=True, return_counts=True)
        at = 0
        for (src, _), (value, doc) in zip(held, got):
            c = counts[inverse[at:at + len(value)]]
            at += len(value)
            some = c > 1
            if some.any():
                yield src, 1, 0, pack(value[some] | (c[some] > often).astype(np.uint64), doc[some])
    return work


def _wanted(state: bytes, answers: list[bytes]):
    """Of each document of a source the shared anchors (first 32 bits, which may let more in) and the frequent ones (whole)."""
    o, h = unpack(state)
    out: list[list] = [[], [], [], []]
    if answers:
        value, doc = (np.concatenate(x) for x in zip(*map(unpack, answers)))
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        docs, starts = np.unique(doc, return_index=True)
        for d, s, e in zip(docs.tolist(), starts.tolist(), [*starts[1:].tolist(), len(doc)]):
            v = value[s:e]
            often = v[v & np.uint64(1) == 1] & ~np.uint64(1)
            out[0].append(int(o[d]))
            out[1].append(h[16 * d:16 * d + 16].tobytes())
            out[2].append(np.unique((v >> np.uint64(32)).astype("<u4")).tobytes())
            out[3].append(often.tobytes())
    return out


# --- second pass: the text around shared anchors


def _scan_text(length: int, buckets: int, in_row: int, hold: int):
    """(o, h, t, shared, often) -> per source: which string each document has where; per ``in_row`` buckets the strings to look up, with their bucket among them."""
    groups = -(-buckets // in_row)

    def rows(batches):
        src = TaskContext.get().partitionId() << 33
        docs, runs, found, size, held = {}, defaultdict(count().__next__), [], 0, 0

        def flush():
            rid, doc, at, new, value, often = (np.concatenate(x) for x in zip(*found))
            value, often = value[new], often[new]
            o, least, strings = np.array([k for k, _ in docs], "<i8"), np.full(len(runs), LAST), list(runs)
            np.minimum.at(least, rid, o[doc])
            sizes = np.array([len(s) for s in strings], np.int64)
            # A string is asked for as it is; one of a frequent anchor by its windows, each once, which no other string can be.
            single = np.flatnonzero(~often)
            n_refs = np.where(often, sizes - length + 1, 1)
            ref_at = np.append(0, np.cumsum(n_refs))
            refs = np.zeros(ref_at[-1], np.int64)
            refs[ref_at[single]] = np.arange(len(single))
            cut: dict[bytes, int] = {}
            cut_k: list[int] = []
            for r in np.flatnonzero(often).tolist():
                s, k = strings[r], int(least[r])
                for j in range(len(s) - length + 1):
                    i = cut.setdefault(s[j:j + length], len(cut))
                    if i == len(cut_k):
                        cut_k.append(k)
                    cut_k[i] = min(cut_k[i], k)
                    refs[ref_at[r] + j] = len(single) + i
            asked = [*(strings[i] for i in single.tolist()), *cut]
            ks = np.concatenate([least[single], np.array(cut_k, np.int64)]).astype("<i8")
            ask_bucket = np.concatenate([value[single], np.array([xxhash.xxh64_intdigest(s) for s in cut], np.uint64)])
            ask_size = np.concatenate([sizes[single], np.full(len(cut), length)]).astype("<u4")
            yield src, 0, src % groups, pack(o, np.frombuffer(b"".join(h for _, h in docs), np.uint8), *(x.astype("<u4") for x in (rid, doc, at)),
                                             (sizes - length + 1).astype("<u4"), ref_at.astype("<u4"), refs.astype("<u4"), ks)
            bucket = bucket_of(ask_bucket, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(groups + 1) * in_row)
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                mine = order[cuts[k]:cuts[k + 1]]
                yield src, 1, k, pack(mine.astype("<u4"), (bucket[mine] - k * in_row).astype("<u2"), ask_size[mine], ks[mine],
                                      np.frombuffer(b"".join([asked[i] for i in mine.tolist()]), np.uint8))

        for some in grouped(batches):
            some = [x for x in some if x[:2] not in docs]
            if not some:
                continue
            texts = [x[2] for x in some]
            value, text, start, end = anchors(texts, length)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            upper, keep, often = (value >> np.uint64(32)).astype("<u4"), np.zeros(len(value), bool), np.zeros(len(value), bool)
            for (_, _, _, shared, frequent), a, z in zip(some, cuts, cuts[1:]):
                keep[a:z] = held_in(upper[a:z], np.frombuffer(shared, "<u4"))
                if frequent:
                    often[a:z] = held_in(value[a:z], np.frombuffer(frequent, "<u8"))
            value, text, start, end, often = (x[keep] for x in (value, text, start, end, often))
            known = len(runs)
            # A string's number is its place in ``runs``; one that is above all before it is new.
            rid = np.array([runs[texts[d][a:z]] for d, a, z in zip(text.tolist(), start.tolist(), (end + length - 1).tolist())], np.int64)
            new = np.diff(np.maximum.accumulate(np.append(known - 1, rid))) > 0
            found.append((rid, len(docs) + text, start, new, value, often))
            docs |= dict.fromkeys(x[:2] for x in some)
            size += int((end - start + length - 1)[new].sum())
            held += len(rid)
            if size >= hold or held >= hold // 16:
                yield from flush()
                src += 1
                docs, runs, found, size, held = {}, defaultdict(count().__next__), [], 0, 0
        if docs:
            yield from flush()

    def run(batches):
        return _batches(rows(batches))
    return run


def _look_up(length: int):
    """The strings of some buckets, from all sources -> to each source, for its strings, the first key that holds them and the windows that earlier ones have."""
    def answers(got: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]) -> Iterator[tuple[np.ndarray, ...] | None]:
        """Of one bucket: from what each source asks (its numbers, sizes and keys, and the strings) to what it is told."""
        first: dict[bytes, int] = {}
        mine = []
        for _, sizes, ks, data in got:
            ends = np.cumsum(sizes, dtype=np.int64)
            names = [data[a:z] for a, z in zip((ends - sizes).tolist(), ends.tolist())]
            for s, k in zip(names, ks.tolist()):
                if first.get(s, LAST) >= k:
                    first[s] = k
            mine.append(names)
        order = [s for _, s in sorted(zip(first.values(), first))]
        number = {s: i for i, s in enumerate(order)}
        least = np.array([first[s] for s in order], np.int64)
        some = np.flatnonzero(may_match(order, length))
        pattern = place = np.empty(0, np.int64)
        if len(some) > 1:
            indexed = [order[i] for i in some.tolist()]
            pattern, place = RunLengthIndex(indexed, length).matches(indexed, np.searchsorted(least[some], least[some]))
            pattern = some[pattern]
        by = np.argsort(pattern, kind="stable")
        pattern, place = pattern[by], place[by].astype("<u4")
        cuts = np.searchsorted(pattern, np.arange(len(order) + 1))
        for (idx, _, ks, _), names in zip(got, mine):
            at = np.array([number[s] for s in names], np.int64)
            count = np.where(ks == least[at], cuts[at + 1] - cuts[at], 0)
            marks = np.repeat(cuts[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            earlier = least[at] < ks
            yield (idx[earlier], least[at[earlier]], np.repeat(idx, count), place[marks]) if earlier.any() or len(marks) else None

    def work(held):
        got = [unpack(body) for _, body in held]
        told: list[list[tuple[np.ndarray, ...]]] = [[] for _ in held]
        # Rows are sorted by bucket, so a bucket is a slice of each.
        buckets = np.unique(np.concatenate([bucket for _, bucket, _, _, _ in got]))
        cuts = [np.stack([np.searchsorted(bucket, buckets), np.searchsorted(bucket, buckets, "right")], 1).tolist() for _, bucket, _, _, _ in got]
        bytes_at = [np.append(0, np.cumsum(sizes, dtype=np.int64)) for _, _, sizes, _, _ in got]
        for k in range(len(buckets)):
            some = [i for i, c in enumerate(cuts) if c[k][0] < c[k][1]]
            asked = []
            for i in some:
                (idx, _, sizes, ks, data), (a, z) = got[i], cuts[i][k]
                asked.append((idx[a:z], sizes[a:z], ks[a:z], data[bytes_at[i][a]:bytes_at[i][z]].tobytes()))
            for i, answer in zip(some, answers(asked)):
                if answer:
                    told[i].append(answer)
        for (src, _), parts in zip(held, told):
            if parts:
                yield src, 1, 0, pack(*(np.concatenate(x) for x in zip(*parts)))
    return work


def _settle(length: int):
    """What a source kept and was told -> the bytes to remove of each of its documents: o, h, starts and ends."""
    def work(state, answers):
        o, h, rid, doc, at, windows, ref_at, refs, k = unpack(state)
        rid, doc, at, windows, ref_at, refs, k = (x.astype(np.int64) for x in (rid, doc, at, windows, ref_at, refs, k))
        mark_of, mark = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for body in answers:
            idx, least, marked, place = unpack(body)
            k[idx] = np.minimum(k[idx], least)
            mark_of.append(marked.astype(np.int64))
            mark.append(place.astype(np.int64))
        mark_of, mark = np.concatenate(mark_of), np.concatenate(mark)
        by = np.argsort(mark_of, kind="stable")
        mark_of, mark = mark_of[by], mark[by]
        cuts = np.searchsorted(mark_of, np.arange(len(k) + 1))
        # Each holder's parts: one of all its windows, or one per window.
        n_parts = ref_at[rid + 1] - ref_at[rid]
        holder = np.repeat(np.arange(len(rid)), n_parts)
        nth = np.arange(len(holder)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        part = refs[ref_at[rid[holder]] + nth]
        single = n_parts[holder] > 1
        start, width = at[holder] + nth, np.where(single, 1, windows[rid[holder]])
        mine = o[doc[holder]]
        gone = k[part] < mine
        n_marks = np.where(gone, 0, cuts[part + 1] - cuts[part])
        places = mark[np.repeat(cuts[part] - (np.cumsum(n_marks) - n_marks), n_marks) + np.arange(n_marks.sum())]
        who = np.concatenate([doc[holder[gone]], np.repeat(doc[holder], n_marks)])
        begin = np.concatenate([start[gone], np.repeat(start, n_marks) + places])
        end = np.concatenate([start[gone] + width[gone], np.repeat(start, n_marks) + places + 1]) + length - 1
        by = np.lexsort((begin, who))
        who, begin, end = who[by], begin[by], end[by]
        out: list[list] = [[], [], [], []]
        docs, starts = np.unique(who, return_index=True)
        for d, s, e in zip(docs.tolist(), starts.tolist(), [*starts[1:].tolist(), len(who)]):
            reach = np.maximum.accumulate(end[s:e])
            new = np.concatenate([[True], begin[s + 1:e] > reach[:-1]])
            out[0].append(int(o[d]))
            out[1].append(h[16 * d:16 * d + 16].tobytes())
            out[2].append(begin[s:e][new])
            out[3].append(reach[np.append(np.flatnonzero(new)[1:], e - s) - 1])
        return out
    return work


def by_filter(body: DataFrame, some: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``body`` whose (o, h) may be among those of ``some``, and rows whose (o, h) surely is not.

    By a Bloom filter of bounded size, so that only the former, with their
    texts, go through a join that shuffles.
    """
    table, bits = build_filter(some.select(F.xxhash64("o", "h").alias("gram")), most_bits)

    def may(keys: pa.Array) -> pa.Array:
        out = np.zeros(len(keys), bool)
        out[passes(table, bits, keys.to_numpy(zero_copy_only=False).view(np.uint64))] = True
        return pa.array(out)

    test = F.arrow_udf(may, "boolean")(F.xxhash64("o", "h"))
    return body.filter(test), body.filter(~test)


def mark_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, often: int = 5000,
                 hold: int = 500_000, bucket_bytes: int = 512 << 10, filter_bits: int = 1 << 24, most_in_row: int = 32) -> DataFrame:
    """The bytes of every text that a document with a smaller key already has in a run of ``length`` or more.

    Returns one row per input row: ``key``, n_bytes, spans (maximal runs of
    bytes to remove, start and end) and kept (the bytes that are left). A byte
    goes if it lies in a ``length``-byte string of its text that also starts in
    a text of a smaller key; texts are judged as they came.

    Exact copies are settled by their hashes; the first of them goes on. Every
    window has an anchor (``anchors``), the same wherever the window occurs. A
    first pass finds the anchors that two documents have; a second cuts the
    text of the windows at those, which is all that can match, and sends the
    distinct strings of each source of about ``hold`` bytes, with their least
    key, to buckets by anchor. A bucket's strings become a run-length
    Burrows-Wheeler index; its strings are streamed through it and their
    matching statistics mark the windows that an earlier string has. Sources
    turn marks into spans. Anchors of more than ``often`` documents send single
    windows, bucketed by their own hash, so no bucket grows with one anchor;
    what many documents have is one string with one key, whoever has it. Strings
    that can't match by what lies around their anchors are not indexed
    (``may_match``).

    Keys are whole numbers; a null key comes after all others. Rows of equal
    keys don't remove one another's bytes, so repeated rows get equal results.
    Null and empty texts, and those shorter than ``length``, lose nothing; an
    empty table gives no rows. Other columns are not read.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be {ANCHOR + 8} at least")
    bounded_batches(docs, 1000)
    body = docs.select(docs[key].alias("k"), F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("o"),
                       F.coalesce(docs[text], F.lit("")).cast("binary").alias("t")).withColumn("h", F.unhex(F.md5("t")))
    rows = materialise(body.select("o", "h", F.octet_length("t").alias("n")).filter(F.col("n") >= length), "repeat-rows")
    size = rows.agg(F.sum("n")).first()[0] or 0
    classes = rows.groupBy("h").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last").select("h", "first")
    copies = rows.join(broadcast_below(materialise(classes, "repeat-classes")), "h").filter("o > first").select("o", "h").distinct()
    copies = materialise(copies, "repeat-copies")

    long = body.filter(F.octet_length("t") >= length)
    expected = size * 2 // (length - ANCHOR + 2)
    buckets = max(1, expected // 1_000_000 + 1)
    doubtful, first = by_filter(long, copies, filter_bits)
    first = first.unionByName(doubtful.join(copies, ["o", "h"], "left_anti").select(*first.columns))
    found = first.select("o", "h", "t").mapInArrow(_scan_anchors(length, buckets, hold), ROWS)
    told = _exchange(found, buckets, _shared_anchors(often), "repeat-anchors")
    wanted = (told.repartition("src").sortWithinPartitions("src", "kind")
              .mapInArrow(_per_source(_wanted, [("o", pa.int64()), ("h", pa.binary()), ("shared", pa.binary()), ("often", pa.binary())]),
                          "o long, h binary, shared binary, often binary"))
    wanted = materialise(wanted.dropDuplicates(["o", "h"]), "repeat-wanted")
    asked = wanted.agg(F.sum(F.octet_length("shared")) / 4).first()[0] or 0

    buckets = int(asked * length * 0.8 // bucket_bytes) + 1
    doubtful, _ = by_filter(long, wanted, filter_bits)
    # Sources and buckets both grow with the table; from some hundreds of buckets on, several travel in a row and are looked up one after the other.
    in_row = max(1, min(most_in_row, buckets // 256))
    found = doubtful.join(wanted, ["o", "h"]).select("o", "h", "t", "shared", "often").mapInArrow(_scan_text(length, buckets, in_row, 8 * hold), ROWS)
    told = _exchange(found, -(-buckets // in_row), _look_up(length), "repeat-strings")
    gone = (told.repartition("src").sortWithinPartitions("src", "kind")
            .mapInArrow(_per_source(_settle(length), [("o", pa.int64()), ("h", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]),
                        "o long, h binary, starts array<long>, ends array<long>"))
    none = F.lit(None).cast("array<long>")
    gone = materialise(gone.dropDuplicates(["o", "h"]).unionByName(copies.select("o", "h", none.alias("starts"), none.alias("ends"))), "repeat-gone")

    kind = dict(docs.dtypes)[key]

    def finish(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            spans, kept = [], []
            for t, found, starts, ends in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                at = [] if not found else [(0, len(t))] if starts is None else list(zip(starts, ends))
                rest = [0, *(x for s in at for x in s), len(t)]
                spans.append([{"start": s, "end": e} for s, e in at])
                kept.append(b"".join(t[s:e] for s, e in zip(rest[::2], rest[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64()),
                                              pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    touched, others = by_filter(body, gone, filter_bits)
    marked = touched.join(gone.withColumn("found", F.lit(True)), ["o", "h"], "left").select("k", "t", "found", "starts", "ends")
    others = others.select("k", "t", F.lit(None).cast("boolean").alias("found"), none.alias("starts"), none.alias("ends"))
    return marked.unionByName(others).mapInArrow(finish, f"`{key}` {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
