"""Token alignment, repeated passages and hard negatives against brute force, with awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molsift.llm import repeat_index as R
from molsift.llm import token_alignment as A
from molsift.llm.hard_negatives import Block, mine_negatives, vertical_scan
from tests.llm.fixtures import DOC_SCHEMA, documents, same_rows, with_clashes

PATHS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = documents(spark)
    return df.cache(), rows


# --- token alignment

def plain_alignment(texts):
    """Links of every text by the tokenizers' own libraries, one token at a time."""
    import sentencepiece
    import tokenizers
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = A.byte_letters()
    out = []
    for t in texts:
        whole = (" " + t).encode() if t else b""
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        groups, links, group, i, j, at_a, at_b = [], [], ([], []), 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                group[0].append(ids_a[i])
                at_a, i = at_a + len(bytes_a[i]), i + 1
            else:
                group[1].append(ids_b[j])
                at_b, j = at_b + len(bytes_b[j]), j + 1
            if at_a == at_b:
                groups.append(group)
                links.append((group[0][-1], group[1][-1]))
                group = ([], [])
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def alignment_rows(keys, texts):
    found = plain_alignment(texts)
    counts = Counter(x for f in found for x in f[3])
    top = defaultdict(int)
    for (a, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for k, (n_a, n_b, groups, links) in zip(keys, found):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((k, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows


SPECIAL = ["<|endoftext|> in a text", "<s>a</s> <unk>", "tab\there  two   spaces", "trailing space ", " leading", "漢字 und Ünïcode 😀 👩‍🔬", "\x00\x01 controls",
           "ﬁ ligature and ① full－width", "a" * 3000, " " * 40, "\n\n\n", "<0x41> literal", "▁ mark", "é combining", "don't we'll", None, "", "12345678901234567890"]


def test_alignment_against_brute_force(spark, docs):
    df, rows = docs
    keys, texts = [r[0] for r in rows], [r[1] for r in rows]
    got = A.align_tokenizers(with_clashes(df), *PATHS, hold=2000).collect()
    assert same_rows([tuple(r) for r in got], alignment_rows(keys, texts))


def test_alignment_of_special_texts(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    assert same_rows([tuple(r) for r in A.align_tokenizers(df, *PATHS).collect()], alignment_rows(range(len(SPECIAL)), SPECIAL))


def test_pair_counts_from_the_bitmaps(spark, docs):
    df, rows = docs
    _, postings = A.aligned_rows(df, *PATHS, hold=500)
    index, counts = A.pair_index(postings)
    found = plain_alignment([r[1] for r in rows])
    links, in_docs = Counter(x for f in found for x in f[3]), Counter(x for f in found for x in set(f[3]))
    assert {(r["a"], r["b"]): r["n_links"] for r in counts.collect()} == links
    assert {(r["pair"] >> 20, r["pair"] & (1 << 20) - 1): r["n_docs"] for r in A.pair_documents(index).collect()} == in_docs


def test_bitmaps_come_back():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, A.CHUNK, n)) for n in (1, 5, 511, 513, 3000, A.CHUNK * 4)]
    places, owner = A.unpack([A.pack(s) for s in sets])
    for i, s in enumerate(sets):
        assert sorted(places[owner == i].tolist()) == s.tolist()


def test_alignment_of_nothing(spark):
    assert A.align_tokenizers(spark.createDataFrame([], DOC_SCHEMA), *PATHS).collect() == []


# --- repeated passages

def brute_repeats(rows, length):
    first = {}
    last = 1 << 63
    texts = [(last if k is None else k, (t or "").encode()) for k, t in rows]
    for k, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            first[w] = min(first.get(w, last), k)
    out = []
    for (key, _), (k, t) in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < k:
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        out.append((key, len(t), [tuple(x) for x in zip(edges[::2], edges[1::2])], t if not gone.any() else bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def repeats(df, **options):
    return [(r[0], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in R.mark_repeats(df, **options).collect()]


@pytest.mark.parametrize("options", [{}, {"often": 3}, {"length": 24, "hold": 300, "bucket_bytes": 4000}, {"length": 90, "often": 1, "hold": 1000}], ids=str)
def test_repeats_against_brute_force(spark, docs, options):
    df, rows = docs
    want = brute_repeats([(r[0], r[1]) for r in rows], options.get("length", 50))
    got = repeats(with_clashes(df), **options)
    assert sum(len(w[2]) > 0 for w in want) > 20
    assert same_rows(got, want)


def test_repeats_in_long_and_monotonous_texts(spark):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = ["a" * 5000, "b" + "a" * 3000, "ab" * 900, passage * 4, "x" + passage[:49] + "y", "x" + passage[100:150] + "y", passage[::-1], "é" * 200 + passage[:60],
             "ü" * 24 + "é" * 60, "a" * 49, "a" * 50]
    rows = list(enumerate(texts)) + [(2, "a" * 60), (None, passage), (None, "a" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert same_rows(repeats(df), brute_repeats(rows, 50))


def test_repeats_of_nothing(spark):
    assert repeats(spark.createDataFrame([], DOC_SCHEMA)) == []
    df = spark.createDataFrame([(1, None), (2, ""), (None, "short")], "doc_id long, text string")
    assert same_rows(repeats(df), [(1, 0, [], b""), (2, 0, [], b""), (None, 5, [], b"short")])


@pytest.mark.parametrize("seed", range(6))
def test_run_length_index(seed):
    rng = random.Random(seed)
    length = (9, 14, 24, 30, 50, 100)[seed]
    base = bytes(rng.choice(b"ab\xff\x00") for _ in range(600))
    strings = {b"a" * 300, b"a" * 299}
    for _ in range(40):
        s = bytearray(base[(a := rng.randint(0, 500)):a + rng.randint(1, 200)])
        s[rng.randrange(len(s))] = rng.choice(b"abc")
        strings.add(bytes(s))
    strings = sorted(strings)
    rng.shuffle(strings)
    index = R.RunLengthIndex(strings, length)
    assert len(index.run) < index.n
    patterns = strings + [base[20:90] + b"zq" + base[100:300], b"zzz", b""]
    below = np.array([rng.randint(0, len(strings)) for _ in patterns])
    want = [(i, j) for i, p in enumerate(patterns) for j in range(len(p) - length + 1) if any(p[j:j + length] in s for s in strings[:below[i]])]
    assert sorted(zip(*(x.tolist() for x in index.matches(patterns, below)))) == want


def test_long_patterns_have_no_steps_to_themselves():
    """A pattern of 5,000 letters takes as many steps as one of 60, give or take a few."""
    rng = random.Random(5)
    long = bytes(rng.choice(b"abcd") for _ in range(5000))
    index = R.RunLengthIndex([long[100:160], long], 20)

    class Counted:
        def __init__(self, values):
            self.values, self.asked = values, 0

        def __getitem__(self, at):
            self.asked += 1
            return self.values[at]
    index.run_of = Counted(index.run_of)
    pattern, place = index.matches([long[100:160], long], np.array([2, 1]))
    assert sorted(place[pattern == 1].tolist()) == list(range(100, 141)) and sorted(place[pattern == 0].tolist()) == list(range(41))
    assert index.run_of.asked <= 60


def test_rows_between_sources_and_buckets_are_bounded(spark, docs, monkeypatch):
    """However many buckets there are, a source sends some hundreds of rows."""
    df, rows = docs
    sent, exchange = {}, R._exchange

    def count(found, buckets, work, label):
        sent[label] = (buckets, found.groupBy("src").count().agg({"count": "max"}).first()[0])
        return exchange(found, buckets, work, label)
    monkeypatch.setattr(R, "_exchange", count)
    got = repeats(df, bucket_bytes=20)
    assert same_rows(got, brute_repeats([(r[0], r[1]) for r in rows], 50))
    assert max(sent["repeat-strings"]) <= 513


# --- hard negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_negatives(rows, every=100, low=80):
    good = [(k, la, [math.floor(256 * x) for x in v]) for k, v, la in rows
            if k is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (k, la, v) in enumerate(good):
        if k % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), c, j) for j, (c, _, w) in enumerate(good) if j != i)
        for s, p, _ in [x for x in scored if good[x[2]][1] == la][:5]:
            fit = [(c, -t) for t, c, j in scored if good[j][1] != la and low * -s <= 100 * -t <= 100 * -s][:5]
            out += [(k, p, r + 1, c, -s, t) for r, (c, t) in enumerate(fit)]
    return out


def vectors(seed, n=700, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32) + (rng.normal(size=dims) * (seed % 3)).astype(np.float32)
    rows = [(i * 10 - 300, [float(c) for c in v], int(rng.integers(0, 4) ** 2 % 5)) for i, v in enumerate(x)]
    rows += [(5, None, 1), (100, [float("nan")] * dims, 1), (200, [None, 1.0], 1), (300, [1.0] * dims, None), (None, [1.0] * dims, 1), (400, [float("inf")] * dims, 2),
             (500, [], 1), (600, [2.0, 1.0], 3), rows[40], rows[40], (700, [0.0] * dims, 0), rows[60][:2] + (4,)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_brute_force(spark, seed):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = brute_negatives(rows)
    assert len(want) > 100
    clashes = df.select("*", *[F.lit("clash").alias(c) for c in ("key", "row", "score", "rank", "n", "v", "_v", "cols")])
    # Small blocks and rounds of a few anchors give the same as one of each.
    for got in (mine_negatives(df), mine_negatives(clashes, block_rows=50, anchor_bytes=4000)):
        assert same_rows([tuple(r) for r in got.collect()], want)


def test_negatives_of_nothing(spark):
    assert mine_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert mine_negatives(spark.createDataFrame([(1, [1.0], 1), (100, None, 2)], VECTORS)).collect() == []


def test_components_beyond_float64(spark):
    rows = [(100, [3e16, 1.0], 1), (1, [2e16, 5.0], 1), (2, [2e16, 4.0], 0), (3, [2e16, 6.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["positive_id"], r["negative_id"], r["negative_score"]) for r in mine_negatives(df, scale=1).collect())
    assert got == [(1, 2, (1 << 63) - 1), (1, 3, (1 << 63) - 1)]  # scores stop at the range of a long


def test_scan_drops_rows_early():
    rng = np.random.default_rng(1)
    cols = rng.integers(-100, 100, (32, 2000))
    block = Block(np.arange(2000), np.arange(2000), ["a", "b"], [0, 900], cols)
    anchor = rng.integers(-100, 100, 32)
    at, score = vertical_scan(block, anchor, block.bitmap("a", False), [(20_000, 30_000), (60_000, 90_000)])
    full = anchor @ cols
    want = [i for i in range(900, 2000) if 20_000 <= full[i] <= 30_000 or 60_000 <= full[i] <= 90_000]
    assert at.tolist() == want and score.tolist() == full[want].tolist()
