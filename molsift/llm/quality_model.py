"""Operator 4: quality classifier from overlapping heuristic labellers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molsift.llm.common import bounded_batches, hash31
from molsift.session import materialise

# Byte classes for the hashed features.
CLASS_CHARS = ["\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f", " \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz",
               "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", ";:", "!", "?", "|", "#*$%&<>", "()[]{}\"'`-_", "/\\@+=~^"]
NON_ASCII = 15
# Frequent function words of the languages looked for.
FUNCTION_WORDS = {w.encode() for w in (
    "the of and a to in is that it was for on are as with his they at be this from have or by one had not but what all were when "
    "we there can an your which their said if do der die und das den von zu mit sich des auf für ist im dem nicht ein eine als "
    "auch es an er so dass de la le et les des un une du que est pour qui dans par il au sur se plus pas el los las y en del con "
    "una su para es al lo como más o pero sus").split()}
LABELLERS = ("symbols", "pipes", "bare_signs", "capitals", "shouts", "repeats", "runs", "variety", "word_length",
             "function_words", "letters", "length")
# The labellers that look for one flaw each.
FLAWS = (("symbols",), ("pipes", "bare_signs", "symbols"), ("capitals", "shouts"), ("repeats", "runs", "variety"))
DIMS = 128
EXTRAS = 8

_CLASS = np.full(256, 14, np.uint8)
_CLASS[128:] = NON_ASCII
for _i, _chars in enumerate(CLASS_CHARS):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
# Continuation bytes of UTF-8 belong to the character before them.
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False
_FOLD = (np.arange(4096, dtype=np.uint64) * np.uint64(0x9E3779B1) % np.uint64(2**32) >> np.uint64(25)).astype(np.int64)


def _vote(value: float, good: float, bad: float) -> int:
    """0 (good), 1 (bad) or -1 (no opinion) for a value that is worse the nearer it is to ``bad``."""
    if good <= bad:
        return 0 if value <= good else 1 if value >= bad else -1
    return 0 if value >= good else 1 if value <= bad else -1


def describe(text: str | None) -> tuple[list[int], np.ndarray]:
    """Votes of the labellers and the hashed features of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    x = np.zeros(DIMS + EXTRAS, np.float32)
    if not n:
        return [-1] * (len(LABELLERS) - 1) + [1], x
    data = np.frombuffer(raw, np.uint8)
    classes = _CLASS[data]
    if classes.max() == NON_ASCII:
        classes = classes[_STARTS[data]]
    hist = np.bincount(classes, minlength=16)
    chars = int(hist.sum() - hist[1] - hist[2])
    codes = classes.astype(np.int64)
    if len(codes) > 2:
        tri = codes[:-2] * 256 + codes[1:-1] * 16 + codes[2:]
        counts = np.bincount(tri, minlength=4096)
        x[:DIMS] = np.sqrt(np.bincount(_FOLD, weights=counts, minlength=DIMS) / len(tri))
    letters = int(hist[3] + hist[4] + hist[NON_ASCII])
    same = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, n - 1)
    adjacent = int(same.sum()) / n
    breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    run = int(np.diff(breaks).max())
    bare = sum(1 for w in words if len(w) <= 2 and not w.isalnum() and w[0] < 128) / n
    variety = len(set(words)) / n if n < 200 else len(set(words)) / n * (n / 200) ** 0.3
    function = sum(map(FUNCTION_WORDS.__contains__, map(bytes.lower, words))) / n
    caps = hist[4] / max(1, hist[3] + hist[4])
    length = chars / n
    x[DIMS:] = adjacent, min(variety, 2.0), function, caps, min(length, 20.0) / 10, np.log1p(n) / 10, min(run, 50) / 25, bare
    some = n >= 20
    votes = [
        _vote((hist[11] + hist[12]) / chars, 0.02, 0.08),
        _vote(hist[11] / n, 0.02, 0.20),
        _vote(bare, 0.05, 0.25),
        _vote(caps, 0.25, 0.60) if letters >= 20 else -1,
        _vote(variety, 0.30, 0.12) if some else -1,
        _vote(hist[9] / n, 0.10, 0.50),
        _vote(adjacent, 0.03, 0.15),
        _vote(run, 3, 10),
        _vote(abs(length - 6.0), 2.5, 5.5) if some else -1,
        _vote(function, 0.08, 0.01) if some else -1,
        _vote(letters / chars, 0.85, 0.65),
        _vote(n, 20, 0),
    ]
    return votes, x


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P(bad) of each vote pattern by expectation-maximisation.

    ``patterns`` holds votes (rows: patterns), ``counts`` how many documents
    gave them. A document is good or has one of the flaws of FLAWS, since one
    that is all capitals may well be free of stray signs: each labeller has a
    rate of bad votes for good documents and one for each flaw. Rates start
    from the labellers that look for the flaw and keep a small prior.
    """
    said, bad_vote = patterns >= 0, patterns == 1
    start = np.full((1 + len(FLAWS), patterns.shape[1]), 0.15)
    start[0] = 0.02
    for c, seeds in enumerate(FLAWS, 1):
        start[c, [LABELLERS.index(s) for s in seeds]] = 0.85
    weight = np.full(start.shape, 20.0)
    shares = np.array([0.85] + [0.15 / len(FLAWS)] * len(FLAWS))
    rates, post = start.copy(), np.zeros((len(patterns), len(start)))
    for _ in range(rounds):
        like = np.log(shares) + (said & bad_vote) @ np.log(rates).T + (said & ~bad_vote) @ np.log(1 - rates).T
        post = np.exp(like - like.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        held = post * counts[:, None]
        rates = (weight * start + held.T @ bad_vote) / (weight + held.T @ said)
        rates = np.clip(rates, 1e-4, 0.99)
        shares = (held.sum(0) + 1.0) / (held.sum() + len(start))
    return 1 - post[:, 0]


def train(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised logistic weights (bias last) for soft labels ``p``, by Newton steps."""
    a = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (q - p) + penalty * w
        hess = (a * (q * (1 - q) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _good(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The model's P(good) of rows of features; 0 without words."""
    good = 1 / (1 + np.exp(np.clip(x.astype(np.float64) @ weights[:-1] + weights[-1], -30, 30)))
    good[~x.any(1)] = 0.0
    return good


def fit_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = 20_000) -> tuple[DataFrame, dict, np.ndarray]:
    """Votes and features of all rows (k, votes, x), P(bad) by votes, and the weights of the model."""
    bounded_batches(docs)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for b in batches:
            got = [describe(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([v for v, _ in got], pa.list_(pa.int32())), pa.array([x.tobytes() for _, x in got], pa.binary())],
                names=["k", "votes", "x"])

    rows = materialise(docs.select(docs[key], docs[text]).mapInArrow(run, f"k {kind}, votes array<int>, x binary"), "quality-rows")
    counted = sorted((tuple(r[0]), r[1]) for r in rows.groupBy("votes").count().collect())
    total = sum(n for _, n in counted)
    if not total:
        return rows, {}, np.zeros(DIMS + EXTRAS + 1)
    patterns, counts = np.array([v for v, _ in counted]), np.array([n for _, n in counted], float)
    bad = {v: float(p) for (v, _), p in zip(counted, estimate(patterns, counts))}
    share = min(1.0, max_train / total)
    picked = rows.filter(hash31(F.col("k"), F.col("x")) < int(share * 2**31)).select("votes", "x").limit(2 * max_train).collect()
    picked = sorted((bytes(r[1]), tuple(r[0])) for r in picked)
    if not picked:
        return rows, bad, np.zeros(DIMS + EXTRAS + 1)
    return rows, bad, train(np.array([np.frombuffer(x, np.float32) for x, _ in picked]), np.array([bad[v] for _, v in picked]))


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = 20_000,
                  threshold: float = 0.5) -> DataFrame:
    """Judge every document by a linear model trained on weak labels.

    Returns one row per input row: ``key``, weak_bad (posterior of the
    labellers), score (model's P(good), 0 to 1) and kept. Twelve overlapping
    heuristics vote on each text; expectation-maximisation over the counts of
    all vote patterns (at most 3^12, whatever the corpus) estimates how often
    each is right; the posteriors label about ``max_train`` rows, chosen by a
    hash of key and features, that train a logistic model of hashed character
    trigram classes. All rows are scored.

    The texts are read once; of each stay its votes and 136 numbers. Null and
    blank texts are bad (score 0); null and repeated keys are rows like any
    other, equal texts get equal scores; an empty table gives no rows. Other
    columns are not read.
    """
    rows, bad, weights = fit_quality(docs, key, text, max_train)

    def score(batches):
        for b in batches:
            good = _good(np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, DIMS + EXTRAS), weights)
            weak = [bad[tuple(v)] for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak, pa.float64()), pa.array(good, pa.float64()),
                                              pa.array(good >= threshold, pa.bool_())], names=[key, "weak_bad", "score", "kept"])

    return rows.mapInArrow(score, f"`{key}` {dict(docs.dtypes)[key]}, weak_bad double, score double, kept boolean")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with all columns; no text is shuffled."""
    bounded_batches(docs)
    _, _, weights = fit_quality(docs, key, text, max_train)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            x = np.array([describe(t)[1] for t in b.column(at).to_pylist()], np.float32).reshape(-1, DIMS + EXTRAS)
            yield b.filter(pa.array(_good(x, weights) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
