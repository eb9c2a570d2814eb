"""The pipeline's stages and its result against a brute-force version on a small corpus."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from molsift.llm.decontaminate import align, word_hashes
from molsift.llm.quality_model import score_quality
from molsift.session import ensure_checkpoint_dir
from tests.llm.fixtures import DOC_SCHEMA, documents, sentence
from tests.llm.test_document_operators import _components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    df, rows = documents(spark, n=40, seed=7)
    items = [sentence(rng, 25).replace("\n", " ") for _ in range(3)]
    planted = [(5000 + i, sentence(rng, 40) + "\n" + t + "\n" + sentence(rng, 40), "en", "src1", 1) for i, t in enumerate(items)]
    path = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    df.unionByName(spark.createDataFrame(planted, DOC_SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [*rows, *planted], items


def key(r):
    return (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())


def brute_force(rows, items, good):
    """Rows (doc_id, text) of the mix, each as often as it is taken."""
    rows = [r for r in rows if (r[0], r[1]) in good]
    sets, comp = _components(rows)
    first = {}
    for r, c in sorted(zip(rows, comp), key=lambda x: key(x[0])):
        first.setdefault(c, r)
    rows = [r for r in first.values()] + [r for r, s in zip(rows, sets) if not s]
    hashes = [word_hashes(t) for t in items]
    rows = [r for r in rows if not any(align(h, word_hashes(r[1]))[0] >= len(h) for h in hashes)]
    size = {id(r): len(WORD.findall(r[1] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    words = {s: sum(size[id(r)] for r in by[s]) for s in order}
    capped = set()
    while True:
        level = (sum(words.values()) - sum(3 * words[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * words[s]}
        if not new:
            break
        capped |= new
    out = Counter()
    for s in order:
        budget = int(min(level * weight[s], float(3 * words[s])))
        epochs, rest = divmod(budget, words[s]) if words[s] else (0, 0)
        before = 0

        def place(r):
            name = ":".join(([str(r[0])] if r[0] is not None else []) + ["17"])
            return (int(hashlib.md5(name.encode()).hexdigest()[:8], 16) >> 1, r[0] is not None, r[0] or 0, size[id(r)])
        for r in sorted(by[s], key=place):
            n = size[id(r)]
            out[(r[0], r[1])] += epochs + (2 * before + n <= 2 * rest)
            before += n
    return +out


def test_stages_are_whole(spark, corpus):
    path, rows, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = set()
    scored = score_quality(docs).select("doc_id", "score", "kept")
    assert scored.count() == len(rows)
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{path}/{name}"
        stage(spark, seen, path).write.parquet(out)
        seen = spark.read.parquet(out)
        assert seen.columns == docs.columns and seen.schema == docs.schema
        if name == "quality_classifier":
            good = {(r["doc_id"], r["text"]) for r in seen.collect()}
    want = brute_force(rows, items, good)
    assert Counter((r["doc_id"], r["text"]) for r in seen.collect()) == want
    last = corpus_pipeline.STAGES[-1][1](spark, seen, path).collect()
    assert Counter(r["doc_id"] for r in last) == sum((Counter({k[0]: n}) for k, n in want.items()), Counter())
    places = defaultdict(list)
    for r in last:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(16))


def test_run_equals_the_stages(spark, corpus):
    path, _, _ = corpus
    a = corpus_pipeline.run(spark, path).collect()
    b = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) > 0


def test_stages_on_an_empty_table(spark, corpus):
    path, _, _ = corpus
    docs = spark.createDataFrame([], DOC_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_stages_keep_columns_with_clashing_names(spark, corpus):
    from tests.llm.fixtures import with_clashes
    path, _, _ = corpus
    docs = with_clashes(spark.read.parquet(f"{path}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert set(docs.columns) >= {"k", "h", "n", "size", "node", "region", "shard"}
    assert docs.count() > 0
