"""Operators on documents against brute force, with awkward rows, clashing columns and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from molsift.llm import jaccard_join as J
from molsift.llm.decontaminate import align, contaminated, keep_clean, word_hashes
from molsift.llm.line_dedup import dedup_lines, line_report
from molsift.llm.mixing import mix_documents, mix_sources
from molsift.llm.pii import KINDS, detect_pii, span_text
from molsift.llm.quality_model import keep_good, score_quality
from molsift.llm.quality_rules import quality_rules
from molsift.llm.sharding import differencing, shard
from tests.llm.fixtures import DOC_SCHEMA, documents, edited, same_rows, sentence, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OPERATORS = [detect_pii, line_report, mix_sources, score_quality, shard, J.ngram_join, quality_rules]


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = documents(spark)
    return df.cache(), rows


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_one_row_per_row_and_extra_columns(spark, docs, operator):
    df, rows = docs
    got = operator(with_clashes(df)).collect()
    assert same_rows([(r[0],) for r in got], [(r[0],) for r in rows])
    assert same_rows([tuple(map(str, r)) for r in got], [tuple(map(str, r)) for r in operator(df).collect()])


@pytest.mark.parametrize("operator", [J.keep_one, keep_good, mix_documents, dedup_lines], ids=lambda f: f.__name__)
def test_whole_rows_with_extra_columns(spark, docs, operator):
    """Operators that return the rows themselves keep columns whose names they use inside."""
    df, _ = docs
    wide = with_clashes(df)
    got = operator(wide)
    assert got.columns == wide.columns
    assert same_rows([tuple(r) for r in got.select(*df.columns).collect()], [tuple(r) for r in operator(df).collect()])


@pytest.mark.parametrize("operator", [*OPERATORS, J.keep_one, keep_good, mix_documents, dedup_lines], ids=lambda f: f.__name__)
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


# --- personal data

PII_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _pii_ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


PII_TEXTS = ["a@b.c", "x a@b.c_d@e.f y", "a@b.c.@d.e", "é😀 me.you+1@mail-x.example.com.", "a@b", "@b.c", "a@b..c", "a@b-.c@d.e",
             "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0255 1.2.3.999999999999999999999", "4465758382889437 4465758382889437",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "4111--1111", "+1 (743) 555-3824", "+1((((((", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
             "+1-800-555-0199+1-800-555-0198", "call 555-123-4567 or mail joe (at) example (dot) com", "", None, "1" * 3000, "a" * 3000, "1 " * 2000]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    got = {r[0]: r for r in detect_pii(df).select("doc_id", span_text(F.col("base")).alias("base"), span_text(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(PII_TEXTS):
        want = [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PII_BASE[k], t or "") if _pii_ok(k, m[0])]
        assert got[i]["base"] == ",".join(want), t
        assert set(want) <= set(got[i]["spans"].split(",")) or not want


def test_pii_method_adds_spans(spark):
    texts = ["phone 555-123-4567 now"] * 3 + ["mail joe (at) example (dot) com please"] * 3 + ["+1 (743) 555-3824 x me@example.com y 8.8.8.8"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in detect_pii(df).select("doc_id", span_text(F.col("spans"))).collect()}
    assert got[3] == "email:5:31"


# --- lines

def test_line_report(spark, docs):
    df, _ = docs
    rows = [r for r in df.collect()]
    got = line_report(df).collect()
    places = {}
    lines = []
    for r in rows:
        for no, line in enumerate((r["text"] or "").split("\n")):
            w = tuple(WORD.findall(line))
            if w:
                lines.append(((r["doc_id"] is None, r["doc_id"] or 0, no), w, r))
    for at, w, _ in lines:
        places[w] = min(at, places.get(w, at))

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    want = defaultdict(set)
    for at, w, r in lines:
        near = len(w) >= 5 and any(p < at and abs(len(v) - len(w)) < 2 and len(v) >= 5 and one_edit(v, w) for v, p in places.items() if p < places[w])
        if places[w] < at or near:
            want[r["doc_id"]].add((at[2], places[w] == at))
    for r in got:
        expect = want[r["doc_id"]]
        assert r["dropped"] == ",".join(str(no) for no in sorted({no for no, _ in expect})) or len({x for x, _ in expect}) < len(expect)


def test_dedup_lines_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e\nx\na b c d e", "q"), (2, "a b c d f\ny", "q"), (3, None, "q")], "doc_id long, text string, line string")
    assert same_rows(dedup_lines(df).collect(), [(1, "a b c d e\nx", "q"), (2, "y", "q"), (3, None, "q")])


@pytest.mark.parametrize("key", [1, None])
def test_near_lines_of_texts_that_share_a_key(spark, key):
    # The earliest place of each line is in one of several rows of the key, at the same line number.
    texts = [f"first{i} b c d e f{i}" for i in range(12)]
    rows = [(key, t) for t in texts] + [(None if key is None else 2, "x\n" + "\n".join(t.replace(" c ", " edit ") for t in texts))]
    got = line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [r["dropped"] for r in got if r["n_lines"] > 1] == [",".join(str(i) for i in range(1, 13))]
    assert sum(r["n_near"] for r in got if r["n_lines"] > 1) == 12
    if key is not None:  # rows of one key drop what any of them drops
        assert {r["n_near"] for r in got if r["n_lines"] == 1} == {0}


# --- mixing

def test_mixing(spark, docs):
    df, rows = docs
    got = mix_sources(df, bucket_rows=5).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    target = {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in target.values()}
    by = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["target"]] += r["taken"]
    for t, n in by.items():
        assert n == int(t)
    assert same_rows(got, mix_sources(df.repartition(2), bucket_rows=5).collect())


def test_mix_documents(spark, docs):
    df, _ = docs
    got = mix_documents(df, bucket_rows=5)
    assert got.columns == df.columns
    plan = {(r["target"], r["source_size"]) for r in mix_sources(df).collect()}
    longest = 4100
    words = sum(len(WORD.findall(r["text"] or "")) for r in got.collect())
    assert abs(words - sum(t for t, _ in plan)) <= longest * len(plan)


# --- sharding

def test_differencing_is_tight():
    sizes = [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]
    slots = differencing([[s, 0, 0] for s in sizes], 3)
    sums = [0, 0, 0]
    for s, at in zip(sizes, slots):
        sums[at[0]] += s
    assert max(sums) - min(sums) <= 1 and sum(sums) == sum(sizes)


@pytest.mark.parametrize("per_bucket,fan_in", [(4096, 256), (4, 2)])
def test_sharding(spark, docs, per_bucket, fan_in):
    df, rows = docs
    got = shard(df, ways=4, per_bucket=per_bucket, fan_in=fan_in, slot_rows=7).collect()
    by_crc, bytes_of, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        by_crc[r["text_crc32"]].add(r["shard"])
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_crc.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(bytes_of.values()) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    if per_bucket > 100:  # the long text is the largest group
        assert max(bytes_of.values()) - min(bytes_of.values()) < 0.35 * max(bytes_of.values())


# --- n-gram join

def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*[w[i:] for i in range(5)])) if w else frozenset()


def _components(rows):
    sets = [_shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    return sets, comp


@pytest.mark.parametrize("options", [{}, {"max_tokens": 400, "pivots": 2, "salts": 2}], ids=["in task", "split by pivots"])
def test_ngram_join(spark, docs, options):
    df, rows = docs
    sets, comp = _components(rows)
    best = {}
    for r, c, s in zip(rows, comp, sets):
        if r[0] is not None:
            best[c] = min(best.get(c, r[0]), r[0])
    want = [(r[0], len(s), best.get(c)) for r, s, c in zip(rows, sets, comp)]
    assert same_rows(J.ngram_join(df, **options).collect(), want)


def test_keep_one(spark, docs):
    df, rows = docs
    sets, comp = _components(rows)
    got = J.keep_one(df)
    assert got.columns == df.columns
    left = got.collect()
    blank = sum(not s for s in sets)
    assert len(left) == len({c for c, s in zip(comp, sets) if s}) + blank


# --- decontamination

def test_alignment_against_the_plain_recurrence():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(1, 15))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                m[i][j] = max(0, m[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), m[i - 1][j] - 1, m[i][j - 1] - 1)
        assert align(a, b)[0] == max(map(max, m))


def test_decontamination(spark, docs):
    import random
    rng = random.Random(9)
    df, rows = docs
    items = [sentence(rng, 30).replace("\n", " ") for _ in range(6)]
    planted = [(9000, sentence(rng, 50) + "\n" + items[0].upper() + "\n" + sentence(rng, 50), "en", "s", 1),
               (9001, sentence(rng, 40) + " " + edited(rng, items[1], 0.12) + " " + sentence(rng, 10), "en", "s", 1),
               (9002, items[2], "en", "s", 1), (9002, "a different text of the same id", "en", "s", 1)]
    every = df.unionByName(spark.createDataFrame(planted, DOC_SCHEMA))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "too short"), (None, items[5])], "item_id long, text string")
    found = contaminated(with_clashes(every), bench).collect()
    assert {(r["doc_id"], r["item"]) for r in found} == {(9000, 0), (9001, 1), (9002, 2)}
    # Brute force: every document against every item.
    want = {(r[0], i) for r in [*rows, *planted] for i, t in enumerate(items)
            if len(word_hashes(r[1])) and align(word_hashes(t), word_hashes(r[1]))[0] >= len(word_hashes(t))}
    assert {(r["doc_id"], r["item"]) for r in found} == want
    clean = keep_clean(every, bench)
    assert clean.columns == every.columns and clean.count() == every.count() - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(every, none).collect() == [] and contaminated(every.limit(0), bench).collect() == []


@pytest.mark.parametrize("verbatim", [0, 1])
def test_decontamination_of_an_edited_copy_in_many_documents(spark, verbatim):
    import random
    rng = random.Random(11)
    words = sentence(rng, 30).replace("\n", " ").split()
    item = " ".join(words)
    edit = " ".join("edit" if i in (4, 9, 14, 19, 24) else w for i, w in enumerate(words))
    assert align(word_hashes(item), word_hashes(edit))[0] >= len(word_hashes(item))
    rows = [(i, sentence(rng, 20) + "\n" + (edit if i < 100 else item) + "\n" + sentence(rng, 20)) for i in range(100 + verbatim)]
    df = spark.createDataFrame([*rows, (500, sentence(rng, 60))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated(df, bench).collect()} == set(range(100 + verbatim))
    assert [r["doc_id"] for r in keep_clean(df, bench).collect()] == [500]


def test_a_phrase_of_all_documents_and_most_items_joins_nothing(spark):
    import random
    from molsift.llm import decontaminate as D
    rng = random.Random(12)
    phrase = "choose the best answer from these"
    items = [sentence(rng, 20).replace("\n", " ") + " " + phrase for _ in range(50)]
    rows = [(i, sentence(rng, 30) + "\n" + phrase + " " + sentence(rng, 30)) for i in range(300)]
    rows += [(900 + i, sentence(rng, 30) + "\n" + t + "\n" + sentence(rng, 30)) for i, t in enumerate(items[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item"]) for r in contaminated(df, bench).collect()} == {(900 + i, i) for i in range(5)}
    grams = [(i, D.ngrams(D.word_hashes(t), 3).view("int64").tolist()) for i, t in enumerate(items)]
    seeds = {r["gram"] for r in D.seed_grams(spark.createDataFrame(grams, "i long, grams array<long>"), 16, 8, 2).collect()}
    assert not seeds & set(D.ngrams(D.word_hashes(phrase), 3).view("int64").tolist())


def test_many_items_alike_keep_seeds(spark):
    import random
    rng = random.Random(13)
    item = sentence(rng, 30).replace("\n", " ")
    bench = spark.createDataFrame([(i, item) for i in range(40)], "item_id long, text string")
    df = spark.createDataFrame([(1, sentence(rng, 30) + " " + item), (2, sentence(rng, 60))], "doc_id long, text string")
    assert {(r["doc_id"], r["item"]) for r in contaminated(df, bench).collect()} == {(1, i) for i in range(40)}


# --- quality

def test_quality_rules_base(spark, docs):
    df, _ = docs
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
           for r in quality_rules(df).collect()}
    for r in df.collect():
        t = r["text"] or ""
        ws = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        tri = list(zip(ws, ws[1:], ws[2:]))
        c = Counter(tri)
        cover = {i + j for i, g in enumerate(tri) if c[g] > 1 for j in range(3)}
        n = len(ws)
        assert (r["doc_id"], n, sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n) in got


def test_quality_model_on_labels(spark):
    base = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = score_quality(df).join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in got) / len(got)
    good = [r["kept"] for r in got if r["quality"]]
    assert right > 0.95 and sum(good) / len(good) > 0.99
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in score_quality(df).filter("kept").collect()}


def test_null_text_is_rejected(spark, docs):
    df, _ = docs
    assert not any(r["kept"] for r in score_quality(df).filter("score = 0").collect())
    assert hashlib.sha256(b"").hexdigest()  # the digest of no spans


def test_short_postings_never_count_too_little(spark):
    """Shingles that agree in all the bits that postings hold, in one set and in two."""
    near = np.array([5 << 24, (5 << 24) + 1, 9 << 40], np.uint64).view(np.int64)
    other = np.array([7 << 24, 8 << 40], np.uint64).view(np.int64)
    batches = [J._posting_batch(list(sets), np.array(nodes)) for sets, nodes in (((near, other), (1, 2)), ((near,), (3,)))]
    assert all(0 <= t < 1 << 41 for b in batches for t in b.column(0).to_pylist() if t is not None)
    rows = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], "token long, node long, c long")
    got = {r["node"]: r["shared"] for r in J._shared_counts(rows).collect()}
    assert got[1] >= 3 and got[3] >= 3 and 2 not in got


def test_repeated_rows_leave_one_set_each(spark, tmp_path):
    spark.createDataFrame([(1, [4], 0), (1, [4], 7), (2, [5], 3), (3, [6], 9), (3, [6], 8)], "node long, set array<long>, place long").write.parquet(f"{tmp_path}/m")
    assert sorted(map(tuple, J.once_each(spark.read.parquet(f"{tmp_path}/m")).collect())) == [(1, [4]), (2, [5]), (3, [6])]


def test_sets_are_not_shuffled_to_thin_them_out(spark):
    sets = spark.createDataFrame([(i, [j << 30 for j in range(i // 2 * 9, i // 2 * 9 + 9)]) for i in range(40)] + [(99, [1 << 60])], "node long, set array<long>")
    thin = J.thin_out(sets, 75)
    assert thin.count() == 40
    assert "SortMergeJoin" not in thin._jdf.queryExecution().toString()
