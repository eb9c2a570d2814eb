"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

# Columns that clash with names used inside the operators.
CLASH = ("k string, h string, n string, size string, node string, region string, shard string, _t string, value string, gk string, gh string, "
         "_source string, _cut string, _epochs string, _times string, _one string, _gone string, _gone_key string, o string, pair string, row string")
DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za".split()


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = []
    while words:
        m = rng.randint(4, 12)
        part, words = words[:m], words[m:]
        out.append(" ".join([part[0].capitalize(), *part[1:]]) + ".")
    return "\n".join(" ".join(out[i:i + 3]) for i in range(0, len(out), 3))


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    return " ".join(w if rng.random() > share else "edit" + str(rng.randint(0, 99)) for w in words)


def documents(spark, n: int = 60, seed: int = 1):
    """Random documents, copies exact and near, junk, nulls, blanks, a long text and repeated rows."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(20, 120)) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "de"]), f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    at = n
    for i in range(0, n, 4):
        for share in (0.0, 0.01, 0.03, 0.08):
            t = edited(rng, texts[i], share)
            rows.append((at, t, "en", "src0", len(t)))
            at += 1
    shared = sentence(rng, 60)
    for i in range(6):
        t = sentence(rng, 90) + "\n" + shared
        rows.append((at, t, "en", "src1", len(t)))
        at += 1
    odd = [None, "", " \n\t ", "one", "one", "two words", "a b c d", "a b c d e", "A B C D E", "é ü ß 漢字   x",
           sentence(rng, 4000), "same " * 300, "x" * 5000, "\x0b\x0c", "Ünïcode space and\rcarriage"]
    rows += [(at + i, t, None if i % 2 else "en", None if i % 3 == 0 else "src2", 0) for i, t in enumerate(odd)]
    rows += [rows[0], rows[0], rows[5], (None, texts[1], "en", None, 5), (None, None, None, None, None), (3, "another text under a known id", "en", "src0", 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), rows


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASH.split(", ")])


def same_rows(a, b) -> bool:
    def key(r):
        return tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
