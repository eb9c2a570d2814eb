"""Operator 1: personal data by exact base rules and weak supervision."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molsift.session import materialise

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and the look-behinds keep
# a scan linear in the text; they change no match. A match can begin inside a
# run of local-part characters only where the match before it ended (\G).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns give candidates that the base rules do not see.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
# What a text must hold for a pattern to have a chance; a cheap test before it.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][ .-]?[0-9]", "phone": r"\+[0-9]|[0-9][ .-][0-9]"}

# Gazetteers of the gazetteer labeller and cue words of the context labeller.
TOP_DOMAINS = "com org net edu gov mil int info biz io de fr es uk it nl ch at eu us ca au jp cn in br ru"
CARD_PREFIXES = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CUES = {"email": "e-?mail|mailto|contact|write to|reach", "ip": r"\bip\b|address|host|server|login from",
        "card": "card|visa|mastercard|amex|payment|account", "phone": "phone|tel|call|fax|mobile|cell|whatsapp"}
COUNTER_CUES = "isbn|version|order no|invoice|section|figure|article no|patent"

LABELLERS = ("pattern", "gazetteer", "context", "shape")
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _found(pattern: str, needs: str) -> str:
    """SQL: matches of ``pattern`` in _t as structs (s, e, m); s and e count code points."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    needs = needs.replace("\\", "\\\\").replace("'", "\\'")
    return f"""if(_t rlike '{needs}', aggregate(
        arrays_zip(split(_t, '{quoted}', -1), regexp_extract_all(_t, '{quoted}', 0)),
        named_struct('o', 0, 'a', cast(array() as array<struct<s: int, e: int, m: string>>)),
        (x, y) -> named_struct('o', x.o + length(y.`0`) + coalesce(length(y.`1`), 0),
            'a', if(y.`1` is null, x.a, concat(x.a, array(named_struct('s', x.o + length(y.`0`),
                'e', x.o + length(y.`0`) + length(y.`1`), 'm', y.`1`)))))).a,
        cast(array() as array<struct<s: int, e: int, m: string>>))"""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)

    def add(total, i):
        x = F.substring(d, -i, 1).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check of the base rules on a match."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & _luhn(m)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _votes(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """1 for, 0 against, -1 no opinion, in the order of LABELLERS."""
    n = F.length(_digits(m))
    strict = {"email": m.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"),
              "ip": valid("ip", m) | m.rlike("^[0-9A-Fa-f:]+$"), "card": n.between(15, 19) & _luhn(m),
              "phone": n.between(8, 15) & m.startswith("+")}[kind]
    known = {"email": F.regexp_extract(F.lower(m), "([a-z]+)$", 1).isin(TOP_DOMAINS.split()),
             "ip": ~m.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\."), "card": _digits(m).rlike(CARD_PREFIXES),
             "phone": ~_digits(m).rlike(r"^[01]{3}|^(.)\1{6}")}[kind]
    cue = F.lower(before)
    context = F.when(cue.rlike(COUNTER_CUES), 0).when(cue.rlike(CUES[kind]), 1).otherwise(-1)
    apart = ~before.rlike("[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_@]")
    return [strict.cast("int"), known.cast("int"), context, apart.cast("int")]


def spans_of(docs: DataFrame, key: str, text: str, reach: int = 40) -> DataFrame:
    """``k``, base (spans of the base rules) and cands (all candidates with their votes) of every row."""
    d = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("_t"))
    d = d.withColumn("_t", F.when(F.col("_t").rlike(r"[0-9@]|[(\[]at[)\]]"), F.col("_t")).otherwise(""))
    for kind in KINDS:
        d = d.withColumn(f"_{kind}", F.expr(_found(BASE[kind], NEEDS[kind])))
        d = d.withColumn(f"_w{kind}", F.expr(_found(WIDE[kind], NEEDS[kind])))

    def candidate(no, kind):
        def make(x):
            before = F.substring(F.col("_t"), F.greatest(x.s - reach, F.lit(0)) + 1, F.least(x.s, F.lit(reach)))
            after = F.substring(F.col("_t"), x.e + 1, F.lit(1))
            votes = _votes(kind, x.m, before, after)
            return F.struct(F.lit(no).alias("kind"), x.s.alias("s"), x.e.alias("e"),
                            *[v.alias(n) for v, n in zip(votes, LABELLERS)],
                            F.least(F.length(x.m), F.lit(39)).alias("size"))
        return make

    def checked(kind):
        return lambda x: valid(kind, x.m)

    def placed(no):
        return lambda x: F.struct(F.lit(no).alias("kind"), x.s.alias("s"), x.e.alias("e"))

    base, cands = [], []
    for no, kind in enumerate(KINDS):
        base.append(F.transform(F.filter(f"_{kind}", checked(kind)), placed(no)))
        both = F.array_distinct(F.concat(f"_{kind}", f"_w{kind}")) if kind != "email" else F.concat(f"_{kind}", F.filter(
            "_wemail", lambda x: ~x.m.rlike(r"@[A-Za-z0-9-]+\.")))
        cands.append(F.transform(both, candidate(no, kind)))
    return d.select("k", F.concat(*base).alias("base"), F.concat(*cands).alias("cands"))


def fit(counts: list[tuple], rounds: int = 30, steps: int = 200) -> dict[int, list[float]]:
    """Weights of the span classifier of each kind, from counts of vote patterns.

    ``counts`` holds (kind, votes..., size class, n); there are at most
    4 kinds * 3^4 patterns * 5 size classes of them, whatever the corpus.
    Expectation-maximisation estimates how often each labeller is right on true
    and on false spans; a logistic model of votes and size is then trained on
    the posteriors. A prior of some spans keeps labellers better than chance
    and keeps kinds without candidates defined.
    """
    weights = {}
    for kind in range(len(KINDS)):
        rows = [(c[1:1 + len(LABELLERS)], c[-2], c[-1]) for c in counts if c[0] == kind]
        right, wrong, share = [0.8] * len(LABELLERS), [0.3] * len(LABELLERS), 0.5
        post: list[float] = []
        for _ in range(rounds):
            post = []
            for votes, _, _ in rows:
                logit = math.log(share / (1 - share))
                for j, v in enumerate(votes):
                    if v >= 0:
                        logit += math.log(right[j] / wrong[j] if v else (1 - right[j]) / (1 - wrong[j]))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
            for j in range(len(LABELLERS)):
                t = [(p * n, v) for p, (votes, _, n) in zip(post, rows) if (v := votes[j]) >= 0]
                f = [((1 - p) * n, v) for p, (votes, _, n) in zip(post, rows) if (v := votes[j]) >= 0]
                right[j] = (16 + sum(a * v for a, v in t)) / (20 + sum(a for a, _ in t))
                wrong[j] = (6 + sum(a * v for a, v in f)) / (20 + sum(a for a, _ in f))
                right[j] = max(right[j], wrong[j] + 0.01) if wrong[j] < 0.98 else right[j]
            share = (5 + sum(p * n for p, (_, _, n) in zip(post, rows))) / (10 + sum(n for _, _, n in rows))
        data = [([1.0] + [(2 * v - 1.0) if v >= 0 else 0.0 for v in votes] + [size / 4], p, n)
                for (votes, size, n), p in zip(rows, post)]
        # The prior again: one span with all labellers for it, one with all against.
        data += [([1.0] + [1.0] * len(LABELLERS) + [0.5], 1.0, 5), ([1.0] + [-1.0] * len(LABELLERS) + [0.5], 0.0, 5)]
        total = sum(n for _, _, n in data)
        w = [0.0] * (len(LABELLERS) + 2)
        for _ in range(steps):
            grad = [0.001 * x for x in w]
            for x, p, n in data:
                q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
                for i, a in enumerate(x):
                    grad[i] += n / total * (q - p) * a
            w = [a - 2.0 * g for a, g in zip(w, grad)]
        weights[kind] = w
    return weights


def _size_class(size: Column) -> Column:
    return F.floor(size / 8).cast("int")


def detect_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every text.

    Returns one row per input row: ``key``, base and spans, arrays of (kind,
    s, e) in code points, kind a place in KINDS, sorted by kind and start. The
    base spans are those of the fixed rules. Pattern, gazetteer, context and
    shape labellers vote on all candidates, base and wider ones;
    expectation-maximisation over the counts of vote patterns estimates how
    reliable they are, and a classifier trained on its posteriors adds
    candidates that touch no base span. Base spans always stay.

    The texts are read once; what is kept of them are spans and votes. Only
    counts of vote patterns, bounded in number, reach the driver.

    Null and empty texts have no spans; null and repeated keys are rows like
    any other; an empty table gives no rows; overlapping added spans give way
    to the first by start, then kind. Other columns are not read.
    """
    found = materialise(spans_of(docs, key, text), "pii-spans")
    flat = found.select(F.explode("cands").alias("c")).select("c.*")
    counts = flat.groupBy("kind", *LABELLERS, _size_class(F.col("size")).alias("size")).count().collect()
    weights = fit(sorted(tuple(c) for c in counts))

    def accepted(x):
        score = F.lit(0.0)
        for kind, w in weights.items():
            z = F.lit(w[0])
            for j, name in enumerate(LABELLERS):
                z = z + F.when(x[name] >= 0, (2 * x[name] - 1) * F.lit(w[1 + j])).otherwise(0.0)
            score = F.when(x.kind == kind, z + _size_class(x["size"]) / 4 * F.lit(w[-1])).otherwise(score)
        return score > 0

    # A kept candidate must be a form of its kind at all: the strict pattern, or a wide one.
    more = F.filter("cands", lambda x: (x["shape"] == 1) & accepted(x) & ~F.exists("base", lambda b: (b.s < x.e) & (x.s < b.e)))
    found = found.withColumn("more", F.sort_array(F.transform(more, lambda x: F.struct(x.s.alias("s"), x.kind.alias("kind"), x.e.alias("e")))))
    found = found.withColumn("more", F.expr("""aggregate(more, cast(array() as array<struct<kind: int, s: int, e: int>>),
        (a, x) -> if(size(a) > 0 and element_at(a, -1).e > x.s, a, concat(a, array(named_struct('kind', x.kind, 's', x.s, 'e', x.e)))))"""))
    return found.select(F.col("k").alias(key), "base", F.sort_array(F.concat("base", "more")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x.kind + 1), x.s.cast("string"), x.e.cast("string"))), ",")
