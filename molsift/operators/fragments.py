"""Cutting molecules into fragments and joining fragments.

Pairs come as a table or from a join on an equality key; nothing here pairs
everything with everything. A fragment is a graph (``atoms``, ``bonds``) with
attachment atoms ``*``; joining, saturating and capping rearrange its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import smiles as S
from ..functions.substructure import CUTS, environments

def cut_bonds(df: DataFrame, alias: str = "cuts") -> DataFrame:
    """The bonds outside rings whose ends lie in environments that may face each other.

    Adds an array of i (place of the bond), a, b, and la and lb, the numbers of
    the environments of its ends; the first rule that fits counts, and no bond
    is cut twice. Bonds are judged on the whole molecule, not one after the other.
    """
    rules = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2 if x == y == 7 else 1).alias("o")) for x, ys in CUTS.items() for y in ys])
    # Environments as bits, and each rule looked up once per bond: only for bonds that a rule may name.
    bits = F.transform("_env", lambda e: F.aggregate(e, F.lit(0), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), x))))
    places = F.transform("bonds", lambda b, i: F.struct(
        i.cast("int").alias("i"), b["a"].alias("a"), b["b"].alias("b"), b["o"].alias("o"), b["ring"].alias("ring"), F.get(F.col("_bits"), b["a"]).alias("ea"), F.get(F.col("_bits"), b["b"]).alias("eb")))

    def face(e: Column, x: Column, f: Column, y: Column) -> Column:
        return F.call_function("shiftright", e, x).bitwiseAND(F.call_function("shiftright", f, y)).bitwiseAND(F.lit(1)) == 1

    def rule(c: Column) -> Column:
        fits = F.filter("_rules", lambda r: (r["o"] == c["o"]) & (face(c["ea"], r["x"], c["eb"], r["y"]) | face(c["ea"], r["y"], c["eb"], r["x"])))
        return F.struct(c.alias("c"), F.get(fits, F.lit(0)).alias("r"))

    def cut(p: Column) -> Column:
        c, r = p["c"], p["r"]
        straight = face(c["ea"], r["x"], c["eb"], r["y"])
        return F.struct(c["i"].alias("i"), c["a"].alias("a"), c["b"].alias("b"), F.when(straight, r["x"]).otherwise(r["y"]).alias("la"), F.when(straight, r["y"]).otherwise(r["x"]).alias("lb"))

    df = S.settled(environments(df, "_env"), _bits=bits)
    df = S.settled(df, _open=F.filter(places, lambda c: ~c["ring"] & (c["ea"] != 0) & (c["eb"] != 0) & c["o"].isin(1, 2)))
    df = S.settled(df.withColumn("_rules", rules), _judged=F.transform("_open", rule))
    return S.settled(df, **{alias: F.transform(F.filter("_judged", lambda p: p["r"].isNotNull()), cut)}).drop("_env", "_bits", "_rules", "_open", "_judged")


def fragment(df: DataFrame) -> DataFrame:
    """One row per fragment of each molecule: the columns of ``df``, n_cuts, and the fragment's own atoms, bonds and nbrs.

    A cut leaves an attachment atom on either side, labelled with the number of
    the environment that it is bonded to. A molecule without cuts is one
    fragment; the atoms of all fragments but for attachments are those of the
    molecule.
    """
    others = [c for c in df.columns if c not in ("atoms", "bonds", "nbrs")]
    df = cut_bonds(df, "_cuts").withColumn("_at", F.transform("_cuts", lambda c: c["i"]))
    kept = F.filter(F.transform("bonds", lambda b, i: F.struct(b.alias("b"), F.array_contains("_at", i.cast("int")).alias("cut"))), lambda x: ~x["cut"])
    df = S.settled(df, _kept=F.transform(kept, lambda x: x["b"]))

    def merge(part: Column, b: Column) -> Column:
        x, y = F.get(part, b["a"]), F.get(part, b["b"])
        return F.transform(part, lambda p: F.when(p == F.greatest(x, y), F.least(x, y)).otherwise(p))

    # The part of each atom: its least atom, after the kept bonds have joined their ends.
    df = S.settled(df, _part=F.aggregate("_kept", F.transform("atoms", lambda a: a["idx"]), merge))
    star = F.element_at("atoms", 1)
    for name, value in {"sym": F.lit("*"), "aromatic": F.lit(False), "charge": F.lit(0), "h": F.lit(0), "bracket": F.lit(True), "donor": F.lit(False),
                        "acceptor": F.lit(False), "ring": F.lit(False), "mass": F.lit(0.0)}.items():
        star = star.withField(name, value)
    n = F.size("atoms")

    def ends(side: str, label: str, shift: int) -> Column:
        """The attachments at one end of the cuts, numbered after the atoms."""
        return F.transform("_cuts", lambda c, k: F.struct(c[side].alias("to"), (n + 2 * k + shift).cast("int").alias("idx"), c[label].alias("label")))

    df = df.withColumn("_ends", F.concat(ends("a", "la", 0), ends("b", "lb", 1)))
    each = df.select(*others, "atoms", "_part", "_kept", "_ends", F.size("_cuts").alias("n_cuts"), F.explode(F.array_distinct("_part")).alias("_p"))

    def mine(v: Column) -> Column:
        return F.get(F.col("_part"), v) == F.col("_p")

    hands = F.filter("_ends", lambda e: mine(e["to"]))
    atoms = F.concat(F.filter("atoms", lambda a: mine(a["idx"])), F.transform(hands, lambda e: star.withField("idx", e["idx"]).withField("label", e["label"])))
    links = F.transform(hands, lambda e: F.struct(e["to"].alias("a"), e["idx"].alias("b"), F.lit(1).alias("o"), F.lit(False).alias("ring")))
    bonds = F.concat(F.filter("_kept", lambda b: mine(b["a"])), links)
    out = S.settled(each, _new_atoms=atoms, _new_bonds=bonds)
    return renumber(out.select(*others, "n_cuts", F.col("_new_atoms").alias("atoms"), F.col("_new_bonds").alias("bonds")))


def attachment_labels(atoms: str = "atoms") -> Column:
    """The labels of the attachment atoms, in order of size."""
    return F.array_sort(F.transform(F.filter(atoms, lambda a: a["sym"] == "*"), lambda a: a["label"]))


def fragment_text(atoms: str = "atoms") -> Column:
    """A fragment in words: its formula and the labels of its attachments."""
    labels = attachment_labels(atoms)
    return F.concat(S.formula(atoms), F.when(F.size(labels) > 0, F.concat(F.lit("|"), F.array_join(labels.cast("array<string>"), ","))).otherwise(""))


def distinct_fragments(df: DataFrame, key: str) -> DataFrame:
    """One row per molecule (``key``) and distinct fragment: frag_key (its identity), fragment (in words), n_cuts.

    The same fragment of two molecules stays twice.
    """
    each = S.identity_key(fragment(df), "frag_key").select(key, "n_cuts", "frag_key", fragment_text().alias("fragment"))
    return each.groupBy(key, "frag_key").agg(F.first("n_cuts").alias("n_cuts"), F.first("fragment").alias("fragment"))


def pair_attachments(pairs: DataFrame, left: str = "att_a", right: str = "att_b") -> DataFrame:
    """D3: inside each given pair, every attachment of one side with every one of the other.

    The arrays are those of one pair of fragments; a side without attachments drops out.
    """
    return pairs.withColumn("i", F.explode(left)).withColumn("j", F.explode(right))


def estimate_pairs(a: DataFrame, b: DataFrame, n: str = "n_att") -> DataFrame:
    """How many attachment pairs all of ``a`` with all of ``b`` would give, without making them."""
    total_a = a.agg(F.sum(F.col(n).cast("long")).alias("x"))
    return b.agg(F.sum(F.col(n).cast("long")).alias("y")).select((F.col("y") * total_a.select("x").scalar()).alias("n_pairs"))


def _placed(atoms: Column, gone: Column, offset: Column) -> Column:
    """Atoms without ``gone`` under their new numbers."""
    return F.transform(F.filter(atoms, lambda a: a["idx"] != gone), lambda a: a.withField("idx", _new(a["idx"], gone, offset)))


def _new(idx: Column, gone: Column, offset: Column) -> Column:
    return (idx - F.when(idx > gone, 1).otherwise(0) + offset).cast("int")


def _kept(bonds: Column, gone: Column, offset: Column) -> Column:
    left = F.filter(bonds, lambda b: (b["a"] != gone) & (b["b"] != gone))
    return F.transform(left, lambda b: b.withField("a", _new(b["a"], gone, offset)).withField("b", _new(b["b"], gone, offset)))


def _neighbour(bonds: Column, at: Column) -> Column:
    bond = F.get(F.filter(bonds, lambda b: (b["a"] == at) | (b["b"] == at)), F.lit(0))
    return F.when(bond["a"] == at, bond["b"]).otherwise(bond["a"])


def assemble(df: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """C14: bond fragment a (atoms_a, bonds_a) at its attachment ``i`` to b at ``j``: atoms, bonds.

    Both attachment atoms vanish; their neighbours are bonded. Atoms of b follow those of a.
    """
    ci, cj, zero = F.col(i), F.col(j), F.lit(0)
    shift = F.size("atoms_a") - 1
    link = F.struct(_new(_neighbour(F.col("bonds_a"), ci), ci, zero).alias("a"), _new(_neighbour(F.col("bonds_b"), cj), cj, shift).alias("b"),
                    F.lit(1).alias("o"), F.lit(False).alias("ring"))
    return (df.withColumn("atoms", F.concat(_placed(F.col("atoms_a"), ci, zero), _placed(F.col("atoms_b"), cj, shift)))
            .withColumn("bonds", F.concat(_kept(F.col("bonds_a"), ci, zero), _kept(F.col("bonds_b"), cj, shift), F.array(link))))


def saturate(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """Drop every attachment but the one at ``keep``; its neighbour gains a hydrogen.

    Numbers of atoms stay, so a kept attachment is found where it was.
    """
    gone = F.transform(F.filter("atoms", lambda a: (a["sym"] == "*") & (F.lit(True) if keep is None else a["idx"] != keep)), lambda a: a["idx"])
    df = df.withColumn("_gone", gone).withColumn("_fed", F.transform("_gone", lambda g: _neighbour(F.col("bonds"), g)))
    atoms = F.transform(F.filter("atoms", lambda a: ~F.array_contains("_gone", a["idx"])), lambda a: a.withField(
        "h", (a["h"] + F.size(F.filter("_fed", lambda f: f == a["idx"]))).cast("int")))
    bonds = F.filter("bonds", lambda b: ~F.array_contains("_gone", b["a"]) & ~F.array_contains("_gone", b["b"]))
    return df.withColumns({"atoms": atoms, "bonds": bonds}).drop("_gone", "_fed")


def assemble_first(df: DataFrame) -> DataFrame:
    """Join a and b at their first attachments; all others are dropped with their bonds."""
    first = [F.get(S.attachment_positions(f"atoms_{s}"), F.lit(0)) for s in "ab"]
    both = df.withColumns({"i": first[0], "j": first[1]}).where("i is not null and j is not null")
    joined = assemble(both).drop("i", "j")
    gone = S.attachment_positions("atoms")
    return (joined.withColumn("_gone", gone)
            .withColumn("bonds", F.filter("bonds", lambda b: ~F.array_contains("_gone", b["a"]) & ~F.array_contains("_gone", b["b"])))
            .withColumn("atoms", F.filter("atoms", lambda a: a["sym"] != "*")).drop("_gone"))


def cap_vinyl(df: DataFrame) -> DataFrame:
    """C17: for each attachment left, one row with C=C in its place and all others saturated."""
    each = df.withColumn("k", F.explode(S.attachment_positions("atoms")))
    one = saturate(each, F.col("k"))
    last = F.array_max(F.transform("atoms", lambda a: a["idx"])) + 1
    one = one.withColumn("_end", last.cast("int"))
    carbon = F.element_at(F.col("atoms"), 1)
    plain = {"sym": F.lit("C"), "aromatic": F.lit(False), "charge": F.lit(0), "label": F.lit(None).cast("int"), "bracket": F.lit(False),
             "donor": F.lit(False), "acceptor": F.lit(False), "ring": F.lit(False), "mass": F.lit(S.ATOMIC_MASS["C"])}

    def as_carbon(a, idx, h):
        for name, value in plain.items():
            a = a.withField(name, value)
        return a.withField("idx", idx).withField("h", F.lit(h))

    atoms = F.concat(F.transform("atoms", lambda a: F.when(a["idx"] == F.col("k"), as_carbon(a, a["idx"], 1)).otherwise(a)),
                     F.array(as_carbon(carbon, F.col("_end"), 2)))
    double = F.struct(F.col("k").cast("int").alias("a"), F.col("_end").alias("b"), F.lit(2).alias("o"), F.lit(False).alias("ring"))
    return one.withColumns({"atoms": atoms, "bonds": F.concat("bonds", F.array(double))}).drop("_end")


def renumber(df: DataFrame) -> DataFrame:
    """Give atoms dense numbers again and rebuild ``nbrs``, as keys and fingerprints need them."""
    keep = [c for c in df.columns if c not in ("atoms", "bonds", "nbrs")]
    df = S.settled(df, _order=F.transform("atoms", lambda a: a["idx"]))

    def place(v):
        return (F.array_position("_order", v) - 1).cast("int")

    df = S.settled(df, _new_bonds=F.transform("bonds", lambda b: b.withField("a", place(b["a"])).withField("b", place(b["b"]))),
                   _new_atoms=F.transform("atoms", lambda a, i: a.withField("idx", i.cast("int"))))
    around = F.transform("_new_atoms", lambda a: F.transform(F.filter("_new_bonds", lambda b: (b["a"] == a["idx"]) | (b["b"] == a["idx"])), lambda b: F.struct(
        F.when(b["a"] == a["idx"], b["b"]).otherwise(b["a"]).alias("j"), b["o"].alias("o"))))
    return S.settled(df, _new_nbrs=around).select(*keep, *[F.col(f"_new_{c}").alias(c) for c in ("atoms", "bonds", "nbrs")])


def distinct_products(df: DataFrame) -> DataFrame:
    """H2: one row per distinct product by identity key, over all pairs."""
    return S.identity_key(renumber(df)).dropDuplicates(["mol_key"])


def augment(df: DataFrame, k: int = 4) -> DataFrame:
    """``k`` numbered copies of each molecule; graph features do not depend on the writing."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

