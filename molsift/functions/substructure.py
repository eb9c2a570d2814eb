"""Patterns over atoms and their surroundings.

``surroundings`` lays out, for every atom, its own marks, its neighbours with
the bonds to them, and theirs in turn. A pattern is a test of one such entry: a
centre and how many neighbours of which kind it has, two bonds deep at most.
Everything is column expressions, local to the row.

Hydrogens that are written as atoms count as hydrogens of their neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .smiles import settled

SINGLE, DOUBLE, TRIPLE, AROMATIC = 1, 2, 3, 5
Test = Callable[[Column], Column]


def surroundings(df: DataFrame, alias: str = "around") -> DataFrame:
    """Add an array with an entry per atom: sym, aromatic, charge, ring, h, deg and near.

    ``near`` has an entry per neighbour but hydrogens: j, o and in_ring of the
    bond, the same marks, and ``far``, its neighbours but for the centre.
    """
    atoms, nbrs = F.col("atoms"), F.col("nbrs")
    rings = F.transform(F.filter("bonds", lambda b: b["ring"]), lambda b: F.struct(F.least(b["a"], b["b"]).alias("a"), F.greatest(b["a"], b["b"]).alias("b")))
    df = settled(df, _rings=rings)

    def marks(i: Column) -> list[Column]:
        a = F.get(atoms, i)
        heavy = F.filter(F.get(nbrs, i), lambda n: F.get(atoms, n["j"])["sym"] != "H")
        return [a["sym"].alias("sym"), a["aromatic"].alias("aromatic"), a["charge"].alias("charge"), a["ring"].alias("ring"),
                (a["h"] + F.size(F.get(nbrs, i)) - F.size(heavy)).alias("h"), F.size(heavy).alias("deg")]

    def bond(i: Column, n: Column) -> list[Column]:
        pair = F.struct(F.least(i, n["j"]).alias("a"), F.greatest(i, n["j"]).alias("b"))
        return [n["j"].alias("j"), n["o"].alias("o"), F.array_contains("_rings", pair).alias("in_ring")]

    one = F.transform(atoms, lambda a: F.struct(*marks(a["idx"]), F.transform(F.filter(
        F.get(nbrs, a["idx"]), lambda n: F.get(atoms, n["j"])["sym"] != "H"), lambda n: F.struct(*bond(a["idx"], n))).alias("near")))
    df = settled(df, _one=one)
    two = F.transform("_one", lambda e, i: e.withField("near", F.transform(e["near"], lambda n: F.struct(
        *[n[c].alias(c) for c in ("j", "o", "in_ring")],
        *[F.get(F.col("_one"), n["j"])[c].alias(c) for c in ("sym", "aromatic", "charge", "ring", "h", "deg")],
        F.transform(F.filter(F.get(F.col("_one"), n["j"])["near"], lambda m: m["j"] != i.cast("int")), lambda m: F.struct(
            m["o"].alias("o"), m["in_ring"].alias("in_ring"),
            *[F.get(F.col("_one"), m["j"])[c].alias(c) for c in ("sym", "aromatic", "charge", "ring", "h", "deg")])).alias("far")))))
    return settled(df, **{alias: two}).drop("_rings", "_one")


def both(*tests: Test) -> Test:
    """All of the tests."""
    def run(e: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t(e)
        return out
    return run


def either(*tests: Test) -> Test:
    def run(e: Column) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t(e)
        return out
    return run


def no(test: Test) -> Test:
    return lambda e: ~test(e)


def atom(symbols: str = "", aromatic: bool | None = None, ring: bool | None = None, h: int | tuple | None = None, deg: int | tuple | None = None,
         charge: Callable[[Column], Column] | None = None, besides: str = "") -> Test:
    """An atom of one of ``symbols`` (any, if empty) and none of ``besides``, with the given marks."""
    def run(e: Column) -> Column:
        out = F.lit(True)
        if symbols:
            out = out & e["sym"].isin(symbols.split())
        if besides:
            out = out & ~e["sym"].isin(besides.split())
        for name, want in (("aromatic", aromatic), ("ring", ring)):
            if want is not None:
                out = out & (e[name] == want)
        for name, want in (("h", h), ("deg", deg)):
            if want is not None:
                out = out & e[name].isin(*([want] if isinstance(want, int) else want))
        return out & charge(e["charge"]) if charge else out
    return run


def bound(orders: tuple | int | None = None, in_ring: bool | None = None) -> Test:
    """A neighbour's bond: of one of the orders, in a ring or not."""
    def run(n: Column) -> Column:
        out = F.lit(True)
        if orders is not None:
            out = out & n["o"].isin(*([orders] if isinstance(orders, int) else orders))
        return out & (n["in_ring"] == in_ring) if in_ring is not None else out
    return run


def near(*tests: Test, least: int = 1) -> Test:
    """At least so many neighbours that pass all tests."""
    return lambda e: F.size(F.filter(e["near"], both(*tests))) >= least


def far(*tests: Test, least: int = 1) -> Test:
    """The same of a neighbour's other neighbours."""
    return lambda n: F.size(F.filter(n["far"], both(*tests))) >= least


PLAIN = bound((SINGLE, AROMATIC))  # a bond that a pattern does not name

# The sixteen published environments for cutting molecules (Degen
# et al., ChemMedChem 3, 1503), and which two may face each other across a
# single bond outside rings; 7 faces 7 across a double bond.
_O2 = near(bound(DOUBLE), atom("O", False))
ENVIRONMENTS: dict[int, Test] = {
    1: both(atom("C", False, deg=3), _O2, near(PLAIN, atom("* C N O"))),
    3: both(atom("O", False, deg=2), near(bound(SINGLE, False), atom("* C"))),
    4: both(atom("C", False), no(atom(deg=1)), no(near(bound(DOUBLE))), near(bound(SINGLE, False), atom("C"))),
    5: both(atom("N", False), no(atom(deg=1)), no(near(bound(DOUBLE))), no(near(bound(SINGLE), atom(besides="C S *"))),
            no(both(atom(ring=True), near(bound(None, True), atom("C", False, True), far(bound(DOUBLE), atom("O", False)))))),
    6: both(atom("C", False, False, deg=3), _O2, near(bound(SINGLE, False), atom("* C N O"))),
    7: both(atom("C", False, deg=(2, 3)), near(bound(SINGLE), atom("C"))),
    8: both(atom("C", False, False), no(atom(deg=1)), no(near(bound((DOUBLE, TRIPLE, 4, AROMATIC))))),
    9: both(atom("N", True, charge=lambda c: c == 0), near(bound(AROMATIC), atom("C N O S", True), least=2)),
    10: both(atom("N", False, True), near(bound(None, True), atom("C", False), far(bound(DOUBLE), atom("O", False))), near(bound(None, True), atom("C N O S", False), least=2)),
    11: both(atom("S", False, deg=2), near(bound(SINGLE, False), atom("* C"))),
    12: both(atom("S", False, deg=4), near(bound(DOUBLE), atom("O", False), least=2), near(PLAIN, atom("* C"))),
    13: both(atom("C", False), near(bound(SINGLE, True), atom("C N O S", False), least=2), near(bound(SINGLE, True), atom("N O S", False))),
    14: both(atom("C", True), near(bound(AROMATIC), atom("C N O S", True), least=2), near(bound(AROMATIC), atom("N O S", True))),
    15: both(atom("C", False), near(bound(SINGLE, True), atom("C", False), least=2)),
    16: both(atom("C", True), near(bound(AROMATIC), atom("C", True), least=2)),
}
CUTS = {1: (3, 5, 10), 3: (4, 13, 14, 15, 16), 4: (5, 11), 5: (12, 14, 16, 13, 15), 6: (13, 14, 15, 16), 7: (7,), 8: (9, 10, 13, 14, 15, 16),
        9: (13, 14, 15, 16), 10: (13, 14, 15, 16), 11: (13, 14, 15, 16), 13: (14, 15, 16), 14: (14, 15, 16), 15: (16,), 16: (16,)}

# The published atom types of the octanol-water partition (Wildman
# and Crippen, J. Chem. Inf. Comput. Sci. 39, 868) with what each adds; an atom
# has the first type that fits.
_A = atom(besides="H", aromatic=False)  # any that is not aromatic
_ANY, _AR, _HALO = atom(besides="H"), atom(aromatic=True), "N O P S F Cl Br I"
_ODD = "C N O P S F Cl Br I H"
_C, _c, _N, _O = atom("C", False), atom("C", True), atom("N", False), atom("O", False)
_neutral, _plus, _minus = (lambda c: c == 0), (lambda c: c > 0), (lambda c: c < 0)


def _sp3(e: Column) -> Column:
    return e["h"] + e["deg"] == 4


def _ch(n: int) -> Test:
    return both(atom("C", False, h=n), _sp3)


_RING = both(_c, near(bound(AROMATIC), _AR, least=2))
_TO = near(PLAIN, atom(_HALO, False))
CARBON: list[tuple[str, float, Test]] = [
    ("C1", 0.1441, atom("C", False, h=4)), ("C1", 0.1441, both(atom("C", False, h=3), near(PLAIN, _C))),
    ("C1", 0.1441, both(atom("C", False, h=2), near(PLAIN, _C, least=2))),
    ("C2", 0.0, both(atom("C", False, h=1), near(PLAIN, _C, least=3))), ("C2", 0.0, both(_C, near(PLAIN, _C, least=4))),
    ("C3", -0.2035, both(atom("C", False, h=3), _TO)), ("C3", -0.2035, both(_ch(2), _TO, near(PLAIN, _A, least=2))),
    ("C4", -0.2051, both(_ch(1), _TO, near(PLAIN, _A, least=3))), ("C4", -0.2051, both(_ch(0), _TO, near(PLAIN, _A, least=4))),
    ("C5", -0.2783, both(_C, near(bound(DOUBLE), _A, no(_C)))),
    ("C6", 0.1551, both(atom("C", False, h=2), near(bound(DOUBLE), _C))), ("C6", 0.1551, both(atom("C", False, h=1), near(bound(DOUBLE), _C), near(PLAIN, _A))),
    ("C6", 0.1551, both(atom("C", False, h=0), near(bound(DOUBLE), _C), near(PLAIN, _A, least=2))), ("C6", 0.1551, both(_C, near(bound(DOUBLE), _C, least=2))),
    ("C7", 0.0017, both(_C, lambda e: e["h"] + e["deg"] == 2, near(bound(TRIPLE), _A))),
    ("C8", 0.08452, both(atom("C", False, h=3), near(PLAIN, _c))), ("C9", -0.1444, both(atom("C", False, h=3), near(PLAIN, _AR))),
    ("C10", -0.0516, both(_ch(2), near(PLAIN, _AR))), ("C11", 0.1193, both(_ch(1), near(PLAIN, _AR))), ("C12", -0.0967, both(_ch(0), near(PLAIN, _AR))),
    ("C13", -0.5443, both(atom("C", True, h=0), near(bound(SINGLE), _A, atom(besides=_ODD)))),
    ("C14", 0.0, both(_c, near(PLAIN, atom("F")))), ("C15", 0.2450, both(_c, near(PLAIN, atom("Cl")))),
    ("C16", 0.1980, both(_c, near(PLAIN, atom("Br")))), ("C17", 0.0, both(_c, near(PLAIN, atom("I")))),
    ("C18", 0.1581, atom("C", True, h=1)), ("C19", 0.2955, both(_c, near(bound(AROMATIC), _AR, least=3))),
    ("C20", 0.2713, both(_RING, near(bound(SINGLE), _AR))), ("C21", 0.1360, both(_RING, near(bound(SINGLE), _C))),
    ("C22", 0.4619, both(_RING, near(bound(SINGLE), _N))), ("C23", 0.5437, both(_RING, near(bound(SINGLE), _O))),
    ("C24", 0.1893, both(_RING, near(bound(SINGLE), atom("S", False)))), ("C25", -0.8186, both(_RING, near(bound(DOUBLE), atom("C N O", False)))),
    ("C26", 0.2640, both(_C, near(bound(DOUBLE), _C), near(PLAIN, _AR), near(PLAIN, _ANY, least=2))),
    ("C26", 0.2640, both(atom("C", False, h=1), near(bound(DOUBLE), _C), near(PLAIN, _AR))), ("C26", 0.2640, both(_C, near(bound(DOUBLE), _c))),
    ("C27", 0.2148, both(_C, _sp3, near(PLAIN, _A, atom(besides=_ODD)))), ("CS", 0.08129, atom("C"))]
NITROGEN: list[tuple[str, float, Test]] = [
    ("N1", -1.0190, both(atom("N", False, h=2, charge=_neutral), near(PLAIN, _A))),
    ("N2", -0.7096, both(atom("N", False, h=1, charge=_neutral), near(PLAIN, _A, least=2))),
    ("N3", -1.0270, both(atom("N", False, h=2, charge=_neutral), near(PLAIN, _AR))),
    ("N4", -0.5188, both(atom("N", False, h=1, charge=_neutral), near(PLAIN, _AR), near(PLAIN, _ANY, least=2))),
    ("N5", 0.08387, both(atom("N", False, h=1, charge=_neutral), near(bound(DOUBLE), _ANY))),
    ("N6", 0.1836, both(atom("N", False, charge=_neutral), near(bound(DOUBLE), _ANY), near(PLAIN, _ANY))),
    ("N7", -0.3187, both(atom("N", False, charge=_neutral), near(PLAIN, _A, least=3))),
    ("N8", -0.4458, both(atom("N", False, charge=_neutral), near(PLAIN, _AR), near(PLAIN, _ANY, least=3))),
    ("N9", 0.01508, both(atom("N", False, charge=_neutral), near(bound(TRIPLE), _A))),
    ("N10", -1.950, atom("N", False, h=(1, 2, 3), charge=_plus)), ("N11", -0.3239, atom("N", True, charge=_neutral)), ("N12", -1.119, atom("N", True, charge=_plus)),
    ("N13", -0.3396, both(atom("N", False, h=0, charge=_plus), near(PLAIN, _A, least=4))),
    ("N13", -0.3396, both(atom("N", False, h=0, charge=_plus), near(bound(DOUBLE), _A), near(PLAIN, _A), near(PLAIN, _ANY, least=2))),
    ("N13", -0.3396, both(atom("N", False, h=0, charge=_plus), near(bound(DOUBLE), atom("C")), near(bound(DOUBLE), atom("N")))),
    ("N14", 0.2887, both(atom("N", False, charge=_plus), near(bound(TRIPLE), _A))), ("N14", 0.2887, atom("N", False, charge=_minus)),
    ("N14", 0.2887, both(atom("N", False, charge=_plus), near(bound(DOUBLE), atom("N", False, charge=_minus)), near(bound(DOUBLE), atom("N", False), least=2))),
    ("NS", -0.4806, atom("N"))]
_ACYL = near(bound(DOUBLE), _C, far(PLAIN, _C), far(PLAIN, _A, least=2))
OXYGEN: list[tuple[str, float, Test]] = [
    ("O1", 0.1552, atom("O", True)), ("O2", -0.2893, atom("O", False, h=(1, 2))),
    ("O3", -0.0684, both(_O, near(PLAIN, _A, least=2))), ("O4", -0.4195, both(_O, near(PLAIN, _AR), near(PLAIN, _ANY, least=2))),
    ("O5", 0.0335, both(_O, near(bound(DOUBLE), atom("N O")))), ("O5", 0.0335, both(atom("O", False, deg=1, h=0, charge=_minus), near(PLAIN, atom("N")))),
    ("O6", -0.3339, both(atom("O", False, deg=1, h=0, charge=_minus), near(PLAIN, atom("S")))),
    ("O6", -0.3339, both(atom("O", False, charge=_neutral), near(bound(DOUBLE), atom("S", charge=_neutral)))),
    ("O12", -1.326, both(atom("O", False, charge=lambda c: c == -1), near(PLAIN, _C, far(bound(DOUBLE), _O)))),
    ("O7", -1.189, both(atom("O", False, deg=1, h=0, charge=_minus), near(PLAIN, atom(besides="H N S")))),
    ("O8", 0.1788, both(_O, near(bound(DOUBLE), _c))),
    ("O9", -0.1526, both(_O, near(bound(DOUBLE), atom("C", False, h=1), far(PLAIN, _C)))), ("O9", -0.1526, both(_O, _ACYL)),
    ("O9", -0.1526, both(_O, near(bound(DOUBLE), atom("C", False, h=1), far(PLAIN, atom("N O", False))))), ("O9", -0.1526, both(_O, near(bound(DOUBLE), atom("C", False, h=2)))),
    ("O9", -0.1526, both(_O, near(bound(DOUBLE), atom("C", False, deg=2, h=0), far(bound(DOUBLE), _O)))),
    ("O10", 0.1129, both(_O, near(bound(DOUBLE), atom("C", False, h=1), far(PLAIN, _c)))),
    ("O10", 0.1129, both(_O, near(bound(DOUBLE), _C, far(PLAIN, atom("C")), far(PLAIN, _AR), far(PLAIN, _ANY, least=2)))),
    ("O10", 0.1129, both(_O, near(bound(DOUBLE), _C, far(PLAIN, _c), far(PLAIN, _A)))),
    ("O11", 0.4833, both(_O, near(bound(DOUBLE), _C, far(PLAIN, atom(besides="H C"), least=2)))), ("OS", -0.1188, atom("O"))]
OTHERS: list[tuple[str, float, Test]] = [
    ("F", 0.4202, atom("F", charge=_neutral)), ("Cl", 0.6895, atom("Cl", charge=_neutral)), ("Br", 0.8456, atom("Br", charge=_neutral)),
    ("I", 0.8857, atom("I", charge=_neutral)), ("Hal", -2.996, atom("F Cl Br I")), ("P", 0.8612, atom("P")),
    ("S2", -0.0024, atom("S", False, charge=lambda c: c != 0)), ("S2", -0.0024, both(atom("S", False), near(bound(DOUBLE), atom("N O P S", False)))),
    ("S1", 0.6482, atom("S", False)), ("S3", 0.6237, atom("S", True)),
    ("Me1", -0.3808, atom("Li Na K Rb Cs Be Mg Ca Sr Ba B Al Ga In Tl Si Ge Sn Pb As Sb Bi Se Te")), ("Me2", -0.0025, atom(
        "Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Ru Rh Pd Ag Cd W Re Os Ir Pt Au Hg"))]
# What the hydrogens of an atom add: the first that fits their atom.
HYDROGEN: list[tuple[str, float, Test]] = [
    ("H1", 0.1230, atom("C")), ("H2", -0.2677, both(_O, either(near(both(_C, lambda n: n["h"] + n["deg"] == 4)), near(_c)))),
    ("H2", -0.2677, both(_O, either(near(atom(besides="H C N O S")), lambda e: e["h"] > 1))), ("H3", 0.2142, atom("N")), ("H3", 0.2142, both(_O, near(atom("N")))),
    ("H4", 0.2980, both(_O, near(_C, far(bound(DOUBLE), either(atom("C N"), atom("O S", False)))))), ("H4", 0.2980, both(_O, near(atom("O S", False)))),
    ("H2", -0.2677, atom(besides="C N O")), ("HS", 0.1125, atom())]


def _first(rules: list[tuple[str, float, Test]], e: Column) -> Column:
    """Name and value of the first rule that fits; null if none does."""
    out = F.lit(None).cast("struct<name:string,value:double>")
    for name, value, test in reversed(rules):
        out = F.when(test(e), F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))).otherwise(out)
    return out


def _typed(e: Column) -> Column:
    """The rule of an atom, that of its hydrogens, and how many it has."""
    rule = _first(OTHERS, e)
    for symbol, rules in (("C", CARBON), ("N", NITROGEN), ("O", OXYGEN)):
        rule = F.when(e["sym"] == symbol, _first(rules, e)).otherwise(rule)
    return F.struct(rule.alias("type"), F.when(e["h"] > 0, _first(HYDROGEN, e)).alias("h_type"), e["h"].alias("h"))


def atom_types(df: DataFrame, alias: str = "types") -> DataFrame:
    """The partition type of every atom that is not a hydrogen, and of its hydrogens.

    Atoms no type fits (attachments, other elements) have a null type.
    """
    heavy = F.filter("_around", lambda e: e["sym"] != "H")
    return settled(surroundings(df, "_around"), **{alias: F.transform(heavy, _typed)}).drop("_around")


def logp(df: DataFrame, alias: str = "logp", unknown: str = "n_untyped") -> DataFrame:
    """Octanol-water partition as the sum over atom types, and how many atoms have none (they add nothing)."""
    each = F.transform("_types", lambda t: F.coalesce(t["type"]["value"], F.lit(0.0)) + t["h"] * F.coalesce(t["h_type"]["value"], F.lit(0.0)))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    missing = F.size(F.filter("_types", lambda t: t["type"].isNull()))
    return atom_types(df, "_types").withColumns({alias: total, unknown: missing}).drop("_types")


def environments(df: DataFrame, alias: str = "environments") -> DataFrame:
    """For every atom the numbers of the environments that it is in."""
    def of(e: Column) -> Column:
        return F.array_compact(F.array(*[F.when(test(e), F.lit(n)) for n, test in ENVIRONMENTS.items()]))

    return settled(surroundings(df, "_around"), **{alias: F.transform("_around", of)}).drop("_around")
