"""Molecule notation as token and graph arrays.

``mol_graph`` reads each notation once, in Arrow batches, into ``status``,
``atoms``, ``bonds``, ``nbrs`` and ``benzene``; no shuffle. What follows is
column expressions over these arrays, each linear in the molecule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .notation import (  # noqa: F401  (the statuses are used by callers)
    AROMATIC, ATOMIC_MASS, STATUS_EMPTY, STATUS_ERROR, STATUS_INVALID, STATUS_UNPARSABLE, TOKEN_PATTERN, read)

ATOM_TYPE = ("struct<idx:int,sym:string,aromatic:boolean,charge:int,h:int,label:int,bracket:boolean,part:int,"
             "donor:boolean,acceptor:boolean,ring:boolean,mass:double>")
GRAPH_TYPE = (f"struct<status:string,atoms:array<{ATOM_TYPE}>,bonds:array<struct<a:int,b:int,o:int,ring:boolean>>,"
              "nbrs:array<array<struct<j:int,o:int>>>,benzene:int>")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, however often they are used afterwards.

    A plain projection may be merged into the next one, which then repeats its
    expressions wherever they are named; a generator of one row is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def smiles_tokens(col) -> Column:
    """Tokens of the notation; they re-concatenate to the input when the
    string is inside the supported alphabet."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 1)


def _list(rows: list, kind: pa.DataType, missing: list[bool]) -> pa.Array:
    """A list array of flat structs given as tuples; null where ``missing``."""
    sizes = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat)) if flat else [()] * kind.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(sizes), values, mask=pa.array(missing, pa.bool_()))


ATOM_ARROW = pa.struct([("idx", pa.int32()), ("sym", pa.string()), ("aromatic", pa.bool_()), ("charge", pa.int32()), ("h", pa.int32()),
                        ("label", pa.int32()), ("bracket", pa.bool_()), ("part", pa.int32()), ("donor", pa.bool_()), ("acceptor", pa.bool_()),
                        ("ring", pa.bool_()), ("mass", pa.float64())])
BOND_ARROW = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("o", pa.int32()), ("ring", pa.bool_())])
NBR_ARROW = pa.struct([("j", pa.int32()), ("o", pa.int32())])


def _graphs(texts: pa.Array) -> pa.Array:
    status, atoms, bonds, nbrs, benzene, missing = [], [], [], [], [], []
    for text in texts.to_pylist():
        why, m = read(text)
        status.append(why)
        missing.append(m is None)
        if m is None:
            atoms.append([])
            bonds.append([])
            nbrs.append([])
            benzene.append(None)
            continue
        rings = m.benzene_rings()
        for ring in rings:  # one form for rings written with aromatic and with double bonds
            for a in ring:
                m.aromatic[a] = True
                for j, bond in m.nbrs[a]:
                    if j in ring:
                        m.bonds[bond][2] = AROMATIC
        ringed = {x for (a, b, _), r in zip(m.bonds, m.in_ring) if r for x in (a, b)}
        atoms.append([(i, s, m.aromatic[i], m.charge[i], m.h[i], m.label[i], m.bracket[i], m.part[i], *m.hydrogen_bonds(i), i in ringed, ATOMIC_MASS[s])
                      for i, s in enumerate(m.sym)])
        bonds.append([(a, b, o, r) for (a, b, o), r in zip(m.bonds, m.in_ring)])
        nbrs.append([[(j, m.bonds[b][2]) for j, b in around] for around in m.nbrs])
        benzene.append(len(rings))
    inner = _list([x for r in nbrs for x in r], NBR_ARROW, [False] * sum(map(len, nbrs)))
    outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, nbrs)]).astype(np.int32)), inner, mask=pa.array(missing, pa.bool_()))
    return pa.StructArray.from_arrays(
        [pa.array(status, pa.string()), _list(atoms, ATOM_ARROW, missing), _list(bonds, BOND_ARROW, missing), outer, pa.array(benzene, pa.int32())],
        names=["status", "atoms", "bonds", "nbrs", "benzene"])


def mol_graph(df: DataFrame, col: str = "smiles") -> DataFrame:
    """Add ``tokens``, ``status`` (NULL when valid), ``atoms``, ``bonds``,
    ``nbrs`` (neighbours and bond orders of each atom) and ``benzene``.

    Bond orders are 1, 2, 3, 4 and 5 (aromatic). The function is marked as not
    deterministic only so that the optimiser keeps one call of it per row.
    """
    graph = F.arrow_udf(_graphs, GRAPH_TYPE).asNondeterministic()
    df = df.withColumn("tokens", smiles_tokens(col)).withColumn("_graph", graph(F.col(col)))
    return df.select("*", "_graph.*").drop("_graph")


# --- per-molecule properties (row-local) -------------------------------------

def n_atoms(atoms="atoms") -> Column:
    return F.size(_c(atoms))


def attachment_positions(atoms="atoms") -> Column:
    """Indices of the attachment atoms, in order."""
    return F.transform(F.filter(_c(atoms), lambda a: a["sym"] == "*"), lambda a: a["idx"])


def n_attachments_text(col) -> Column:
    """B17 on text: number of attachment tokens ``*`` (bare or bracketed)."""
    toks = smiles_tokens(col)
    return F.size(F.filter(toks, lambda t: t.rlike(r"^(\*|\[\d*\*\])$")))


def n_parts(atoms="atoms") -> Column:
    """Connected parts of the graph (``O.C`` has two)."""
    return F.size(F.array_distinct(F.transform(_c(atoms), lambda a: a["part"])))


def is_connected(atoms="atoms") -> Column:
    return n_parts(atoms) == 1


def has_element(sym: str, atoms="atoms") -> Column:
    """C4: the molecule holds an atom of element ``sym``."""
    return F.exists(_c(atoms), lambda a: a["sym"] == sym)


def is_product(col) -> Column:
    """B16 (text): one connected part and no attachment left."""
    return (F.instr(_c(col), ".") == 0) & (n_attachments_text(col) == 0)


def is_intermediate(col) -> Column:
    """B16 (text): one connected part and at least one attachment."""
    return (F.instr(_c(col), ".") == 0) & (n_attachments_text(col) >= 1)


def total_h(atoms="atoms") -> Column:
    return F.aggregate(_c(atoms), F.lit(0), lambda s, a: s + a["h"] + (a["sym"] == "H").cast("int"))


def mol_weight(atoms="atoms") -> Column:
    """Sum of the atoms' masses and of their hydrogens."""
    return F.aggregate(_c(atoms), F.lit(0.0), lambda s, a: s + a["mass"] + a["h"] * F.lit(ATOMIC_MASS["H"]))


def formula(atoms="atoms") -> Column:
    """Hill formula (C, H, then the other elements by name; without C all by name)."""
    syms = F.transform(F.filter(_c(atoms), lambda x: x["sym"] != "*"), lambda x: x["sym"])
    has_c = F.array_contains(syms, "C")
    every = F.when(total_h(atoms) > 0, F.array_union(syms, F.array(F.lit("H")))).otherwise(F.array_distinct(syms))

    def rank(s):
        return F.when(has_c & (s == "C"), F.lit("0")).when(has_c & (s == "H"), F.lit("1")).otherwise(s)

    def part(s):
        n = F.when(s == "H", total_h(atoms)).otherwise(F.size(F.filter(syms, lambda x: x == s)))
        return F.concat(s, F.when(n > 1, n.cast("string")).otherwise(""))

    order = F.sort_array(F.transform(every, lambda s: F.struct(rank(s).alias("r"), s.alias("s"))))
    return F.array_join(F.transform(order, lambda x: part(x["s"])), "")


def hbd(atoms="atoms") -> Column:
    """Hydrogen-bond donors."""
    return F.size(F.filter(_c(atoms), lambda a: a["donor"]))


def hba(atoms="atoms") -> Column:
    """Hydrogen-bond acceptors."""
    return F.size(F.filter(_c(atoms), lambda a: a["acceptor"]))


def benzene_rings() -> Column:
    """Six-rings of carbons with aromatic or alternating double bonds."""
    return F.col("benzene")


# --- neighbourhoods ------------------------------------------------------------

def _atom_seed(atoms: Column) -> Column:
    return F.transform(atoms, lambda a: F.xxhash64(a["sym"], a["aromatic"], a["charge"], a["h"], a["ring"], F.coalesce(a["label"], F.lit(-1))))


def _next_round(now: Column) -> Column:
    """Each atom's number made from its own and its sorted neighbours' numbers in ``now``."""
    return F.transform(now, lambda x, i: F.xxhash64(x, F.sort_array(F.transform(
        F.get(F.col("nbrs"), i), lambda n: F.struct(n["o"].alias("o"), F.get(now, n["j"]).alias("x"))))))


# The modulus and factor of the integer hash, which any SQL engine can repeat.
PRIME, FACTOR = 2_147_483_647, 31_337


def _fold(start: Column, values: Column) -> Column:
    """The values hashed one after the other, each below the modulus."""
    return F.aggregate(values, start.cast("long"), lambda s, x: (s * FACTOR + x) % PRIME)


def environment_seed(a: Column) -> Column:
    """An atom by itself as a number: symbol, neighbours, hydrogens, charge, ring."""
    symbol = F.ascii(a["sym"]) + 256 * F.ascii(F.substring(a["sym"], 2, 1))
    marks = [symbol, F.size(F.get(F.col("nbrs"), a["idx"])), a["h"], a["charge"] + 16, a["ring"].cast("int"), F.coalesce(a["label"], F.lit(0))]
    return _fold(F.lit(17), F.array(*[m.cast("long") for m in marks]))


def fingerprint(df: DataFrame, radius: int = 2, n_bits: int = 1024, alias: str = "bits") -> DataFrame:
    """Circular fingerprint, the sorted on-bits of ``n_bits``.

    Every atom has a number per radius: at 0 that of the atom by itself, then
    the radius, its last number and the sorted (bond order, last number) of its
    neighbours, folded by an integer hash. An environment is the set of bonds
    within its radius; of environments with equal sets the one of the least
    radius, then number, counts, and those without bonds beyond radius 0 don't.
    Equal molecules written differently give equal bits.
    """
    keep = df.columns
    numbered = F.transform("bonds", lambda b, k: F.struct(b["a"].alias("a"), b["b"].alias("b"), b["o"].alias("o"), k.cast("int").alias("k")))
    df = settled(df, _bonds=numbered)
    df = settled(df, _near=F.transform("atoms", lambda a: F.transform(
        F.filter("_bonds", lambda b: (b["a"] == a["idx"]) | (b["b"] == a["idx"])), lambda b: F.struct(
            F.when(b["a"] == a["idx"], b["b"]).otherwise(b["a"]).alias("j"), b["o"].cast("long").alias("o"), b["k"].alias("k")))))
    df = settled(df, _id0=F.transform("atoms", environment_seed), _set0=F.transform("atoms", lambda a: F.array().cast("array<int>")))
    for r in range(1, radius + 1):
        ids, sets = F.col(f"_id{r - 1}"), F.col(f"_set{r - 1}")

        def next_id(x, i):
            around = F.array_sort(F.transform(F.get(F.col("_near"), i), lambda n: F.struct(n["o"].alias("o"), F.get(ids, n["j"]).alias("x"))))
            return _fold(F.lit(17), F.concat(F.array(F.lit(r).cast("long"), x), F.flatten(F.transform(around, lambda n: F.array(n["o"], n["x"])))))

        def next_set(x, i):
            around = F.get(F.col("_near"), i)
            return F.array_sort(F.array_distinct(F.concat(x, F.transform(around, lambda n: n["k"]), F.flatten(F.transform(around, lambda n: F.get(sets, n["j"]))))))

        df = settled(df, **{f"_id{r}": F.transform(ids, next_id), f"_set{r}": F.transform(sets, next_set)})
    def at_radius(r):
        return F.zip_with(f"_set{r}", f"_id{r}", lambda s, x: F.struct(s.alias("s"), F.lit(r).alias("r"), x.alias("x")))

    seen = F.concat(*[at_radius(r) for r in range(1, radius + 1)])
    df = settled(df, _seen=F.array_sort(F.filter(seen, lambda e: F.size(e["s"]) > 0)))
    first = F.filter("_seen", lambda e, k: (k == 0) | (F.get(F.col("_seen"), k - 1)["s"] != e["s"]))
    bits = F.transform(F.concat(F.col("_id0"), F.transform(first, lambda e: e["x"])), lambda x: (x % n_bits).cast("int"))
    return df.withColumn("_bits", F.array_sort(F.array_distinct(bits))).select(*[c for c in keep if c != alias], F.col("_bits").alias(alias))


def _pi_electrons(a: Column) -> Column:
    """Electrons that a ring atom gives to an aromatic ring; null if it can't be in one.

    The count is the same for either writing: an atom of a double or aromatic
    bond in a ring gives one, a carbon doubly bonded to a hetero atom outside
    none, and N, O, S with single bonds alone a pair. ``_bonded`` has each ring
    atom's bonds.
    """
    around, pairs = F.get(F.col("nbrs"), a["idx"]), F.get(F.col("_bonded"), a["idx"])
    outer = F.exists(pairs, lambda n: (n["o"] == 2) & ~n["ring"])
    outer_hetero = F.exists(pairs, lambda n: (n["o"] == 2) & ~n["ring"] & n["sym"].isin("O", "N", "S"))
    inner = F.exists(pairs, lambda n: (n["o"] == 2) & n["ring"])
    written = F.exists(pairs, lambda n: n["o"] == AROMATIC)
    bonded = F.size(around) + a["h"]
    pair = ((a["sym"] == "N") & (a["charge"] == 0) & (bonded == 3)) | (a["sym"].isin("O", "S", "Se") & (a["charge"] == 0) & (bonded == 2)) \
        | ((a["sym"] == "C") & (a["charge"] == -1))
    multiple = F.exists(pairs, lambda n: n["o"].isin(3, 4))
    return (F.when(~a["ring"] | multiple, None).when(outer, F.when((a["sym"] == "C") & outer_hetero & ~inner, 0))
            .when(inner, 1).when(written & (a["sym"] == "C") & (a["charge"] == 0), 1).when(pair, 2)
            .when(written & ((a["sym"] == "N") | (a["charge"] == 1)), 1).when((a["sym"] == "C") & (a["charge"] == 1), 0).when(a["sym"] == "B", 0))


def aromatic_form(df: DataFrame, sizes=(5, 6, 7)) -> DataFrame:
    """C11: mark aromatic rings alike, however they are written (lower case or with double bonds).

    Rings of 5 to 7 atoms whose electrons number 4n + 2 become aromatic: their
    atoms' flags, and order 5 for their bonds in ``bonds`` and ``nbrs``. Rings
    are found as paths over ring bonds between atoms that can be in one, from
    each ring's least atom, in one direction.
    """
    keep = df.columns
    pairs = F.transform(F.filter("bonds", lambda b: b["ring"]), lambda b: F.struct(F.least(b["a"], b["b"]).alias("a"), F.greatest(b["a"], b["b"]).alias("b")))
    df = settled(df, _ring_pairs=pairs)
    bonded = F.transform("atoms", lambda a: F.when(a["ring"], F.transform(F.get(F.col("nbrs"), a["idx"]), lambda n: F.struct(n["o"].alias("o"), F.array_contains("_ring_pairs", F.struct(
        F.least(a["idx"], n["j"]).alias("a"), F.greatest(a["idx"], n["j"]).alias("b"))).alias("ring"), F.get(F.col("atoms"), n["j"])["sym"].alias("sym")))))
    df = settled(df, _bonded=bonded)
    df = settled(df, _pi=F.transform("atoms", _pi_electrons))

    def takes_part(i: Column) -> Column:
        return F.get(F.col("_pi"), i).isNotNull()

    df = settled(df, _links=F.filter("_ring_pairs", lambda p: takes_part(p["a"]) & takes_part(p["b"])))
    df = settled(df, _next=F.transform("atoms", lambda a: F.transform(
        F.filter("_links", lambda p: (p["a"] == a["idx"]) | (p["b"] == a["idx"])), lambda p: F.when(p["a"] == a["idx"], p["b"]).otherwise(p["a"]))))
    df = settled(df, _w1=F.transform(F.filter("atoms", lambda a: F.size(F.get(F.col("_next"), a["idx"])) > 1), lambda a: F.array(a["idx"])))
    for n in range(2, max(sizes) + 1):
        def longer(p):
            ways = F.filter(F.get(F.col("_next"), F.element_at(p, -1)), lambda j: (j > F.get(p, F.lit(0))) & ~F.array_contains(p, j))
            return F.transform(ways, lambda j: F.array_append(p, j))
        df = settled(df, **{f"_w{n}": F.flatten(F.transform(f"_w{n - 1}", longer))})
    closed = [F.filter(f"_w{n}", lambda p: F.array_contains(F.get(F.col("_next"), F.element_at(p, -1)), F.get(p, F.lit(0))) & (F.get(p, F.lit(1)) < F.element_at(p, -1))) for n in sizes]

    def whole(p):
        electrons = F.aggregate(p, F.lit(0), lambda s, i: s + F.get(F.col("_pi"), i))
        return electrons % 4 == 2

    df = settled(df, _rings=F.filter(F.concat(*closed), whole))

    def order(i: Column, j: Column, o: Column) -> Column:
        return F.when(F.exists("_rings", lambda r: F.array_contains(r, i) & F.array_contains(r, j)), F.lit(AROMATIC)).otherwise(o)

    atoms = F.transform("atoms", lambda a: a.withField("aromatic", a["aromatic"] | F.exists("_rings", lambda r: F.array_contains(r, a["idx"]))))
    bonds = F.transform("bonds", lambda b: b.withField("o", F.when(b["ring"], order(b["a"], b["b"], b["o"])).otherwise(b["o"])))
    nbrs = F.transform("nbrs", lambda around, i: F.transform(around, lambda n: n.withField("o", F.when(F.array_contains("_ring_pairs", F.struct(
        F.least(i.cast("int"), n["j"]).alias("a"), F.greatest(i.cast("int"), n["j"]).alias("b"))), order(i.cast("int"), n["j"], n["o"])).otherwise(n["o"]))))
    df = settled(df, _new_atoms=atoms, _new_bonds=bonds, _new_nbrs=nbrs)
    return df.select(*[F.col(f"_new_{c}").alias(c) if c in ("atoms", "bonds", "nbrs") else c for c in keep])


def stable_round(seed: Column) -> Column:
    """The atoms' numbers, from ``seed`` on, after the first round that tells no more atoms apart.

    Each number holds the one before it, so from then on no round does; that
    is reached within as many rounds as there are atoms. Numbers are compared
    with those of the round before, which the fold carries along.
    """
    def one(s, _):
        return F.when(s["n"] == s["before"], s).otherwise(F.transform(F.array(_next_round(s["now"])), lambda x: F.struct(
            x.alias("now"), F.size(F.array_distinct(x)).alias("n"), s["n"].alias("before")))[0])

    first = F.transform(F.array(seed), lambda x: F.struct(
        x.alias("now"), F.size(F.array_distinct(x)).alias("n"), F.lit(0).alias("before")))[0]
    return F.aggregate(F.sequence(F.lit(0), F.size("atoms")), first, one, lambda s: s["now"])


def identity_key(df: DataFrame, alias: str = "mol_key") -> DataFrame:
    """C11: a key that does not depend on how the molecule is written.

    Aromatic rings are marked alike first. Then the sorted numbers of all atoms
    after so many rounds as tell more atoms apart. Such rounds can't tell some
    graphs of two rings and more apart (decalin and bicyclopentyl); there every
    atom that still has an equal is marked in turn, the rounds go on from the
    mark, and the sorted outcomes of all marks join the key.
    """
    keep = df.columns
    df = aromatic_form(df.withColumn("_o_atoms", F.col("atoms")).withColumn("_o_bonds", F.col("bonds")).withColumn("_o_nbrs", F.col("nbrs")))
    df = settled(df, _stable=stable_round(_atom_seed(F.col("atoms"))))
    tied = F.filter(F.sequence(F.lit(0), F.size("atoms") - 1), lambda i: F.size(F.filter("_stable", lambda x: x == F.get(F.col("_stable"), i))) > 1)
    rings = F.size("bonds") - F.size("atoms") + n_parts("atoms")
    none = F.array().cast("array<int>")
    df = settled(df, _tied=F.when((rings > 1) & (F.size(F.array_distinct("_stable")) < F.size("atoms")), tied).otherwise(none))

    def marked(v: Column) -> Column:
        seed = F.transform("_stable", lambda x, i: F.when(i == v, F.xxhash64(x, F.lit(1))).otherwise(x))
        return F.xxhash64(F.sort_array(stable_round(seed)))

    df = settled(df, _marked=F.sort_array(F.transform("_tied", marked)))
    last = F.transform(F.concat(F.sort_array("_stable"), F.col("_marked")), lambda x: x.cast("string"))
    key = F.sha2(F.concat_ws(",", F.size("bonds").cast("string"), last), 256)
    df = settled(df, _key=key)
    return df.select(*[F.col(f"_o_{c}").alias(c) if c in ("atoms", "bonds", "nbrs") else c for c in keep if c != alias], F.col("_key").alias(alias))


def path_fingerprint(df: DataFrame, max_len: int = 4, n_bits: int = 2048, alias: str = "path_bits") -> DataFrame:
    """Paths of up to ``max_len`` bonds that meet no atom twice, as sorted on-bits.

    A path is the numbers of its atoms and bonds; the smaller of the two
    directions counts, so that either end gives the same bit.
    """
    label = F.transform("atoms", lambda a: F.xxhash64(a["sym"], a["aromatic"]))
    df = df.withColumn("_label", label)
    df = df.withColumn("_p0", F.transform("atoms", lambda a: F.struct(F.array(a["idx"]).alias("at"), F.array(F.get(F.col("_label"), a["idx"])).alias("l"))))

    def longer(p):
        return F.transform(F.filter(F.get(F.col("nbrs"), F.element_at(p["at"], -1)), lambda n: ~F.array_contains(p["at"], n["j"])), lambda n: F.struct(
            F.array_append(p["at"], n["j"]).alias("at"),
            F.concat(p["l"], F.array(n["o"].cast("long"), F.get(F.col("_label"), n["j"]))).alias("l")))

    for i in range(1, max_len + 1):
        df = df.withColumn(f"_p{i}", F.flatten(F.transform(f"_p{i - 1}", longer)))
    names = [f"_p{i}" for i in range(max_len + 1)]
    bits = F.transform(F.concat(*names), lambda p: F.pmod(F.least(F.xxhash64(p["l"]), F.xxhash64(F.reverse(p["l"]))), F.lit(n_bits)).cast("int"))
    return df.withColumn(alias, F.array_sort(F.array_distinct(bits))).drop("_label", *names)
