"""Fragment queries on ``v_frag`` and ``v_mol``. Pairs join on an equality key:
each fragment meets the one of the next id, so pairs grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import smiles as S
from ..functions.substructure import logp
from ..operators import fragments as FR
from ..operators.reports import bit_moments
from ..session import spread
from ..sources.views import graph_rows, v_env, v_frag, v_graph, v_mol
from .molecules import GOLDEN_SQL
from .registry import query

# Per fragment its atoms, attachments, hydrogens and mass (3 dp),
# worked by hand: [*]CCO has CH2, CH2, OH; [*]CC([*])C[*] has CH2, CH, CH2.
FRAG_SQL = """(VALUES ('[*]CCO', 4, 1, 5), ('[*]c1ccc([*])cc1', 8, 2, 4), ('[*]C([*])=O', 4, 2, 0), ('[*]CC([*])C[*]', 6, 3, 5), ('CCO', 3, 0, 6), ('[*]O[*]', 3, 2, 0)) AS g(fragment, n, att, h)"""
PAIRS_SQL = f"""p AS (SELECT a.frag_id, x.n AS na, y.n AS nb, x.att AS ta, y.att AS tb, x.h AS ha, y.h AS hb FROM v_frag a JOIN v_frag b ON b.frag_id = a.frag_id + 1
 JOIN {FRAG_SQL.replace(' g(', ' x(')} ON a.fragment = x.fragment JOIN {FRAG_SQL.replace(' g(', ' y(')} ON b.fragment = y.fragment)"""


def graphs(spark, sf):
    return S.mol_graph(v_frag(spark, sf), "fragment").select("frag_id", "fragment", "atoms", "bonds")


def pairs(spark, sf):
    """The graphs of each two fragments that meet; the texts are joined, as they are shorter than their graphs."""
    f = v_frag(spark, sf)
    a = f.select("frag_id", F.col("fragment").alias("text_a"))
    b = f.select((F.col("frag_id") - 1).alias("frag_id"), F.col("fragment").alias("text_b"))
    both = spread(a.join(b, "frag_id"), f.count())
    one = S.mol_graph(both, "text_a").select("frag_id", "text_b", F.col("atoms").alias("atoms_a"), F.col("bonds").alias("bonds_a"))
    return S.mol_graph(one, "text_b").select("frag_id", "atoms_a", "bonds_a", F.col("atoms").alias("atoms_b"), F.col("bonds").alias("bonds_b"))


def joined(spark, sf):
    p = pairs(spark, sf).withColumns({"att_a": S.attachment_positions("atoms_a"), "att_b": S.attachment_positions("atoms_b")})
    return FR.assemble(FR.pair_attachments(p))


@query("attachment_pairs", "D3", sql=f"WITH {PAIRS_SQL} SELECT frag_id, CAST(ta * tb AS BIGINT) AS n_pairs FROM p WHERE ta * tb > 0")
def q_attachment_pairs(spark, sf):
    p = pairs(spark, sf).select("frag_id", S.attachment_positions("atoms_a").alias("att_a"), S.attachment_positions("atoms_b").alias("att_b"))
    return FR.pair_attachments(p).groupBy("frag_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("pair_estimate", "D4", sql="SELECT CAST((SELECT sum(n_att) FROM v_frag) * (SELECT sum(n_att) FROM v_frag WHERE fragment <> 'CCO') AS BIGINT) AS n_pairs")
def q_pair_estimate(spark, sf):
    f = v_frag(spark, sf)
    return FR.estimate_pairs(f, f.where("fragment <> 'CCO'"))


@query("assembled", "C14", sql=f"""WITH {PAIRS_SQL} SELECT frag_id, CAST(na + nb - 2 AS INT) AS n_atoms, CAST(na + nb - 2 AS BIGINT) AS min_atoms,
 CAST(ta + tb - 2 AS INT) AS n_att, CAST(ha + hb AS INT) AS n_h, CAST(ta * tb AS BIGINT) AS n FROM p WHERE ta * tb > 0""")
def q_assembled(spark, sf):
    j = joined(spark, sf).select("frag_id", F.size("atoms").alias("n_atoms"), F.size(S.attachment_positions()).alias("n_att"), S.total_h().alias("n_h"))
    return j.groupBy("frag_id", "n_atoms", "n_att", "n_h").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("n_atoms").cast("long")).alias("min_atoms"))


@query("assembled_first", "C15", sql=f"""WITH {PAIRS_SQL} SELECT frag_id, CAST(na - ta + nb - tb AS INT) AS n_atoms, CAST(ha + hb AS INT) AS n_h FROM p WHERE ta * tb > 0""")
def q_assembled_first(spark, sf):
    return FR.assemble_first(pairs(spark, sf)).select("frag_id", F.size("atoms").alias("n_atoms"), S.total_h().alias("n_h"))


@query("saturated", "C16", sql=f"SELECT f.frag_id, CAST(g.n - g.att AS INT) AS n_atoms, CAST(g.h + g.att AS INT) AS n_h FROM v_frag f JOIN {FRAG_SQL} ON f.fragment = g.fragment")
def q_saturated(spark, sf):
    return FR.saturate(graphs(spark, sf)).select("frag_id", F.size("atoms").alias("n_atoms"), S.total_h().alias("n_h"))


@query("vinyl_capped", "C17", sql=f"""SELECT f.frag_id, CAST(g.n - g.att + 2 AS INT) AS n_atoms, CAST(g.h + g.att - 1 + 3 AS INT) AS n_h, CAST(g.att AS BIGINT) AS n
 FROM v_frag f JOIN {FRAG_SQL} ON f.fragment = g.fragment WHERE g.att > 0""")
def q_vinyl_capped(spark, sf):
    c = FR.cap_vinyl(graphs(spark, sf)).select("frag_id", F.size("atoms").alias("n_atoms"), S.total_h().alias("n_h"))
    return c.groupBy("frag_id", "n_atoms", "n_h").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_products", "H2 C11")
def q_distinct_products(spark, sf):
    """One row per distinct joined and capped product."""
    capped = FR.distinct_products(FR.cap_vinyl(joined(spark, sf)))
    return capped.select("mol_key", S.formula().alias("formula"), F.round(S.mol_weight(), 3).alias("mw"))


@query("augmented", "C19", sql="SELECT frag_id, fragment, CAST(range AS INT) AS copy FROM v_frag, range(4)")
def q_augmented(spark, sf):
    return FR.augment(v_frag(spark, sf).select("frag_id", "fragment"))


def valid(spark, sf):
    return S.mol_graph(v_mol(spark, sf)).where("status is null")


@query("same_molecule", "C11", sql=f"""WITH c AS (SELECT m.mol_id, CASE m.smiles WHEN 'OCC' THEN 'CCO' WHEN 'C1=CC=CC=C1' THEN 'c1ccccc1' WHEN 'C1=CC=C2C=CC=CC2=C1' THEN 'c1ccc2ccccc2c1'
 WHEN 'c1ccccc1c1ccccc1' THEN 'c1ccc(-c2ccccc2)cc1' ELSE m.smiles END AS k FROM v_mol m JOIN {GOLDEN_SQL} ON m.smiles = g.smiles WHERE g.status IS NULL)
SELECT mol_id, min(mol_id) OVER (PARTITION BY k) AS first_id FROM c""")
def q_same_molecule(spark, sf):
    keyed = S.identity_key(valid(spark, sf)).select("mol_id", "mol_key")
    first = keyed.groupBy("mol_key").agg(F.min("mol_id").alias("first_id"))
    return keyed.join(first, "mol_key").select("mol_id", "first_id")


def _folded(start: str, values: str) -> str:
    return f"list_reduce(list_prepend(CAST({start} AS BIGINT), {values}), lambda s, x: (s * {S.FACTOR} + x) % {S.PRIME})"


def _environments(r: int) -> str:
    """Number and bond set of every atom at radius r, from those at r - 1."""
    number = _folded("17", f"list_concat([CAST({r} AS BIGINT), any_value(e.x)], flatten(list([CAST(n.o AS BIGINT), f.x] ORDER BY n.o, f.x)))")
    return f"""e{r} AS (SELECT e.smiles, e.i, {number} AS x, list_sort(list_distinct(list_concat(any_value(e.s), list(n.k), flatten(list(f.s))))) AS s
 FROM e{r - 1} e JOIN near n ON n.smiles = e.smiles AND n.i = e.i JOIN e{r - 1} f ON f.smiles = n.smiles AND f.i = n.j GROUP BY e.smiles, e.i)"""


BITS_SQL = f"""atom AS (SELECT * FROM (VALUES {graph_rows()[0]}) v(smiles, i, sym, sym2, deg, h, charge, ring)),
bond AS (SELECT * FROM (VALUES {graph_rows()[1]}) v(smiles, k, a, b, o)),
near AS (SELECT smiles, a AS i, b AS j, o, k FROM bond UNION ALL SELECT smiles, b, a, o, k FROM bond),
e0 AS (SELECT smiles, i, {_folded("17", "[CAST(x AS BIGINT) FOR x IN [sym + 256 * sym2, deg, h, charge + 16, ring, 0]]")} AS x, CAST([] AS INTEGER[]) AS s FROM atom),
{_environments(1)}, {_environments(2)},
seen AS (SELECT smiles, s, min({{'r': r, 'x': x}}).x AS x FROM (SELECT *, 1 AS r FROM e1 UNION ALL SELECT *, 2 FROM e2) GROUP BY smiles, s),
bits AS (SELECT DISTINCT smiles, CAST(x % 1024 AS INT) AS bit FROM (SELECT smiles, x FROM e0 UNION ALL SELECT smiles, x FROM seen))"""


@query("circular_fingerprints", "C9", sql=f"""WITH {BITS_SQL}, t AS (SELECT smiles, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM bits GROUP BY smiles)
SELECT mol_id, m.smiles, bits FROM v_graph m JOIN t ON t.smiles = m.smiles""")
def q_circular_fingerprints(spark, sf):
    f = S.fingerprint(S.mol_graph(v_graph(spark, sf)))
    return f.select("mol_id", "smiles", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query("path_fingerprints", "C10")
def q_path_fingerprints(spark, sf):
    return S.path_fingerprint(valid(spark, sf)).select("mol_id", "smiles", "path_bits")


@query("fingerprint_moments", "E16 C9", sql=f"""WITH {BITS_SQL}, n AS (SELECT count(*) AS n FROM v_graph)
SELECT bit, count(*) AS "on", round(count(*) / any_value(n), 6) AS mean, round(sqrt(count(*) / any_value(n) * (1 - count(*) / any_value(n))), 6) AS sd
FROM v_graph m JOIN bits b ON b.smiles = m.smiles, n GROUP BY bit""")
def q_fingerprint_moments(spark, sf):
    m = bit_moments(S.fingerprint(S.mol_graph(v_graph(spark, sf))), "bits")
    return m.select("bit", "on", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("cut_fragments", "C12 C13 E14", sql="SELECT mol_id, smiles, n_cuts, fragments FROM v_env")
def q_cut_fragments(spark, sf):
    """The distinct fragments of each molecule."""
    m = S.mol_graph(v_env(spark, sf))
    per = FR.distinct_fragments(m, "mol_id").groupBy("mol_id").agg(F.first("n_cuts").alias("n_cuts"), F.array_join(F.array_sort(F.collect_list("fragment")), ";").alias("fragments"))
    return m.select("mol_id", "smiles").join(per, "mol_id")


@query("fragment_kinds", "C12 C13 E14", sql="""SELECT fragment, count(*) AS n_molecules
 FROM (SELECT unnest(string_split(fragments, ';')) AS fragment, CASE WHEN n_cuts = 0 THEN smiles END AS whole FROM v_env) GROUP BY fragment, whole""")
def q_fragment_kinds(spark, sf):
    """Fragments over all molecules, with how many molecules have them."""
    each = FR.distinct_fragments(S.mol_graph(v_env(spark, sf)), "mol_id")
    return each.groupBy("frag_key").agg(F.first("fragment").alias("fragment"), F.count(F.lit(1)).alias("n_molecules")).drop("frag_key")


@query("partition_logp", "C8", sql="SELECT mol_id, smiles, CAST(logp AS DOUBLE) AS logp, 0 AS n_untyped FROM v_env")
def q_partition_logp(spark, sf):
    return logp(S.mol_graph(v_env(spark, sf))).select("mol_id", "smiles", F.round("logp", 4).alias("logp"), "n_untyped")
