"""Identity keys, environments, cutting and partition values against molecules worked by hand."""

import pytest
from pyspark.sql import functions as F

from molsift.functions import smiles as S
from molsift.functions import substructure as U
from molsift.operators import fragments as FR
from molsift.sources.views import WORKED

# Two writings of one molecule.
SAME = [("c1ccsc1", "C1=CSC=C1"), ("c1cc[nH]c1", "C1=CNC=C1"), ("c1ccncc1", "C1=CC=NC=C1"), ("c1ccc2c(c1)[nH]c1ccccc12", "C1=CC=C2C(=C1)NC1=CC=CC=C12"),
        ("c1ccoc1", "C1=COC=C1"), ("O=c1cc[nH]cc1", "O=C1C=CNC=C1"), ("c1ccc2ccccc2c1", "C1=CC=C2C=CC=CC2=C1"), ("Cn1cccc1", "CN1C=CC=C1"), ("OCC", "CCO"),
        ("c1ccc2[nH]ccc2c1", "C1=CC=C2NC=CC2=C1"), ("c1cnc[nH]1", "C1=CN=CN1"), ("O=C1C=CC(=O)C=C1", "C1=CC(=O)C=CC1=O")]
# Different ones; the first two pairs can't be told apart by neighbour rounds alone.
DIFFERENT = [("C1CCC2CCCCC2C1", "C1CCCC1C1CCCC1"), ("C1CC1.C1CC1", "C1CCCCC1"), ("c1ccncc1", "C1CCNCC1"), ("C1=CCC=CC1", "c1ccccc1"), ("C1=CCC=C1", "c1cc[nH]c1")]


def test_identity_keys(spark):
    pairs = SAME + DIFFERENT
    df = spark.createDataFrame([(i, j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "i int, j int, smiles string")
    graphs = S.mol_graph(df).where("status is null")
    keyed = S.identity_key(graphs)
    assert keyed.columns == [*graphs.columns, "mol_key"]
    keys = {(r["i"], r["j"]): r["mol_key"] for r in keyed.collect()}
    assert len(keys) == 2 * len(pairs)
    for i, p in enumerate(pairs):
        assert (keys[i, 0] == keys[i, 1]) == (i < len(SAME)), p


@pytest.fixture(scope="module")
def worked(spark):
    return S.mol_graph(spark.createDataFrame([(i, w[0]) for i, w in enumerate(WORKED)], "mol_id int, smiles string"))


def test_fragments_of_the_worked_molecules(worked):
    got = {}
    for r in FR.distinct_fragments(worked, "mol_id").collect():
        got.setdefault(r["mol_id"], []).append((r["n_cuts"], r["fragment"]))
    for i, (smiles, _, cuts, fragments) in enumerate(WORKED):
        assert sorted(f for _, f in got[i]) == sorted(fragments.split(";")) and {n for n, _ in got[i]} == {cuts}, smiles


def test_cutting_loses_no_atom_and_makes_one_part_more_per_cut(worked):
    atoms = {r["mol_id"]: r["n"] for r in worked.select("mol_id", F.size("atoms").alias("n")).collect()}
    f = FR.fragment(worked).select("mol_id", "n_cuts", F.size("atoms").alias("n"), F.size("bonds").alias("b"), F.size(S.attachment_positions()).alias("stars"),
                                   S.is_connected().alias("whole"), F.size("nbrs").alias("nb"))
    rows = f.groupBy("mol_id").agg(F.sum(F.col("n") - F.col("stars")).alias("n"), F.count("*").alias("parts"), F.max("n_cuts").alias("cuts"), F.sum("stars").alias("stars"),
                                   F.max((F.col("nb") != F.col("n")).cast("int")).alias("odd")).collect()
    assert len(rows) == len(WORKED)
    for r in rows:
        assert (r["n"], r["parts"], r["stars"], r["odd"]) == (atoms[r["mol_id"]], r["cuts"] + 1, 2 * r["cuts"], 0)


def test_partition_values(worked):
    got = {r["mol_id"]: (round(r["logp"], 4), r["n_untyped"]) for r in U.logp(worked).select("mol_id", "logp", "n_untyped").collect()}
    assert got == {i: (w[1], 0) for i, w in enumerate(WORKED)}


# Published sums of atom contributions; and types that the worked list lacks.
VALUES = {"c1ccccc1": 1.6866, "C": 0.6361, "CC": 1.0262, "CCC": 1.4163, "c1ccc2ccccc2c1": 2.8398, "CF": 0.5857, "CCl": 0.8550, "c1ccsc1": 1.7481, "c1ccoc1": 1.2796,
          "c1cc[nH]c1": 1.0147, "CC(C)=O": 0.5953, "C=C": 0.8022, "Oc1ccccc1": 1.3922, "Nc1ccccc1": 1.2688, "O=[N+]([O-])c1ccccc1": 1.5948, "Clc1ccccc1": 2.3400,
          "O=Cc1ccccc1": 1.4991, "CC(=O)[O-]": -1.2438, "C[C@H](N)C(=O)O": -0.5818, "O": -0.8247, "CO": -0.3915, "CC(=O)O": 0.0909, "[H]C": 0.6361}


def test_partition_values_of_further_types(spark):
    df = S.mol_graph(spark.createDataFrame([(k,) for k in [*VALUES, "[*]CCO", "[Tc]C"]], "smiles string")).where("status is null")
    got = {r["smiles"]: (round(r["logp"], 4), r["n_untyped"]) for r in U.logp(df).select("smiles", "logp", "n_untyped").collect()}
    assert {k: v for k, v in got.items() if k in VALUES} == {k: (v, 0) for k, v in VALUES.items()}
    assert got["[*]CCO"][1] == 1  # an attachment has no type, and is reported


def test_environments(spark):
    df = S.mol_graph(spark.createDataFrame([("CC(=O)OC",), ("CCN1CCCC1=O",), ("c1ccc(-c2ccccn2)cc1",), ("CS(=O)(=O)N",), ("C1CCOC1",)], "smiles string"))
    got = {r["smiles"]: r["environments"] for r in U.environments(df).collect()}
    assert got["CC(=O)OC"] == [[], [1, 6, 7], [], [3], []]
    assert got["CCN1CCCC1=O"][2] == [10] and got["CCN1CCCC1=O"][1] == [4, 7, 8]
    assert got["c1ccc(-c2ccccn2)cc1"][4] == [14] and got["c1ccc(-c2ccccn2)cc1"][3] == [16]
    assert got["CS(=O)(=O)N"][1] == [12]
    assert got["C1CCOC1"][1] == [7, 15] and 13 in got["C1CCOC1"][2]
