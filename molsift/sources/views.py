"""Fixture relations derived from the driver tables.

Each view exists twice: as a DataFrame plan (what our queries read) and as
SQL text for the DuckDB oracle (``with_views`` puts them in a WITH clause).
All of them read whole tables; none keeps an id subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The molecule strings assigned to parts by p_partkey % 49, and
# the fragment strings assigned by p_partkey % 6.
MOLECULES = [*enumerate((
    "c1ccccc1", "CCO", "C[Si](C)(C)Cl", "c1ccc2ccccc2c1", "c1ccc(-c2ccccc2)cc1", "CC(=O)O", "[1*]C([6*])=O",
    "[16*]c1ccc([16*])cc1", "O.C", "C1CC", "", "[3*]O[17*]", "OCC", None,
    "c1ccsc1", "Cn1cccc1", "c1cc[nH]c1", "c1ccncc1", "O=C1CCC(=O)N1", "CN(C)C=O", "CS(=O)(=O)C", "C[N+](=O)[O-]",
    "c1ccc2c(c1)[nH]c1ccccc12", "CN", "CF", "C%01CC1", "[Na+].[Cl-]", "[H]C", "C1=CC=CC=C1", "C1=CC=C2C=CC=CC2=C1",
    "c1ccccc1c1ccccc1", "C[NH3+]", "CC(=O)[O-]", "O=C(N)c1ccccc1", "F/C=C/F", "C[C@H](N)C(=O)O",
    "CC=", "C-", "C==C", "C()C", "C.", ".C", "C12CC12", "C(C)(C)(C)(C)C", "CN(C)(C)C", "C(=)C", "c1cccc1", "cc", "[U]"))]
FRAGMENTS = [
    (0, "[*]CCO"), (1, "[*]c1ccc([*])cc1"), (2, "[*]C([*])=O"), (3, "[*]CC([*])C[*]"),
    (4, "CCO"), (5, "[*]O[*]"),
]


# Molecules with functional groups, assigned by p_partkey % 30, with
# what was worked out by hand: the octanol-water partition, the cut bonds and
# the distinct fragments (formula and labels).
WORKED = [
    ("CC(=O)OC", 0.1793, 1, "C2H3O|1;CH3O|3"), ("CCOC(C)=O", 0.5694, 2, "C2H3O|1;C2H5|4;O|3,3"), ("COC", 0.2626, 0, "C2H6O"), ("CCN", -0.035, 0, "C2H7N"),
    ("CCNCC", 0.6158, 2, "C2H5|4;HN|5,5"), ("c1ccc(-c2ccccc2)cc1", 3.3536, 1, "C6H5|16"), ("CC(=O)Nc1ccccc1", 1.645, 2, "C2H3O|1;C6H5|16;HN|5,5"),
    ("O=C(N)c1ccccc1", 0.7855, 1, "C6H5|16;CH2NO|6"), ("Cc1ccccc1", 1.995, 0, "C7H8"), ("CCc1ccccc1", 2.249, 1, "C2H5|8;C6H5|16"),
    ("CCSc1ccccc1", 2.7986, 2, "C2H5|4;C6H5|16;S|11,11"), ("CS(=O)(=O)Nc1ccccc1", 1.0581, 2, "C6H5|16;CH3O2S|12;HN|5,5"), ("C1CCCCC1", 2.3406, 0, "C6H12"),
    ("C1CCCCC1c1ccccc1", 3.7343, 1, "C6H11|15;C6H5|16"), ("C1CCNCC1", 0.7599, 0, "C5H11N"), ("CCN1CCCCC1", 1.4922, 1, "C2H5|4;C5H10N|5"),
    ("CCN1CCCC1=O", 0.6287, 1, "C2H5|8;C4H6NO|10"), ("c1ccc(Oc2ccccc2)cc1", 3.4789, 2, "C6H5|16;O|3,3"), ("COc1ccccc1", 1.6952, 1, "C6H5|16;CH3O|3"),
    ("C=Cc1ccccc1", 2.3296, 0, "C8H8"), ("CC=CC", 1.5824, 1, "C2H4|7"), ("c1ccncc1", 1.0816, 0, "C5H5N"), ("c1ccc(-n2cccc2)cc1", 2.4773, 1, "C4H4N|9;C6H5|16"),
    ("c1ccc(-c2ccccn2)cc1", 2.7486, 1, "C5H4N|14;C6H5|16"), ("C1CCOC1c1ccccc1", 2.5381, 1, "C4H7O|13;C6H5|16"), ("CC(=O)N(C)C", 0.0945, 1, "C2H3O|1;C2H6N|5"),
    ("CC(=O)c1ccccc1", 1.8892, 1, "C2H3O|6;C6H5|16"), ("CCO", -0.0014, 0, "C2H6O"), ("CC#N", 0.5299, 0, "C2H3N"), ("CCOCC", 1.0428, 2, "C2H5|4;O|3,3")]


# Molecules as graphs, assigned by p_partkey % 10: per atom symbol,
# neighbours, hydrogens, charge and whether in a ring; per bond its ends and order.
GRAPHS = [
    ("CCO", "C 1 3 0 0,C 2 2 0 0,O 1 1 0 0", "0 1 1,1 2 1"), ("CC(=O)O", "C 1 3 0 0,C 3 0 0 0,O 1 0 0 0,O 1 1 0 0", "0 1 1,1 2 2,1 3 1"),
    ("c1ccccc1", "C 2 1 0 1,C 2 1 0 1,C 2 1 0 1,C 2 1 0 1,C 2 1 0 1,C 2 1 0 1", "0 1 5,1 2 5,2 3 5,3 4 5,4 5 5,0 5 5"),
    ("C1CC1", "C 2 2 0 1,C 2 2 0 1,C 2 2 0 1", "0 1 1,1 2 1,0 2 1"), ("C[NH3+]", "C 1 3 0 0,N 1 3 1 0", "0 1 1"),
    ("C[Si](C)(C)Cl", "C 1 3 0 0,Si 4 0 0 0,C 1 3 0 0,C 1 3 0 0,Cl 1 0 0 0", "0 1 1,1 2 1,1 3 1,1 4 1"), ("CC#N", "C 1 3 0 0,C 2 0 0 0,N 1 0 0 0", "0 1 1,1 2 3"),
    ("C=CC=O", "C 1 2 0 0,C 2 1 0 0,C 2 1 0 0,O 1 0 0 0", "0 1 2,1 2 1,2 3 2"), ("O", "O 0 2 0 0", ""),
    ("CC(C)(C)C", "C 1 3 0 0,C 4 0 0 0,C 1 3 0 0,C 1 3 0 0,C 1 3 0 0", "0 1 1,1 2 1,1 3 1,1 4 1")]


def _literal(spark: SparkSession, rows, name: str) -> DataFrame:
    return spark.createDataFrame(rows, f"k int, {name} string")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of ``part``, dealt out to as many tasks as reading their molecules needs."""
    return spread(table(spark, sf_dir, "part").select("p_partkey"))


def v_mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _parts(spark, sf_dir)
    lit = F.broadcast(_literal(spark, MOLECULES, "smiles"))  # 14 rows, fixed
    return (part.join(lit, F.pmod(part.p_partkey, F.lit(len(MOLECULES))) == lit.k)
            .select(F.col("p_partkey").alias("mol_id"), "smiles"))


def v_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _parts(spark, sf_dir)
    lit = F.broadcast(_literal(spark, [(k, row[0]) for k, row in enumerate(WORKED)], "smiles"))  # 30 rows, fixed
    return (part.join(lit, F.pmod(part.p_partkey, F.lit(len(WORKED))) == lit.k)
            .select(F.col("p_partkey").alias("mol_id"), "smiles"))


def v_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _parts(spark, sf_dir)
    lit = F.broadcast(_literal(spark, [(k, row[0]) for k, row in enumerate(GRAPHS)], "smiles"))  # 10 rows, fixed
    return (part.join(lit, F.pmod(part.p_partkey, F.lit(len(GRAPHS))) == lit.k)
            .select(F.col("p_partkey").alias("mol_id"), "smiles"))


def graph_rows() -> tuple[str, str]:
    """The atoms (smiles, i, sym, sym2, deg, h, charge, ring) and bonds (smiles, k, a, b, o) of GRAPHS as SQL rows."""
    atoms, bonds = [], []
    for smiles, a, b in GRAPHS:
        for i, x in enumerate(a.split(",")):
            sym, *marks = x.split()
            atoms.append(f"('{smiles}',{i},{ord(sym[0])},{ord(sym[1]) if len(sym) > 1 else 0},{','.join(marks)})")
        bonds += [f"('{smiles}',{k},{','.join(x.split())})" for k, x in enumerate(b.split(",")) if x]
    return ",".join(atoms), ",".join(bonds)


def v_frag(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _parts(spark, sf_dir)
    lit = F.broadcast(_literal(spark, FRAGMENTS, "fragment"))  # 6 rows, fixed
    n_att = ((F.length("fragment") - F.length(F.replace("fragment", F.lit("[*]"), F.lit(""))))
             / 3).cast("int")
    return (part.join(lit, F.pmod(part.p_partkey, F.lit(len(FRAGMENTS))) == lit.k)
            .select(F.col("p_partkey").alias("frag_id"), "fragment", n_att.alias("n_att")))


def v_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_tax") * 100).alias("logp"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).alias("hbd"),
        (F.col("l_quantity").cast("int") % 10).alias("hba"),
        (-F.col("l_discount") * 50).alias("logs"))


def v_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1)).cast("double")

    def isum(e):
        return F.sum(e.cast("bigint")).cast("double")

    return li.groupBy("l_partkey").agg(
        (F.lit(200.0) + isum(F.round(F.col("l_extendedprice") * 100)) / n / 100000).alias("td"),
        (-isum(F.round(F.col("l_discount") * 100)) / n / 2).alias("stotal"),
        (isum(F.col("l_quantity")) / n / 10).alias("sa"),
    ).select(
        F.col("l_partkey").alias("mol_id"), "td", "stotal", "sa",
        F.when(F.col("l_partkey") % 3 == 0, F.lit("reasonable"))
        .otherwise(F.lit("original")).alias("source_file"))


def v_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"),
        F.col("l_tax").alias("f3"), F.col("l_linenumber").cast("double").alias("f4"),
        (F.col("l_extendedprice") / 1000).alias("label"),
        F.when((F.col("l_partkey") * 7919 + 42) % 100 < 20, F.lit("test"))
        .otherwise(F.lit("train")).alias("part_set"))


def v_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = labels.join(docs, "doc_id")
    return j.select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("water_soluble"),
        F.ln(F.lit(1) + F.col("n_chars")).alias("x"),
        ((F.col("n_chars") % 50).cast("double") / F.lit(50.0)).alias("score"),
        ((F.col("doc_id") * 31 + 42) % 10).alias("fold"))


VIEWS = {"v_mol": v_mol, "v_env": v_env, "v_graph": v_graph, "v_frag": v_frag, "v_score": v_score, "v_obj": v_obj,
         "v_feat": v_feat, "v_lab": v_lab}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


def _values(rows) -> str:
    def lit(v):
        return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
    return ",".join(f"({k},{lit(s)})" for k, s in rows)


VIEW_SQL = {
    "v_mol": f"""SELECT p.p_partkey AS mol_id, v.smiles AS smiles
FROM part p JOIN (VALUES {_values(MOLECULES)}) AS v(k, smiles) ON p.p_partkey % {len(MOLECULES)} = v.k""",
    "v_env": f"""SELECT p.p_partkey AS mol_id, v.smiles AS smiles, v.logp, v.n_cuts, v.fragments
FROM part p JOIN (VALUES {",".join(f"({k},'{m}',{p},{c},'{f}')" for k, (m, p, c, f) in enumerate(WORKED))}) AS v(k, smiles, logp, n_cuts, fragments)
 ON p.p_partkey % {len(WORKED)} = v.k""",
    "v_graph": f"""SELECT p.p_partkey AS mol_id, v.smiles AS smiles
FROM part p JOIN (VALUES {",".join(f"({k},'{m[0]}')" for k, m in enumerate(GRAPHS))}) AS v(k, smiles) ON p.p_partkey % {len(GRAPHS)} = v.k""",
    "v_frag": f"""SELECT p.p_partkey AS frag_id, v.fragment AS fragment,
 CAST((length(v.fragment) - length(replace(v.fragment,'[*]',''))) / 3 AS INT) AS n_att
FROM part p JOIN (VALUES {_values(FRAGMENTS)}) AS v(k, fragment) ON p.p_partkey % 6 = v.k""",
    "v_score": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax*100 AS logp,
 nullif(l_linenumber,7) AS hbd, CAST(l_quantity AS INT) % 10 AS hba, -l_discount*50 AS logs FROM lineitem""",
    "v_obj": """SELECT l_partkey AS mol_id,
 200 + CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 100000 AS td,
 -CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 2 AS stotal,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 10 AS sa,
 CASE WHEN l_partkey % 3 = 0 THEN 'reasonable' ELSE 'original' END AS source_file
FROM lineitem GROUP BY l_partkey""",
    "v_feat": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS f1, l_discount AS f2, l_tax AS f3,
 CAST(l_linenumber AS DOUBLE) AS f4, l_extendedprice/1000 AS label,
 CASE WHEN (l_partkey*7919 + 42) % 100 < 20 THEN 'test' ELSE 'train' END AS part_set FROM lineitem""",
    "v_lab": """SELECT l.doc_id AS doc_id, CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'No' END AS water_soluble,
 ln(1+d.n_chars) AS x, CAST(d.n_chars % 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS score, (l.doc_id*31 + 42) % 10 AS fold
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as CTEs (for the DuckDB oracle)."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
