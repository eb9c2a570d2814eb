"""What grows with the tables: tasks and part files of queries on large ones."""

import pytest
from pyspark.sql import functions as F

from molsift.operators import fragments as FR
from molsift.plans import fragments, streaming
from molsift.session import spread
from molsift.sources import views


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """A table of parts in a single file of a single row group."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.range(9_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_rows_are_dealt_out_by_their_number(spark):
    dealt = spread(spark.range(2_500).coalesce(1), rows=1_000)
    assert sorted(len(p) for p in dealt.rdd.glom().collect()) == [833, 833, 834]
    assert spread(spark.range(900).coalesce(1), rows=1_000).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name, rows", [("v_mol", 9_000), ("v_env", 9_000), ("v_graph", 9_000), ("v_frag", 9_000)])
def test_molecules_of_one_file_come_in_many_tasks(spark, one_file, name, rows):
    v = views.view(spark, one_file, name)
    assert v.rdd.getNumPartitions() == 3 and v.distinct().count() == rows


def test_pairs_are_dealt_out_after_the_join(spark, one_file):
    p = fragments.pairs(spark, one_file)
    sizes = [len(x) for x in p.select("frag_id").rdd.glom().collect()]
    assert sum(sizes) == 8_999 and len(sizes) == 3 and max(sizes) <= 4_000


def test_the_first_rule_that_fits_labels_a_cut(spark):
    """Ends with several environments, in either direction, and a double bond."""
    from molsift.functions import smiles as S
    df = spark.createDataFrame([("CC(=O)OC",), ("COC(C)=O",), ("CC=CC",), ("c1ccc(-c2ccccn2)cc1",), ("C1CCCCC1",)], "smiles string")
    got = {r["smiles"]: [(c["a"], c["b"], c["la"], c["lb"]) for c in r["cuts"]] for r in FR.cut_bonds(S.mol_graph(df)).collect()}
    assert got["CC(=O)OC"] == [(1, 3, 1, 3)] and got["COC(C)=O"] == [(1, 2, 3, 1)]
    assert got["CC=CC"] == [(1, 2, 7, 7)] and got["C1CCCCC1"] == []
    assert [c[2:] for c in got["c1ccc(-c2ccccn2)cc1"]] == [(16, 14)]


@pytest.mark.parametrize("rows, files", [(500, 20), (100_000, 4)])
def test_stream_of_parts_of_bounded_files(spark, rows, files):
    sdf, base = streaming._arriving(spark, spark.range(10_000), 4, rows)
    written = spark.read.parquet(f"{base}/in").groupBy(F.input_file_name()).count().collect()
    assert len(written) == files and max(r["count"] for r in written) <= max(rows, 2_500)
    came = []
    sdf.writeStream.foreachBatch(lambda df, _: came.append(df.count())).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(came) == 4 and sum(came) == 10_000
