"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from molsift.llm.common import read_table
from molsift.llm.decontaminate import contaminated
from molsift.llm.hard_negatives import mine_negatives
from molsift.llm.html_text import extract_main_text
from molsift.llm.jaccard_join import ngram_join
from molsift.llm.line_dedup import line_report
from molsift.llm.mixing import mix_sources
from molsift.llm.oracles import ORACLES  # noqa: F401
from molsift.llm.pii import KINDS, detect_pii, span_text
from molsift.llm.quality_model import score_quality
from molsift.llm.quality_rules import quality_rules
from molsift.llm.repeat_index import mark_repeats
from molsift.llm.sharding import shard
from molsift.llm.token_alignment import align_tokenizers
from molsift.llm.warc import archive_and_read


def op1_pii(spark, sf_dir):
    found = detect_pii(read_table(spark, sf_dir, "documents"))

    def is_kind(no):
        return lambda x: x.kind == no

    counts = [F.size(F.filter("base", is_kind(no))).cast("long").alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op2_line_dedup(spark, sf_dir):
    return line_report(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark, sf_dir):
    return mix_sources(read_table(spark, sf_dir, "documents")).drop("copies")


def op4_quality_model(spark, sf_dir):
    return score_quality(read_table(spark, sf_dir, "documents"))


def op5_shard(spark, sf_dir):
    return shard(read_table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op7_warc(spark, sf_dir):
    return archive_and_read(read_table(spark, sf_dir, "pages"))


def op8_decontaminate(spark, sf_dir):
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id").drop("text_hash")


def op9_ngram_join(spark, sf_dir):
    return ngram_join(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents"))


#: Where the vocabularies lie.
TOKENIZERS = "/opt/tokenizers"


def op11_token_alignment(spark, sf_dir):
    return align_tokenizers(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def op12_repeated_passages(spark, sf_dir):
    marked = mark_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", label))


QUERIES = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_mix_sources, op4_quality_model, op5_shard, op6_html_text, op7_warc, op8_decontaminate, op9_ngram_join, op10_quality_rules, op11_token_alignment, op12_repeated_passages, op13_hard_negatives)}
