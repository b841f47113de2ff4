"""The subpackage's queries, opN_<name>, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import decontam, html, jaccard, licenses, line_dedup, lm, merkle, negatives, packing, quality, secrets, toxicity, warc
from tallyforge.sources.tables import load

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where("quality = 1"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), TOKENIZER, special=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(load(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(load(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(load(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents")).drop("base", "linked")


QUERIES = {f.__name__: f for f in (op1_warc, op2_lm_scoring, op3_license_scan, op4_line_dedup, op5_packing, op6_decontamination, op7_quality_rules, op8_html_extraction, op9_toxicity, op10_jaccard_join, op11_merkle_manifest, op12_hard_negatives, op13_secret_scan)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL = {"op1_warc": warc.SQL, "op4_line_dedup": "WITH " + line_dedup.SQL.format(src="documents") + " SELECT doc_id, text, n_lines, n_removed FROM cut", "op11_merkle_manifest": merkle.SQL, "op12_hard_negatives": negatives.SQL, "op13_secret_scan": secrets.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
