"""Documents to packed sequences: quality rules, line dedup, near duplicates, decontamination, packing.

STAGES are (name, function(spark, docs, sf_dir) -> DataFrame); all but the last return the columns of documents.
Each is written as Parquet in the shared folder and reread as the docs of the next.

Null texts have no words: quality rules reject them. Rows of a null id are judged by their texts and never take part in line dedup or near-duplicate groups; repeated rows share one fate in every stage,
but for the groups, of which all rows of the least id stay. Ties go to the least id. Texts are read whole. Columns of any other names pass through all stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, jaccard, line_dedup, packing, quality
from tallyforge.sources.tables import load, written

#: The stages before packing run Python rules, so no SQL gives the rows; the tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word Jaccard 0.8 the document of the least id stays, and rows of a null id."""
    groups = jaccard.jaccard_components(docs, 5, 80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(written(groups, "near-duplicates"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
