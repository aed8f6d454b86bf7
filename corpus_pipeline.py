"""Language ID, exact dedup, near-duplicates, packing: documents to training sequences.

Each stage is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap.llm import exact_dedup, langid, packing, similar
from weftmap.llm.common import drop_rows, file_backed, hot_bound, join_sized, materialise, table, with_locator
from weftmap.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without any letter go, and only they if no language can be learnt."""
    counts = langid.learn(docs)
    if not counts.languages:
        return docs.where(langid.lettered(F.col("text")))
    predict = langid.predictor_of(spark, counts)
    return docs.withColumn("__wm_lang", predict(F.col("text"))).where(F.col("__wm_lang.lang_pred") != langid.UND).drop("__wm_lang")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best document of each group of equal texts."""
    docs = file_backed(docs)
    groups = exact_dedup.exact_groups(docs)
    return drop_rows(docs, groups.where(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Documents link if their sets of five-word shingles have a similarity of 0.8 or more; of
    rows that share the smallest id the first stays. A group is known by its root, as ids
    may be null or repeated.
    """
    docs = file_backed(docs)
    located = with_locator(docs.select("doc_id", "text"))
    found = materialise(similar.near_groups(located, keep=("doc_id",)), "near")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "__wm_file", "__wm_row")
    best = materialise(found.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n")), "best")
    kept = best.where("n > 1").select("root", F.col("best.__wm_file").alias("f"), F.col("best.__wm_row").alias("r"), "n")
    together = join_sized(found, kept, "root", hot_bound(found.count()))
    gone = together.where((F.col("__wm_file") != F.col("f")) | (F.col("__wm_row") != F.col("r")))
    return drop_rows(docs, gone)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids."""
    return packing.decompose(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: SQL has neither the language models nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
