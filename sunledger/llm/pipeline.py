"""A corpus pipeline of five stages; each works on all that the stage before kept.

Language ID drops what has no language (null texts, texts without a letter) and fills in
missing labels; the Jaccard join keeps one document of each group of near-duplicates (five
words, similarity 0.8); decontamination drops what gives away a benchmark item; personal data
is replaced by labels; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunledger.llm import decontamination, jaccard_join, language_id, packing, pii
from sunledger.llm.common import materialize, row_id, row_key, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is und; the others keep their label, or get the predicted one."""
    named = language_id.identify(docs, language_id.learn(docs)).filter(F.col("lang_pred") != "und")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of links stays (null ids come last), and all without words.

    Rows alike in doc_id and text are copies of each other, so one of them stays.
    """
    groups = jaccard_join.jaccard_components(docs, shingle=5, percent=80).filter("n_shingles > 0")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row", "th")).alias("d")
    stays = groups.groupBy("group").agg(first).select(F.col("d.row").alias("__id"), F.col("d.th").alias("__th"))
    rows = docs.withColumns({"__id": row_id(F.col("doc_id"), F.col("text")), "__th": row_key(F.col("text"))})
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.filter(worded).join(stays, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return kept.unionByName(rows.filter(~worded)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that give away an item of the benchmark table; null and empty texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by labels, and n_chars follows the text; no document is dropped, null texts stay null."""
    clean = pii.sanitize(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document with its place in a sequence, as op2; null texts are an end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: The models of the first and third stage, and the packing, are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
