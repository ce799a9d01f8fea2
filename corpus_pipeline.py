"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next one's ``docs``. All stages but the last return the columns of ``docs`` and work on whatever columns there
are besides ``doc_id``, ``text`` and (language) ``lang``.

A row with a null text is rejected as undetermined language. Rows without an id pass every stage on their own
merits. Of rows that repeat id and text, near-dedup keeps one; rows that share an id but not the text are documents of
their own there. Extra columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, language, minhash, packing, pseudonyms
from tallygrid.llm.tables import Scratch, free_name, salted_number

LEAST_SCORE = 0.5  # below this no language has the better odds against all others together


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents stay whose language is determined with at least even odds."""
    path = language.vocabulary_path()
    model = language.fit_documents(spark, docs, path)
    lang, score = free_name(docs.columns, "_lang_pred"), free_name(docs.columns, "_lang_score")
    named = language.predict(docs, model, path, prediction=lang, score=score)
    return named.where((F.col(f"`{lang}`") != language.UNDETERMINED) & (F.col(f"`{score}`") >= LEAST_SCORE)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def one_id_per_text(spark: SparkSession, docs: DataFrame, node: str) -> DataFrame:
    """Add ``node``: the document id, or a number beyond all ids for the texts that share an id with another one.

    Ids with several texts are looked for by digests; without any, the rows are left as they are.
    """
    scratch = Scratch(spark, "texts")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    keyed = scratch.keep(docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), digest.alias("_key")), "keyed")
    shared = keyed.groupBy("_id").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).where("lo < hi").select("_id", "lo")
    # the first text of an id keeps it
    others = scratch.keep(keyed.join(shared, "_id").where("_key > lo").select("_id", "_key").distinct(), "others")
    if others.isEmpty():
        return docs.withColumn(node, F.col("doc_id"))
    top = keyed.agg(F.max("_id")).first()[0]
    numbered = scratch.keep(salted_number(others, [], ["_id", "_key"], "_turn").select(
        "_id", "_key", (F.lit(top) + 1 + F.col("_turn")).alias("_node")), "numbered")
    own, key, made = (free_name(docs.columns, c) for c in ("_id", "_key", "_node"))
    renamed = numbered.select(F.col("_id").alias(own), F.col("_key").alias(key), F.col("_node").alias(made))
    met = docs.join(renamed, (F.col("doc_id") == F.col(own)) & (digest == F.col(key)), "left")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(made), F.col("doc_id")).alias(node))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each group stays, one row of it."""
    node, name = free_name(docs.columns, "_node_of_text"), free_name(docs.columns, "_kept")
    named = one_id_per_text(spark, docs, node)
    judged = minhash.near_duplicates(spark, named, width=5, percent=80, id_column=node)
    kept = judged.where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    stay = named.join(kept, F.col(node) == F.col(name), "left_semi").dropDuplicates([node]).drop(node)
    return stay.unionByName(docs.where("doc_id is null"))


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: validated values in the texts become pseudonyms of the same format. Text lengths follow."""
    done = pseudonyms.pseudonymise(docs, key=pseudonyms.session_key(spark) or pseudonyms.SAMPLE_KEY)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every document's pieces with their place in a sequence."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("language ID", keep_identified),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", keep_clean_of_benchmarks),
    ("PII", replace_personal_data),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # no stage's model, signatures, permutations or tokenizer can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = done if k == len(STAGES) - 1 else scratch.keep(done, name.lower().replace(" ", "-"))
    return docs
