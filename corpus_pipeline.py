"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlog.llm.decontaminate import decontaminate
from arborlog.llm.language_id import UNKNOWN, fit_language_model, predict_language
from arborlog.llm.ngram_join import ngram_jaccard_join
from arborlog.llm.private_data import sanitise
from arborlog.llm.source_mix import mix_by_cycle
from arborlog.llm.textkit import crc_remainder, lighten, release, small, written

#: A document whose best language has a lower pooled probability is rejected: near the chance of a guess.
LEAST_SCORE = 0.3


def _free(name: str, docs: DataFrame) -> str:
    """The name, or a longer one that docs has no column of."""
    while name in docs.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not ``und`` and not near a guess.  The model learns from the documents' own lang.

    Null and empty texts and those without a letter go; where no document names a language, there is no
    model and all stay; an empty table gives no rows.
    """
    lighten(spark)
    model = fit_language_model(docs.where(crc_remainder("doc_id", 4) != 2))
    if model is None:
        return docs
    lang, score = _free("__lang", docs), _free("__score", docs)
    found = predict_language(docs, model, lang, score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id.

    A row without an id goes by a number made of its text, above ordinary ids, so it stays only where no
    row with an id is like it.  Of rows that repeat an id and a text one stays; rows of one id with
    different texts stay together or go together.  An empty table gives no rows.
    """
    key = _free("__key", docs)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)))
    groups = written(ngram_jaccard_join(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id"))
    gone = written(groups.where(F.col(key) != F.col("component_id")).select(key).distinct())
    twice = written(groups.groupBy(key).count().where("count > 1").select(key))
    release(groups)
    kept = keyed.join(small(gone, gone.count()), key, "left_anti")
    if n := twice.count():
        once = kept.join(small(twice, n), key, "left_semi").dropDuplicates([key, "text"])
        kept = kept.join(small(twice, n), key, "left_anti").unionByName(once)
    return kept.select(docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, each judged by its own text."""
    lighten(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with personal data and terms that reveal it generalised or removed."""
    lighten(spark)
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it."""
    lighten(spark)
    return mix_by_cycle(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontaminate", clean_of_benchmarks),
    ("private_data", personal_data),
    ("source_mix", mix),
]
#: Learnt models and seeded hashes are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
