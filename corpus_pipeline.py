"""Corpus pipeline over ``documents``: five stages, each written as Parquet and
read again as the next one's documents.

All stages but the last keep the columns of their input.  Defined results:
rows of equal id and text are one document; null ids are ids like any other,
and rows that share an id but not a text are documents of their own; an empty
table runs through; input columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm.bpe import tokenised
from depotlens.llm.common import table, written
from depotlens.llm.exact_dedup import exact_dedup
from depotlens.llm.langid import without_rejected
from depotlens.llm.mixing import mix
from depotlens.llm.simhash import simhash_dedup


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def identity() -> Column:
    """What tells documents apart, never null: smaller ids first, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), sha().alias("sha"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    return without_rejected(docs)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays, as one row."""
    # a key without nulls, the same for both steps: texts are shuffled once
    id_, sha_ = unused(docs, "__id"), unused(docs, "__sha")
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    kept = exact_dedup(docs).where("kept").select(name.alias(id_), F.col("text_sha256").alias(sha_)).distinct()
    rows = docs.withColumn(id_, name).withColumn(sha_, sha()).dropDuplicates([id_, sha_])
    return rows.join(kept.hint("merge"), [id_, sha_], "left_semi").select(docs.columns)


def one_of_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash component the document of the smallest id stays (of
    null ids only: one of them)."""
    key = unused(docs, "__key")
    keyed = docs.withColumn(key, identity())
    groups = simhash_dedup(keyed.select(key, "text"), words=3, distance=2, id_col=key)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id.sha").alias("sha"), F.col("doc_id.none").alias("none"),
                                                        F.coalesce("doc_id.id", F.lit(0)).alias("id")).distinct()
    # the struct holds a null, which no join key may: its parts do not
    kept = kept.select(F.struct("none", "id", "sha").alias(key)).hint("merge")
    whole = F.struct(F.col(f"{key}.none"), F.coalesce(F.col(f"{key}.id"), F.lit(0)).alias("id"), F.col(f"{key}.sha"))
    return keyed.withColumn(key, whole).join(kept, key, "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows of equal id, source
    and text are one document, taken as often as all of them."""
    key, copies_, copy_ = unused(docs, "__key"), unused(docs, "__copies"), unused(docs, "__copy")
    parts = lambda text: F.concat_ws(" ", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")),
                                     text, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    taken = mix(docs).where("copies > 0").groupBy(parts(F.col("digest")).alias(key)).agg(F.sum("copies").cast("int").alias(copies_))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.withColumn(key, parts(digest)).dropDuplicates([key]).join(taken.hint("merge"), key)
    return rows.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(copies_)))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of what they decode to."""
    return tokenised(docs)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_equal_texts),
    ("SimHash near-dedup", one_of_near_texts),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Language ID, SimHash and BPE have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
