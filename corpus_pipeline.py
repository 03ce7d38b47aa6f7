"""A training corpus from ``documents``: quality, near-duplicates, PII, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``. Rows without a doc_id are kept by the near-duplicate stage, since
nothing tells which of them stands for its class; of rows that repeat a doc_id with the same text one stays. Where a doc_id stands
for different texts, each of its rows is decided by its own class. Null and empty texts, and texts without a word, are no
near-duplicates of anything and go through every stage that the classifier lets them reach; empty tables stay empty; further
columns, of any name, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.llm import mixing, nearjoin, pieces, pii, quality
from gaugeweave.llm.storage import durable, free_name, new_folder, sized_join

#: SQL can't fit the classifier, so there is no oracle for run(); tests compare it with the stages' brute-force versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_on(docs, labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest doc_id."""
    classes = durable(nearjoin.near_classes(docs, by_row=True).select("doc_id", "class_id", "text_hash", "class_node"))
    gone = durable(classes.filter("doc_id <> class_id").select("doc_id").distinct())
    repeated = durable(classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return sized_join(docs, gone, "doc_id", "left_anti")
    once = sized_join(sized_join(docs, repeated, "doc_id", "left_anti"), gone, "doc_id", "left_anti")
    # texts without a word are classes of their own; of several texts of one class that share its id, one stays
    mine = sized_join(classes.filter("doc_id = class_id"), repeated, "doc_id", "left_semi")
    stay = mine.groupBy("doc_id", F.col("class_node").isNull().alias("_own"), F.coalesce("class_node", "text_hash").alias("_class")).agg(F.min("text_hash").alias("_hash"))
    digest = free_name(docs.columns, "_hash")
    several = sized_join(docs, repeated, "doc_id", "left_semi").withColumn(digest, F.xxhash64("text"))
    several = sized_join(several, durable(stay.select("doc_id", F.col("_hash").alias(digest))), ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest])
    return once.unionByName(several.drop(digest))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows."""
    return pii.with_surrogates(docs, kinds_col=free_name(docs.columns, "pii_kinds")).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its weight asks; none is left out."""
    return mixing.mixed_documents(docs, marks=())


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return pieces.encoded(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
