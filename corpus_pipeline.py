"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.line_dedup import line_dedup
from strayrows.llm.ngram_join import near_duplicates
from strayrows.llm.packing import pack
from strayrows.llm.quality_rules import quality
from strayrows.llm.substring_dedup import substring_dedup
from strayrows.staging import stage


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that no operator adds, and the new name of each column."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _rewritten(names: dict[str, str], found: DataFrame, changed: Column) -> DataFrame:
    """The columns of documents; where `changed`, with the text that stays and its length."""
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col(names["text"])),
        "n_chars": F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col(names["n_chars"])),
    }
    return found.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits of their language and source, unchanged."""
    own, n = _renamed(docs)
    by = (n["lang"], n["source"])
    found = quality(own, n["doc_id"], n["text"], by, keep=tuple(own.columns)).where("kept")
    return found.select(*[F.col(x).alias(c) for c, x in n.items()])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of earlier ones; those with no line left that has a word go."""
    own, n = _renamed(docs)
    found = line_dedup(own, n["doc_id"], n["text"], tuple(own.columns)).where("n_removed = 0 OR n_removed < n_lines")
    return _rewritten(n, found, F.col("n_removed") > 0)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5 words, similarity 0.8) the document with the smallest doc_id.

    Rows that repeat a doc_id and its text are one document.
    """
    found = stage(near_duplicates(docs), "near-duplicates").alias("f")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("g")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash"))
    left = d.join(gone, same, "left_anti")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of earlier ones; those with no word left go."""
    own, n = _renamed(docs)
    found = substring_dedup(own, n["doc_id"], n["text"], tuple(own.columns), layout=True)
    return _rewritten(n, found.where("n_removed = 0 OR n_removed < n_words"), F.col("n_removed") > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its length, bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_ngrams),
    ("substring dedup", dedup_substrings),
    ("packing", packing),
]

#: Edit distances, components, automata and dynamic programming are beyond one SQL statement; tests compare
#: run() with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
