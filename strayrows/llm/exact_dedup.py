"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text, its white-space runs replaced by one space, is cut where its own content says so. A
document is then the ordered list of its chunks' identifiers, and equal lists are equal
texts: long documents are grouped and joined as a few numbers. A chunk's identifier is its
64-bit hash, verified over the whole corpus: every distinct chunk is moved once, and hashes
that two different chunks share get an ordinal for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strayrows.llm.registry import query, table
from strayrows.staging import stage

WHITE = "[\\x20\\x09-\\x0D]+"
#: A cut may follow a vowel, one of four frequent consonants and a space or a mark.
CUT = "[aeiou][dnrs][ ,.]"


def normalized(text: Column) -> Column:
    """White-space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def chunks(text: Column, least: int = 1024, most: int = 8192) -> Column:
    """Cuts `text` at the first CUT after `least` characters, or after `most`; nothing is lost."""
    return F.regexp_extract_all(
        text, F.lit(f"(?s).{{{least - 3},{most - 3}}}?{CUT}|.{{1,{most}}}"), F.lit(0)
    )


def exact_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    chunk_hash: Callable[[Column], Column] = lambda chunk: F.xxhash64(chunk),
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Of equal texts the smallest doc_id stays. A null text counts as empty. A null doc_id is
    larger than any other: it stays only where all doc_ids of its group are null. Rows that
    repeat both doc_id and text count in group_size and get the same answer. No rows: no rows.
    """
    source = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("doc_id"), normalized(F.col(f"`{text}`")).alias("norm")
    )
    recipes = stage(
        source.select(
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm")), chunk_hash).alias("recipe"),
        ),
        "recipes",
    )
    # The distinct aggregate combines before the shuffle, so a chunk leaves each task once.
    distinct = (
        source.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
        .select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
        .distinct()
    )
    shared = stage(distinct.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
    if not shared.isEmpty():
        recipes = _told_apart(source, recipes, shared, chunk_hash)
    groups = stage(
        recipes.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "groups",
    )
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _told_apart(source: DataFrame, recipes: DataFrame, shared: DataFrame, chunk_hash) -> DataFrame:
    """Recipes of (hash, ordinal) pairs, where different chunks share a hash."""
    pieces = source.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.posexplode(chunks(F.col("norm"))).alias("at", "chunk"),
    ).distinct().withColumn("h", chunk_hash(F.col("chunk")))
    clashing = pieces.join(shared, "h", "left_semi")
    ordinals = stage(
        clashing.select("h", "chunk").distinct().withColumn(
            "ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
        ),
        "ordinals",
    )
    told = stage(
        clashing.join(ordinals, ["h", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "ordinal"))).alias("ordinals")),
        "told-apart",
    )
    same = recipes["doc_id"].eqNullSafe(told["doc_id"]) & (recipes["text_sha256"] == told["text_sha256"])
    ordinal = lambda i: F.coalesce(F.try_element_at(told["ordinals"], i), F.lit(1))
    return recipes.join(told, same, "left").select(
        recipes["doc_id"],
        recipes["text_sha256"],
        F.transform(
            recipes["recipe"], lambda h, i: F.struct(h.alias("h"), ordinal(i).alias("ordinal"))
        ).alias("recipe"),
    )


SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@query("op10_exact_dedup", SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
