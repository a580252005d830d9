"""Remaining table operators: selections, metrics over runs, reshaping, whole pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.operators import chains as C
from strayrows.operators import countmin as CM
from strayrows.operators import metrics as M
from strayrows.operators import prep as P
from strayrows.operators import rules as R
from strayrows.operators.explore import parallel_view
from strayrows.operators.project import vectorize
from strayrows.plans import pipeline
from strayrows.plans import sql_parts as S
from strayrows.plans.detect_queries import ATTRIBUTION, LABELLED, labelled_scores, top_attribution
from strayrows.plans.registry import query
from strayrows.plans.rule_queries import BASE, rule_base, rules, rules_sql
from strayrows.plans.views import (
    ORDER_NUMERIC,
    ORDER_NUMERIC_SPEC,
    ORDER_SPEC,
    shared,
    staged_orders,
    table,
)
from strayrows.sources.tables import lengthen, read_attribute_file, read_named, widen
from strayrows.staging import run_dir, stage


@query("select_by_label", LABELLED + "SELECT row_id FROM s WHERE label = 1")
def select_by_label(spark, sf_dir):
    return P.select_outliers(labelled_scores(spark, sf_dir), 10, use_label=True).select("row_id")


@query("first_rows", "SELECT o_orderkey AS row_id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 300")
def first_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice"
    )
    return P.first_rows(orders, 300)


@query("shuffled_rows", "SELECT o_orderkey AS row_id FROM orders")
def shuffled_rows(spark, sf_dir):
    return P.shuffled(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")), 3)


@query(
    "mean_over_runs",
    """SELECT round(avg(f1), 6) AS mean_f1, count(*) AS n_runs FROM (
  SELECT lang, 2.0::DOUBLE * sum(toxic * p) / sum(toxic + p) AS f1
  FROM (SELECT lang, toxic, (n_chars >= 2000)::INT AS p FROM documents JOIN labels USING (doc_id)) GROUP BY lang)""",
)
def mean_over_runs(spark, sf_dir):
    """F1 of a length threshold, averaged over the document languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "lang", F.col("toxic").alias("label"), F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("prediction")
    )
    per_run = rows.groupBy(F.col("lang").alias("run")).agg(
        F.try_divide(
            2.0 * F.sum(F.col("label") * F.col("prediction")), F.sum(F.col("label") + F.col("prediction"))
        ).alias("f1")
    )
    return M.mean_over_runs(per_run, "f1").withColumn("mean_f1", F.round("mean_f1", 6))


@query(
    "wide_attribution",
    S.with_(*ATTRIBUTION)
    + "SELECT row_id, "
    + ", ".join(f"round(max(importance) FILTER (WHERE feature = '{f}'), 6) AS {f}_ex" for f in ORDER_NUMERIC)
    + " FROM attr GROUP BY row_id",
)
def wide_attribution(spark, sf_dir):
    wide = widen(top_attribution(spark, sf_dir), ORDER_NUMERIC_SPEC)
    return wide.select("row_id", *[F.round(f + "_ex", 6).alias(f + "_ex") for f in ORDER_NUMERIC])


@query(
    "long_attribution",
    S.with_(*ATTRIBUTION) + "SELECT row_id, feature, round(importance, 6) AS importance FROM attr",
)
def long_attribution(spark, sf_dir):
    long = lengthen(widen(top_attribution(spark, sf_dir), ORDER_NUMERIC_SPEC), ORDER_NUMERIC_SPEC)
    return long.withColumn("importance", F.round("importance", 6))


@query(
    "parallel_view",
    S.with_(
        S.ORDER_FEATURES,
        "st AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS s FROM (SELECT DISTINCT o_orderstatus FROM of))",
        "pr AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS p FROM (SELECT DISTINCT o_orderpriority FROM of))",
    )
    + "SELECT row_id, "
    + ", ".join(ORDER_NUMERIC)
    + ", s AS o_orderstatus, p AS o_orderpriority FROM of JOIN st USING (o_orderstatus) JOIN pr USING (o_orderpriority)",
)
def parallel(spark, sf_dir):
    return parallel_view(staged_orders(spark, sf_dir), ORDER_SPEC)


@query(
    "merge_rules",
    S.with_(*BASE)
    + """SELECT k, cluster_id, 'all' AS rule_id, feature, kind, round(min(lo), 5) AS lo, round(max(hi), 5) AS hi,
  min(value) AS value FROM base GROUP BY k, cluster_id, feature, kind""",
)
def merge_rules(spark, sf_dir):
    """All base conditions of a cluster merged into one rule."""
    conditions = rule_base(spark, sf_dir).withColumn("rule_id", F.lit("all"))
    merged = R.merge_table(conditions, ["k", "cluster_id", "rule_id"])
    return merged.withColumns({"lo": F.round("lo", 5), "hi": F.round("hi", 5)})


@query(
    "without_feature",
    rules_sql(
        "SELECT k, cluster_id, regexp_replace(rule_text, 'Feature o_totalprice between: [0-9.]+ and [0-9.]+[.]', '') AS rule_text FROM scored"
    ),
)
def without_feature(spark, sf_dir):
    """Rules after the user dropped the price condition."""
    kept = R.without_feature(F.col("rule"), "o_totalprice")
    return rules(spark, sf_dir).select("k", "cluster_id", R.rule_text(kept).alias("rule_text"))


@query(
    "class_union",
    """SELECT event_id, event_type, 0 AS anomaly FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, event_type, 1 FROM events WHERE event_type = 'error'""",
)
def class_union(spark, sf_dir):
    """Two classes of a table put together and labelled."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    both = events.where(F.col("event_type") == "click").unionByName(
        events.where(F.col("event_type") == "error")
    )
    flagged = P.binary_label(both.withColumn("kind", F.col("event_type")), "kind", "click", "anomaly")
    return flagged.select("event_id", "event_type", "anomaly")


PIPELINE = pipeline.Parameters(topk=60, top_features=4, seed=2, shape=CM.SketchShape(bits=12))


def found(spark: SparkSession, sf_dir: str) -> pipeline.Detection:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _found:
        _found[key] = pipeline.detect(staged_orders(spark, sf_dir), ORDER_SPEC, PIPELINE)
    return _found[key]


_found: dict[tuple, pipeline.Detection] = {}


@query("detect_default")
def detect_default(spark, sf_dir):
    """The 300 strangest orders by the usual ensemble: 60 dimensions, 300 chains of depth 20, 2^16 counters."""
    vectors = vectorize(staged_orders(spark, sf_dir), ORDER_SPEC, 60)  # anew in every pass: 60 numbers a row would fill the disk
    usual = pipeline.Parameters()
    detector = CM.CountMinDetector(usual.projdim, usual.nchains, usual.depth, seed=1, shape=usual.shape)
    return C.top_k(detector.fit(vectors).score(vectors), usual.topk)


@query("reload_result")
def reload_result(spark, sf_dir):
    """The wide result from a detection that was saved and read back."""
    orders, path = staged_orders(spark, sf_dir), f"{run_dir(spark)}/{uuid.uuid4().hex}/saved"
    pipeline.save(orders, ORDER_SPEC, found(spark, sf_dir), described(spark, sf_dir), path)
    return pipeline.joined(orders, ORDER_SPEC, pipeline.load(spark, path))


@query("reload_rules")
def reload_rules(spark, sf_dir):
    """Rules of a reloaded detection, saved and read back."""
    orders, path = staged_orders(spark, sf_dir), f"{run_dir(spark)}/{uuid.uuid4().hex}/saved"
    pipeline.save(orders, ORDER_SPEC, found(spark, sf_dir), described(spark, sf_dir), path)
    return R.accepted_rules(R.top_rules(pipeline.load_rules(spark, path), 0.05, 0.05))


@query("pipeline_result")
def pipeline_result(spark, sf_dir):
    """Detection, attribution and clusters of mixed rows as one wide table."""
    return pipeline.joined(staged_orders(spark, sf_dir), ORDER_SPEC, found(spark, sf_dir))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "pipeline-rules",
        lambda: pipeline.describe(staged_orders(spark, sf_dir), ORDER_SPEC, found(spark, sf_dir), PIPELINE),
    )


@query("pipeline_rules")
def pipeline_rules(spark, sf_dir):
    return R.accepted_rules(R.top_rules(described(spark, sf_dir), 0.05, 0.05))


def _text_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string").coalesce(1).orderBy("i").select("value").write.mode("append").text(path)


@query(
    "attribute_file",
    """SELECT c_custkey::DOUBLE AS c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS "account balance", c_mktsegment
FROM customer""",
)
def attribute_file(spark, sf_dir):
    """Customers written with declarations of their columns, and read by them."""
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}/customers"
    _text_lines(spark, ["% customers", "@relation customer", "@attribute c_custkey numeric", "@attribute 'account balance' real", "@attribute c_mktsegment {AUTOMOBILE,BUILDING}", "@data"], path)
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("?")
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(", ", F.col("c_custkey").cast("string"), balance, "c_mktsegment").alias("value"))
    rows.write.mode("append").text(path)
    return read_attribute_file(spark, path)


@query(
    "names_file",
    "SELECT p_brand AS brand, p_size::DOUBLE AS size, p_type AS kind, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM part",
)
def names_file(spark, sf_dir):
    """Parts without a header, read by the file that names their columns."""
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    _text_lines(spark, ["| brands come first", "Brand#1, Brand#2.   | and so on", "", "size:  continuous.", "kind: PROMO, STANDARD.", "price: continuous."], f"{path}/names")
    price = F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).otherwise("?")
    table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type", price.alias("price")).write.csv(f"{path}/data")
    return read_named(spark, f"{path}/data", f"{path}/names", label="brand")
