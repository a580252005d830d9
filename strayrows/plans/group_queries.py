"""Grouping, preparation and exploration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrows.operators import attribute as A
from strayrows.operators import explore as X
from strayrows.operators import grouping as G
from strayrows.operators import prep as P
from strayrows.operators import ranking as R
from strayrows.plans import sql_parts as S
from strayrows.plans.detect_queries import (
    ATTRIBUTION,
    CLUSTERS,
    DETECT,
    TOP,
    top_attribution,
    top_clusters,
    top_orders,
    order_scores,
)
from strayrows.plans.registry import query
from strayrows.plans.views import ORDER_NUMERIC, embeddings, shared, staged_orders, table

# ------------------------------------------------------------------ grouping

EMB = """emb AS MATERIALIZED (SELECT vec_id AS row_id, label AS cluster_id, embedding::DOUBLE[] AS e FROM embeddings)"""
EMB_DIST = """pair AS (SELECT a.row_id, a.cluster_id, b.cluster_id AS other_id, b.row_id AS other_row,
    list_distance(a.e, b.e) AS d FROM emb a, emb b WHERE a.row_id <> b.row_id),
md AS MATERIALIZED (SELECT 10 AS k, row_id, cluster_id, other_id, count(*) AS n, sum(d) / count(*) AS mean_distance
  FROM pair GROUP BY row_id, cluster_id, other_id)"""


def embedding_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = embeddings(spark, sf_dir)
    clusters = e.select(F.lit(10).alias("k"), "row_id", "cluster_id")
    return e.select("row_id", F.col("x").alias("v")), clusters


def _embedding_distances(spark, sf_dir) -> DataFrame:
    return shared(
        spark, sf_dir, "embedding-distances",
        lambda: G.cluster_distances(*embedding_clusters(spark, sf_dir)),
    )


@query(
    "cluster_distances",
    S.with_(EMB, EMB_DIST)
    + "SELECT k, row_id, cluster_id, other_id, n, round(mean_distance, 5) AS mean_distance FROM md",
)
def cluster_distances(spark, sf_dir):
    return _embedding_distances(spark, sf_dir).withColumn(
        "mean_distance", F.round("mean_distance", 5)
    )


@query(
    "silhouette",
    S.with_(EMB, EMB_DIST)
    + """SELECT k, round(avg(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM (SELECT k, row_id, max(CASE WHEN own THEN mean_distance END) AS a,
             min(CASE WHEN NOT own THEN mean_distance END) AS b
      FROM (SELECT *, cluster_id = other_id AS own FROM md) GROUP BY k, row_id) GROUP BY k""",
)
def silhouette(spark, sf_dir):
    return G.silhouette(_embedding_distances(spark, sf_dir)).withColumn(
        "silhouette", F.round("silhouette", 6)
    )


LABELLED = """pt AS MATERIALIZED (SELECT row_id, o_totalprice / 100000 AS x, qty / 50 AS y,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS c3, left(o_orderpriority, 1)::INT - 1 AS c5 FROM of)"""


@query(
    "silhouette_orders",
    S.with_(
        S.ORDER_FEATURES,
        LABELLED,
        """pd AS MATERIALIZED (SELECT a.row_id, a.c3, a.c5, b.c3 AS o3, b.c5 AS o5, count(*) AS n,
  sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM pt a, pt b WHERE a.row_id <> b.row_id
  GROUP BY ALL)""",
        """md AS (SELECT 3 AS k, row_id, c3 = o3 AS own, sum(d) / sum(n) AS m FROM pd GROUP BY row_id, c3, o3
  UNION ALL SELECT 5, row_id, c5 = o5, sum(d) / sum(n) FROM pd GROUP BY row_id, c5, o5)""",
        """ab AS (SELECT k, row_id, max(CASE WHEN own THEN m END) AS a, min(CASE WHEN NOT own THEN m END) AS b FROM md GROUP BY k, row_id)""",
    )
    + "SELECT k, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab GROUP BY k",
)
def silhouette_orders(spark, sf_dir):
    """All orders, grouped by status and by priority, both in one pass over pairs of blocks."""
    orders = staged_orders(spark, sf_dir)
    points = orders.select("row_id", F.array(F.col("o_totalprice") / 100000, F.col("qty") / 50).alias("v"))
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    priority = F.left("o_orderpriority", F.lit(1)).cast("int") - 1
    of = lambda k, c: orders.select(F.lit(k).alias("k"), "row_id", c.alias("cluster_id"))
    found = G.silhouette(G.cluster_distances(points, of(3, status).unionByName(of(5, priority))))
    return found.withColumn("silhouette", F.round("silhouette", 6))


@query("embed_2d")
def embed_2d(spark, sf_dir):
    points, _ = embedding_clusters(spark, sf_dir)
    return G.embed_2d(points)


def _sweep(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points = shared(
        spark, sf_dir, "outlier-points",
        lambda: G.embed_2d(A.to_vectors(top_attribution(spark, sf_dir), ORDER_NUMERIC)),
    )
    clusters = shared(spark, sf_dir, "outlier-clusters", lambda: G.cluster_sweep(points, 10))
    return points, clusters


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return G.cluster_options(_sweep(spark, sf_dir)[1])


@query("kmeans_best_k")
def kmeans_best_k(spark, sf_dir):
    points, clusters = _sweep(spark, sf_dir)
    v = points.select("row_id", F.array("x", "y").alias("v"))
    return G.best_k(G.silhouette(G.cluster_distances(v, clusters)))


@query(
    "cluster_options",
    S.with_(*DETECT, S.top(TOP), CLUSTERS)
    + "SELECT k, cluster_id, count(*) AS n FROM cl GROUP BY k, cluster_id",
)
def cluster_options(spark, sf_dir):
    return G.cluster_options(top_clusters(spark, sf_dir))


@query(
    "cluster_members",
    S.with_(*DETECT, S.top(TOP), CLUSTERS)
    + "SELECT row_id, o_totalprice, qty FROM of SEMI JOIN (SELECT row_id FROM cl WHERE cluster_id = 1) USING (row_id)",
)
def cluster_members(spark, sf_dir):
    rows = G.members(staged_orders(spark, sf_dir), top_clusters(spark, sf_dir), 5, 1)
    return rows.select("row_id", "o_totalprice", "qty")


# ------------------------------------------------------------------- ranking

RANKED = """ranked AS (SELECT row_id, feature, importance,
  row_number() OVER (PARTITION BY row_id ORDER BY round(importance, 9) DESC, feature) AS rank FROM attr)"""


def _stable(attribution: DataFrame) -> DataFrame:
    return attribution.withColumn("importance", F.round("importance", 9))


@query(
    "feature_ranks",
    S.with_(*ATTRIBUTION, RANKED) + "SELECT row_id, feature, rank FROM ranked",
)
def feature_ranks(spark, sf_dir):
    return R.rank_features(_stable(top_attribution(spark, sf_dir))).select("row_id", "feature", "rank")


@query(
    "rank_share",
    S.with_(*ATTRIBUTION, RANKED)
    + """SELECT rank, feature, round(count(*) / (sum(count(*)) OVER (PARTITION BY rank)), 6) AS share
FROM ranked GROUP BY rank, feature""",
)
def rank_share(spark, sf_dir):
    return R.rank_share(_stable(top_attribution(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query(
    "log_rank",
    S.with_(*ATTRIBUTION, RANKED)
    + f"""SELECT feature, round(sum(CASE WHEN round(importance, 9) > 0
  THEN 1 - ln(rank) / ln({len(ORDER_NUMERIC)}) ELSE 0 END), 6) AS score
FROM ranked GROUP BY feature""",
)
def log_rank(spark, sf_dir):
    runs = _stable(top_attribution(spark, sf_dir)).withColumnRenamed("row_id", "run")
    return R.log_rank(runs).withColumn("score", F.round("score", 6))


@query(
    "row_importance",
    S.with_(*ATTRIBUTION)
    + """SELECT row_id, feature, round(importance, 6) AS importance FROM attr
WHERE row_id = (SELECT min(row_id) FROM top_rows)""",
)
def row_importance(spark, sf_dir):
    first = top_orders(spark, sf_dir).agg(F.min("row_id")).first()[0]
    return A.row_importance(top_attribution(spark, sf_dir), first).withColumn(
        "importance", F.round("importance", 6)
    )


# --------------------------------------------------------------- preparation


@query(
    "label_encode",
    """SELECT c_custkey, c_acctbal, code AS c_mktsegment FROM customer JOIN (
  SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
  FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)""",
)
def label_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return P.encode(rows, ["c_mktsegment"])[0]


@query("label_decode", "SELECT c_custkey, c_mktsegment FROM customer")
def label_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    encoded, tables = P.encode(rows, ["c_mktsegment"])
    return P.decode(encoded, tables)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    """SELECT c_custkey, concat_ws(',', (c_mktsegment = 'AUTOMOBILE')::INT, (c_mktsegment = 'BUILDING')::INT,
  (c_mktsegment = 'FURNITURE')::INT, (c_mktsegment = 'HOUSEHOLD')::INT, (c_mktsegment = 'MACHINERY')::INT) AS onehot,
  list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS back,
  list_position(['BUILDING', 'MACHINERY'], c_mktsegment) - 1 AS partly FROM customer""",
)
def one_hot(spark, sf_dir):
    """All segments there and back; with some of them only, the others come back as null."""
    v, some = P.one_hot(F.col("c_mktsegment"), SEGMENTS), P.one_hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat_ws(",", v.cast("array<int>").cast("array<string>")).alias("onehot"),
        P.one_hot_inverse(v, [5])[0].alias("back"),
        P.one_hot_inverse(some, [2])[0].alias("partly"),
    )


@query(
    "minmax",
    """SELECT p_partkey, round((p_size - a) / (b - a), 6) AS p_size, round((p_retailprice - c) / (d - c), 6) AS p_retailprice
FROM part, (SELECT min(p_size)::DOUBLE a, max(p_size)::DOUBLE b, min(p_retailprice) c, max(p_retailprice) d FROM part)""",
)
def minmax(spark, sf_dir):
    columns = ["p_size", "p_retailprice"]
    parts = table(spark, sf_dir, "part").select("p_partkey", *columns)
    scaled = P.min_max(parts, P.limits(parts, columns))
    return scaled.withColumns({c: F.round(c, 6) for c in columns})


@query("minmax_inverse", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part")
def minmax_inverse(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    bounds = P.limits(parts, ["p_size"])
    restored = P.denormalise(P.clip_low(P.min_max(parts, bounds), ["p_size"]), bounds)
    return restored.withColumn("p_size", F.round("p_size").cast("long"))


@query(
    "clean_inf",
    """SELECT c_custkey, 1000.0::DOUBLE / c_nationkey AS inverse, ln(c_acctbal) AS log_balance
FROM customer WHERE c_nationkey <> 0 AND c_acctbal > 0""",
)
def clean_inf(spark, sf_dir):
    """0 gives an infinite inverse, a negative balance a NaN logarithm; both rows go."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") == 0, F.lit(float("inf")))
        .otherwise(F.try_divide(F.lit(1000.0), F.col("c_nationkey").cast("double")))
        .alias("inverse"),
        F.when(F.col("c_acctbal") > 0, F.ln("c_acctbal")).otherwise(F.lit(float("nan"))).alias("log_balance"),
    )
    return P.drop_non_finite(rows, ["inverse", "log_balance"])


@query(
    "dense_key",
    "SELECT count(*) AS n, 0::BIGINT AS lo, count(*) - 1 AS hi, count(*) AS distinct_keys FROM lineitem",
)
def dense_key(spark, sf_dir):
    keyed = P.with_row_key(table(spark, sf_dir, "lineitem").select("l_quantity"), dense=True)
    return keyed.agg(
        F.count("*").alias("n"),
        F.min("row_id").alias("lo"),
        F.max("row_id").alias("hi"),
        F.count_distinct("row_id").alias("distinct_keys"),
    )


@query(
    "force_numeric",
    "SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS v, (event_type <> 'click')::INT AS label FROM events",
)
def force_numeric(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", "[0-9]+", 0).alias("v"), "event_type"
    )
    return P.binary_label(P.force_numeric(rows, ["v"], strict=False), "event_type", "click")


# --------------------------------------------------------------- exploration


@query(
    "normal_split",
    S.with_(*DETECT, S.top(TOP)) + "SELECT row_id, o_totalprice FROM of ANTI JOIN top_rows USING (row_id)",
)
def normal_split(spark, sf_dir):
    rows = P.normal_rows(staged_orders(spark, sf_dir), top_orders(spark, sf_dir))
    return rows.select("row_id", "o_totalprice")


@query(
    "flagged",
    S.with_(*DETECT, S.top(TOP))
    + "SELECT of.row_id, o_orderstatus, (t.row_id IS NOT NULL)::INT AS anomaly FROM of LEFT JOIN top_rows t USING (row_id)",
)
def flagged(spark, sf_dir):
    rows = X.exploration_table(staged_orders(spark, sf_dir), top_orders(spark, sf_dir))
    return rows.select("row_id", "o_orderstatus", "anomaly")


@query(
    "normal_and_cluster",
    S.with_(*DETECT, S.top(TOP), CLUSTERS)
    + """SELECT row_id, 0 AS anomaly FROM of ANTI JOIN top_rows USING (row_id)
UNION ALL SELECT row_id, 1 FROM cl WHERE cluster_id = 2""",
)
def normal_and_cluster(spark, sf_dir):
    flags = X.exploration_table(staged_orders(spark, sf_dir), top_orders(spark, sf_dir))
    return X.normal_and_cluster(flags, top_clusters(spark, sf_dir), 5, 2).select("row_id", "anomaly")


def _bucket_sql(c: str, lo: str, hi: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, floor(({c} - {lo}) / (({hi} - {lo}) / {n}))))::INT"


@query(
    "hist_by_class",
    f"""SELECT bucket, event_type, round(lo + bucket * w, 6) AS lo, round(lo + (bucket + 1) * w, 6) AS hi, n FROM (
  SELECT {_bucket_sql('value', 'lo', 'hi', 50)} AS bucket, event_type, count(*) AS n, any_value(lo) AS lo,
         any_value((hi - lo) / 50) AS w
  FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1, 2)""",
)
def hist_by_class(spark, sf_dir):
    h = X.histogram(table(spark, sf_dir, "events"), "value", "event_type", 50)
    return h.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query(
    "category_histogram",
    "SELECT l_returnflag AS value, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def category_histogram(spark, sf_dir):
    return X.category_histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "density_2d",
    f"""SELECT {_bucket_sql('l_quantity', 'a', 'b', 20)} AS bx, {_bucket_sql('l_extendedprice', 'c', 'd', 20)} AS "by",
  count(*) AS n FROM lineitem, (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c,
  max(l_extendedprice) d FROM lineitem) GROUP BY 1, 2""",
)
def density_2d(spark, sf_dir):
    return X.density_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 20)


@query(
    "parallel_ticks",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, i::INT AS position, round(lo + (hi - lo) * i / 4, 6) AS tick FROM "
        f"(SELECT min({c})::DOUBLE lo, max({c})::DOUBLE hi FROM lineitem), (SELECT unnest(range(5)) AS i)"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def parallel_ticks(spark, sf_dir):
    ticks = X.axis_ticks(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return ticks.withColumn("tick", F.round("tick", 6))


@query("scatter")
def scatter(spark, sf_dir):
    points, clusters = _sweep(spark, sf_dir)
    return X.scatter(points, order_scores(spark, sf_dir), clusters, 3)
