"""Rule mining and pair focus on the example tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.operators import attribute as A
from strayrows.operators import chains as C
from strayrows.operators import pairs as L
from strayrows.operators import rule_index as RI
from strayrows.operators import rules as R
from strayrows.plans import sql_parts as S
from strayrows.plans.detect_queries import ATTRIBUTION, order_model, order_scores, order_vectors
from strayrows.plans.registry import query
from strayrows.plans.views import (
    ORDER_NUMERIC,
    ORDER_NUMERIC_SPEC,
    shared,
    staged_orders,
    table,
)
from strayrows.sources.store import ResultStore
from strayrows.spec import FeatureSpec
from strayrows.staging import run_dir

RULE_TOP = 300
RULE_SPEC = FeatureSpec(ORDER_NUMERIC + ("o_orderstatus",), frozenset({"o_orderstatus"}))


def rule_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "rule-top", lambda: C.top_k(order_scores(spark, sf_dir), RULE_TOP))


def rule_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 strangest orders, clustered by priority."""
    return shared(
        spark, sf_dir, "rule-members",
        lambda: staged_orders(spark, sf_dir)
        .join(rule_top(spark, sf_dir), "row_id", "left_semi")
        .withColumn("k", F.lit(5))
        .withColumn("cluster_id", F.substring("o_orderpriority", 1, 1).cast("int") - 1),
    )


def rule_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_orders(spark, sf_dir).join(rule_top(spark, sf_dir), "row_id", "left_anti")


def rule_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 numeric features of each cluster by mean importance."""
    def build():
        rows = order_vectors(spark, sf_dir).join(rule_top(spark, sf_dir), "row_id", "left_semi")
        depths = shared(
            spark, sf_dir, "rule-depths", lambda: order_model(spark, sf_dir).depth_scores(rows)
        )
        imp = A.attribute(A.dimension_importance(depths, len(ORDER_NUMERIC)), ORDER_NUMERIC_SPEC)
        clusters = rule_members(spark, sf_dir).select("k", "cluster_id", "row_id")
        mean = A.cluster_importance(imp, clusters).withColumn("importance", F.round("importance", 9))
        return A.top_features(mean, 3)

    return shared(spark, sf_dir, "rule-focus", build)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features the rules may use: the focus and the order status."""
    focus = rule_focus(spark, sf_dir).select("k", "cluster_id", "feature")
    clusters = focus.select("k", "cluster_id").distinct()
    return focus.unionByName(clusters.withColumn("feature", F.lit("o_orderstatus")))


def rule_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "rule-base",
        lambda: R.base_conditions(
            rule_members(spark, sf_dir), staged_orders(spark, sf_dir), RULE_SPEC,
            described(spark, sf_dir),
        ),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "rules",
        lambda: R.find_rules(
            rule_base(spark, sf_dir), rule_members(spark, sf_dir), rule_normals(spark, sf_dir),
            RULE_SPEC,
        ),
    )


# ------------------------------------------------------------- comparison SQL


def _density_sql(values: str) -> str:
    """Grid density and dense runs of values(k, cluster_id, feature, v) and fr(feature, gmin, gmax)."""
    return f"""spans AS MATERIALIZED (
  SELECT k, cluster_id, feature, min(v) - (max(v) - min(v)) * 1e-8 AS a, max(v) + (max(v) - min(v)) * 1e-8 AS b,
         CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) * 0.02::DOUBLE ELSE 1.0::DOUBLE END AS h
  FROM {values} GROUP BY k, cluster_id, feature),
grid AS MATERIALIZED (
  SELECT k, cluster_id, feature, g, a + (b - a) * g / 999 AS x, h FROM spans, (SELECT unnest(range(1000)) AS g)),
dens AS MATERIALIZED (
  SELECT k, cluster_id, feature, g, any_value(x) AS x, sum(n * exp(-0.5::DOUBLE * ((x - v) / h) * ((x - v) / h))) AS s
  FROM grid JOIN (SELECT k, cluster_id, feature, v, count(*) AS n FROM {values} GROUP BY ALL) USING (k, cluster_id, feature)
  GROUP BY k, cluster_id, feature, g),
runs AS MATERIALIZED (
  SELECT k, cluster_id, feature, greatest(min(x), any_value(gmin)) AS lo, least(max(x), any_value(gmax)) AS hi FROM (
    SELECT *, g - row_number() OVER (PARTITION BY k, cluster_id, feature ORDER BY g) AS run FROM (
      SELECT *, max(s) OVER (PARTITION BY k, cluster_id, feature) AS peak FROM dens) WHERE s > 0.8::DOUBLE * peak)
  JOIN fr USING (feature) GROUP BY k, cluster_id, feature, run)"""


@query(
    "kde_intervals",
    S.with_(
        """vals AS MATERIALIZED (SELECT 5 AS k, substr(o_orderpriority, 1, 1)::INT - 1 AS cluster_id,
  'o_totalprice' AS feature, o_totalprice AS v FROM orders)""",
        "fr AS (SELECT 'o_totalprice' AS feature, min(o_totalprice) AS gmin, max(o_totalprice) AS gmax FROM orders)",
        _density_sql("vals"),
    )
    + "SELECT k, cluster_id, feature, round(lo, 4) AS lo, round(hi, 4) AS hi FROM runs",
)
def kde_intervals(spark, sf_dir):
    """Dense price ranges of every order priority."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit(5).alias("k"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("cluster_id"),
        "o_totalprice",
    )
    spec = FeatureSpec(("o_totalprice",), frozenset())
    focus = orders.select("k", "cluster_id").distinct().withColumn("feature", F.lit("o_totalprice"))
    found = R.base_conditions(orders, orders, spec, focus)
    return found.select(
        "k", "cluster_id", "feature", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi")
    )


@query(
    "mode_rule",
    """SELECT 1 AS k, b AS cluster_id, feature, value FROM (
  SELECT b, feature, value, row_number() OVER (PARTITION BY b, feature ORDER BY count(*) DESC, value) AS r FROM (
    SELECT p_size // 10 AS b, 'p_brand' AS feature, p_brand AS value FROM part UNION ALL
    SELECT p_size // 10, 'p_type', p_type FROM part) GROUP BY b, feature, value) WHERE r = 1""",
)
def mode_rule(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.lit(1).alias("k"), F.floor(F.col("p_size") / 10).cast("int").alias("cluster_id"), "p_brand", "p_type"
    )
    spec = FeatureSpec(("p_brand", "p_type"), frozenset({"p_brand", "p_type"}))
    focus = parts.select("k", "cluster_id").distinct().withColumn(
        "feature", F.explode(F.array(F.lit("p_brand"), F.lit("p_type")))
    )
    found = R.base_conditions(parts, parts, spec, focus)
    return found.select("k", "cluster_id", "feature", "value")


# Attribution of the rule rows, then their focus features.
RULE_ATTR = [p.replace("LIMIT 50", f"LIMIT {RULE_TOP}") for p in ATTRIBUTION]
FOCUS = [
    *RULE_ATTR,
    """cl AS MATERIALIZED (SELECT row_id, 5 AS k, substr(o_orderpriority, 1, 1)::INT - 1 AS cluster_id
  FROM of SEMI JOIN top_rows USING (row_id))""",
    """focus AS MATERIALIZED (SELECT k, cluster_id, feature, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY k, cluster_id ORDER BY round(m, 9) DESC, feature) AS rank FROM (
    SELECT k, cluster_id, feature, avg(importance) AS m FROM attr JOIN cl USING (row_id) GROUP BY ALL))
  WHERE rank <= 3)""",
]
LONG_MEMBERS = " UNION ALL ".join(
    f"SELECT k, cluster_id, '{f}' AS feature, {f}::DOUBLE AS v FROM cl JOIN of USING (row_id)"
    for f in ORDER_NUMERIC
)
FEATURE_RANGE = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, min({f})::DOUBLE AS gmin, max({f})::DOUBLE AS gmax FROM of"
    for f in ORDER_NUMERIC
)
AT = "CASE feature " + " ".join(
    f"WHEN '{f}' THEN {i}" for i, f in enumerate(RULE_SPEC.features)
) + " END"
HOLDS = "CASE p.feature " + " ".join(
    f"WHEN '{f}' THEN r.{f} BETWEEN p.lo AND p.hi" for f in ORDER_NUMERIC
) + " ELSE r.o_orderstatus = p.value END"
BASE = [
    *FOCUS,
    f"vals AS MATERIALIZED (SELECT v.* FROM ({LONG_MEMBERS}) v SEMI JOIN focus USING (k, cluster_id, feature))",
    f"fr AS MATERIALIZED ({FEATURE_RANGE})",
    _density_sql("vals"),
    f"""base AS MATERIALIZED (SELECT *, {AT} AS pos FROM (
  SELECT k, cluster_id, feature, 'interval' AS kind, lo, hi, NULL AS value FROM runs UNION ALL
  SELECT k, cluster_id, 'o_orderstatus', 'category', NULL, NULL, o_orderstatus FROM (
    SELECT k, cluster_id, o_orderstatus, row_number() OVER (
      PARTITION BY k, cluster_id ORDER BY count(*) DESC, o_orderstatus) AS r
    FROM cl JOIN of USING (row_id) GROUP BY k, cluster_id, o_orderstatus) WHERE r = 1))""",
]
SEARCH = [
    *BASE,
    "sizes AS (SELECT k, cluster_id, count(*) AS size FROM cl GROUP BY k, cluster_id)",
    f"""good AS MATERIALIZED (SELECT p.k, p.cluster_id, p.feature, p.kind, p.lo, p.hi, p.value, p.pos
  FROM base p JOIN cl USING (k, cluster_id) JOIN of r USING (row_id) JOIN sizes USING (k, cluster_id)
  GROUP BY p.k, p.cluster_id, p.feature, p.kind, p.lo, p.hi, p.value, p.pos
  HAVING count(*) FILTER (WHERE {HOLDS}) >= 0.05 * any_value(size))""",
    """preds AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, cluster_id ORDER BY pos, cost, lo, hi) - 1 AS pred FROM (
  SELECT *, 1 AS cost FROM good UNION ALL
  SELECT a.k, a.cluster_id, a.feature, a.kind, a.lo, b.hi, NULL, a.pos, 2 FROM good a JOIN good b
    ON a.k = b.k AND a.cluster_id = b.cluster_id AND a.feature = b.feature AND a.kind = 'interval' AND a.lo < b.lo))""",
    f"""mask AS MATERIALIZED (SELECT k, cluster_id, m, count(*) FILTER (WHERE own) AS n_out,
    count(*) FILTER (WHERE NOT own) AS n_norm FROM (
  SELECT p.k, p.cluster_id, r.row_id, any_value(c.row_id IS NOT NULL) AS own,
         bit_or(CASE WHEN {HOLDS} THEN 1::HUGEINT << p.pred::INT ELSE 0::HUGEINT END) AS m
  FROM of r LEFT JOIN cl c USING (row_id) JOIN preds p ON c.row_id IS NULL OR (c.k = p.k AND c.cluster_id = p.cluster_id)
  GROUP BY p.k, p.cluster_id, r.row_id) GROUP BY k, cluster_id, m)""",
    """RECURSIVE_rules AS (
  SELECT k, cluster_id, 1::HUGEINT << pred::INT AS bits, pos, cost AS spent, txt FROM named
  UNION ALL
  SELECT c.k, c.cluster_id, c.bits | (1::HUGEINT << p.pred::INT), p.pos, c.spent + p.cost, c.txt || p.txt
  FROM RECURSIVE_rules c JOIN named p ON p.k = c.k AND p.cluster_id = c.cluster_id AND p.pos > c.pos AND c.spent + p.cost <= 5)""",
    """scored AS MATERIALIZED (SELECT k, cluster_id, txt AS rule_text, sum(n_out) / any_value(size) AS coverage,
    sum(n_out) / sum(n_out + n_norm) AS purity
  FROM RECURSIVE_rules r JOIN mask USING (k, cluster_id) JOIN sizes USING (k, cluster_id)
  WHERE (m & bits) = bits GROUP BY k, cluster_id, txt
  HAVING sum(n_out) >= 0.05 * any_value(size) AND sum(n_norm) / sum(n_out + n_norm) < 0.95)""",
]
NAMED = """named AS MATERIALIZED (SELECT *, CASE WHEN kind = 'interval'
  THEN printf('Feature %s between: %.3f and %.3f.', feature, lo, hi)
  ELSE printf('Feature %s is: %s.', feature, value) END AS txt FROM preds)"""
SEARCH.insert(len(SEARCH) - 2, NAMED)


def rules_sql(tail: str) -> str:
    return S.with_(*SEARCH).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_rules", "combos") + tail


def _out(found: DataFrame, *extra: str) -> DataFrame:
    return found.select(
        "k", "cluster_id", R.rule_text(F.col("rule")).alias("rule_text"),
        F.round("coverage", 6).alias("coverage"), F.round("purity", 6).alias("purity"), *extra,
    )


ROUNDED = "k, cluster_id, rule_text, round(coverage, 6) AS coverage, round(purity, 6) AS purity"


@query(
    "rule_base",
    S.with_(*BASE) + "SELECT k, cluster_id, feature, kind, round(lo, 5) AS lo, round(hi, 5) AS hi, value FROM base",
)
def rule_base_query(spark, sf_dir):
    return rule_base(spark, sf_dir).select(
        "k", "cluster_id", "feature", "kind", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "value"
    )


@query("rule_candidates", rules_sql(f"SELECT {ROUNDED} FROM scored"))
def rule_candidates(spark, sf_dir):
    return _out(rules(spark, sf_dir))


def _by_text(found: DataFrame) -> DataFrame:
    """Ties in the selections are broken by the text on both sides."""
    return found.withColumn("rule_id", R.rule_text(F.col("rule"))).withColumns(
        {"coverage": F.round("coverage", 9), "purity": F.round("purity", 9)}
    )


SCORED9 = "(SELECT k, cluster_id, rule_text, round(coverage, 9) AS coverage, round(purity, 9) AS purity FROM scored)"


@query(
    "rule_topk",
    rules_sql(
        f"""SELECT {ROUNDED}, rank FROM (SELECT *, row_number() OVER (PARTITION BY k, cluster_id
  ORDER BY coverage DESC, purity DESC, rule_text) AS rank FROM {SCORED9} WHERE coverage >= 0.1 AND purity >= 0.2) WHERE rank <= 5"""
    ),
)
def rule_topk(spark, sf_dir):
    return _out(R.top_rules(_by_text(rules(spark, sf_dir)), 0.1, 0.2), "rank")


@query(
    "rule_display",
    rules_sql(
        f"""SELECT {ROUNDED}, place FROM (
  SELECT *, CASE WHEN n <= 3 THEN f WHEN f = 1 THEN 1 WHEN s = 1 THEN 2
    WHEN row_number() OVER (PARTITION BY k, cluster_id ORDER BY (f = 1 OR s = 1), coverage + purity DESC, rule_text) = 1 THEN 3 END AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY k, cluster_id ORDER BY f = 1, purity DESC, rule_text) AS s
    FROM (SELECT *, count(*) OVER (PARTITION BY k, cluster_id) AS n,
      row_number() OVER (PARTITION BY k, cluster_id ORDER BY coverage DESC, rule_text) AS f
      FROM {SCORED9} WHERE coverage >= 0.1 AND purity >= 0.2))) WHERE place IS NOT NULL"""
    ),
)
def rule_display(spark, sf_dir):
    return _out(R.display_rules(_by_text(rules(spark, sf_dir)), 0.1, 0.2), "place")


@query(
    "rule_nearest",
    rules_sql(
        f"""SELECT {ROUNDED} FROM {SCORED9} QUALIFY row_number() OVER (PARTITION BY k, cluster_id
  ORDER BY round(pow(1 - coverage, 2) + pow(1 - purity, 2), 9), rule_text) = 1"""
    ),
)
def rule_nearest(spark, sf_dir):
    return _out(R.nearest_to_ideal(_by_text(rules(spark, sf_dir))))


ADHOC = [
    R.Condition("o_totalprice", 300000.0, 450000.0),
    R.Condition("o_totalprice", 200000.0, 350000.0),
    R.Condition("o_orderstatus", value="F"),
]


@query(
    "adhoc_rule",
    S.with_(*FOCUS[:-1])
    + """SELECT k, cluster_id, round(hits / size, 6) AS coverage, round(hits / (hits + o), 6) AS purity FROM (
  SELECT k, cluster_id, count(*) AS size, count(*) FILTER (WHERE o_totalprice BETWEEN 200000 AND 450000 AND o_orderstatus = 'F') AS hits
  FROM cl JOIN of USING (row_id) GROUP BY k, cluster_id),
  (SELECT count(*) AS o FROM of ANTI JOIN top_rows USING (row_id)
   WHERE o_totalprice BETWEEN 200000 AND 450000 AND o_orderstatus = 'F')""",
)
def adhoc_rule(spark, sf_dir):
    """Coverage and purity of a hand-written rule; its two price ranges become their hull."""
    scored = R.score_rule(ADHOC, rule_members(spark, sf_dir), rule_normals(spark, sf_dir))
    return scored.withColumns(
        {"coverage": F.round("coverage", 6), "purity": F.round("purity", 6)}
    )


@query(
    "rule_matches",
    S.with_(S.ORDER_FEATURES)
    + "SELECT row_id FROM of WHERE o_totalprice BETWEEN 200000 AND 450000 AND o_orderstatus = 'F'",
)
def rule_matches(spark, sf_dir):
    return staged_orders(spark, sf_dir).where(R.matches(ADHOC)).select("row_id")


@query(
    "rule_text_round_trip",
    rules_sql(
        "SELECT k, cluster_id, rule_text, len(regexp_extract_all(rule_text, 'Feature ')) AS n_conditions FROM scored"
    ),
)
def rule_text_round_trip(spark, sf_dir):
    """Rules printed, parsed and printed again."""
    parsed = rules(spark, sf_dir).withColumn(
        "again", R.parse_rule(R.rule_text(F.col("rule")))
    )
    return parsed.select(
        "k", "cluster_id", R.rule_text(F.col("again")).alias("rule_text"),
        F.size("again").cast("long").alias("n_conditions"),
    )


@query(
    "rule_domains",
    S.with_(S.ORDER_FEATURES)
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(min({f}), 4) AS lo, round(max({f}), 4) AS hi, NULL AS value FROM of"
        for f in ORDER_NUMERIC
    )
    + " UNION ALL SELECT DISTINCT 'o_orderstatus', NULL, NULL, o_orderstatus FROM of",
)
def rule_domains(spark, sf_dir):
    return R.domains(staged_orders(spark, sf_dir), RULE_SPEC)


# ------------------------------------------------------------------ pair focus

PAIRS = L.PairDetector(n_dims=4, n_chains=4, depth=4, seed=5, shape=None)
ALL_PAIRS = [
    (a, b) for i, a in enumerate(ORDER_NUMERIC) for b in ORDER_NUMERIC[i + 1 :]
]


def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "cluster-pairs",
        lambda: L.feature_pairs(rule_focus(spark, sf_dir), ORDER_NUMERIC),
    )


def outlier_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        pairs = L.distinct_pairs(cluster_pairs(spark, sf_dir))
        return PAIRS.score(staged_orders(spark, sf_dir), pairs, rule_top(spark, sf_dir))

    return shared(spark, sf_dir, "outlier-pair-scores", build)


def _pair_clusters(spark, sf_dir) -> DataFrame:
    return rule_members(spark, sf_dir).select("k", "cluster_id", "row_id")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "pair-assigned",
        lambda: L.best_pairs(
            outlier_pair_scores(spark, sf_dir), _pair_clusters(spark, sf_dir), cluster_pairs(spark, sf_dir)
        ),
    )


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "pair-ranks", lambda: L.rank_pairs(assigned(spark, sf_dir)))


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "pair-budgets",
        lambda: L.within_budgets(
            outlier_pair_scores(spark, sf_dir), _pair_clusters(spark, sf_dir), ranked_pairs(spark, sf_dir)
        ),
    )


def _pair_vectors_sql(n_dims: int) -> str:
    selects, dim = [], 0
    for fx, fy in ALL_PAIRS:
        for terms in L.pair_terms(fx, fy, n_dims):
            x = " + ".join(f"{f} * {S.num(w)}" for f, w in terms) or "0.0::DOUBLE"
            selects.append(f"SELECT row_id, {dim} AS dim, {x} AS x FROM of")
            dim += 1
    return "pxs AS MATERIALIZED (" + " UNION ALL ".join(selects) + ")"


PAIR_NAMES = "pn(ensemble, fx, fy) AS (VALUES " + ", ".join(
    f"({i},'{a}','{b}')" for i, (a, b) in enumerate(ALL_PAIRS)
) + ")"


def _pair_score_parts() -> list[str]:
    rename = {
        "sketch AS": "psketch AS", "FROM bins": "FROM pbins", "depth_values": "pdepth",
        "JOIN sketch s": "JOIN psketch s", "scores AS": "pscores AS",
    }
    parts = [S.SKETCH, S.DEPTH_VALUES, S.scores(PAIRS.n_chains)]
    for i, p in enumerate(parts):
        for a, b in rename.items():
            p = p.replace(a, b)
        parts[i] = p
    return [
        _pair_vectors_sql(PAIRS.n_dims),
        S.half_ranges("pxs", "prng"),
        S.plan_values(PAIRS.plan(ALL_PAIRS), "pplan"),
        S.bins("pxs", "prng", "pplan", "pbins"),
        *parts,
        PAIR_NAMES,
        """ps AS MATERIALIZED (SELECT fx, fy, row_id, score, round(CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END, 9) AS score_norm
  FROM pscores JOIN (SELECT ensemble, min(score) AS lo, max(score) AS hi FROM pscores GROUP BY ensemble) USING (ensemble)
  JOIN pn USING (ensemble))""",
    ]


PAIR_SCORES = _pair_score_parts()


@query(
    "pair_scores",
    S.with_(S.ORDER_FEATURES, *PAIR_SCORES)
    + "SELECT fx, fy, row_id, round(score_norm, 6) AS score FROM ps",
)
def pair_scores(spark, sf_dir):
    """Scores of all rows on every pair of numeric features."""
    scored = PAIRS.score_all(staged_orders(spark, sf_dir), ALL_PAIRS)
    return scored.select("fx", "fy", "row_id", F.round("score_norm", 6).alias("score"))


POS = "CASE {} " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(ORDER_NUMERIC)) + " END"
ASSIGN = [
    *FOCUS,
    *PAIR_SCORES,
    f"""cp AS MATERIALIZED (SELECT a.k, a.cluster_id, row_number() OVER (PARTITION BY a.k, a.cluster_id ORDER BY a.rank, b.rank) - 1 AS plot,
    CASE WHEN {POS.format('a.feature')} > {POS.format('b.feature')} THEN b.feature ELSE a.feature END AS fx,
    CASE WHEN {POS.format('a.feature')} > {POS.format('b.feature')} THEN a.feature ELSE b.feature END AS fy
  FROM focus a JOIN focus b ON a.k = b.k AND a.cluster_id = b.cluster_id AND a.rank < b.rank)""",
    """best AS MATERIALIZED (SELECT k, cluster_id, row_id, plot, fx, fy, score_norm AS score
  FROM cl JOIN cp USING (k, cluster_id) JOIN ps USING (fx, fy, row_id)
  QUALIFY row_number() OVER (PARTITION BY k, cluster_id, row_id ORDER BY score_norm DESC, plot DESC) = 1)""",
    """pr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, cluster_id ORDER BY round(total, 9) DESC, plot) AS rank FROM (
  SELECT k, cluster_id, plot, fx, fy, sum(score) AS total, count(*) AS n FROM best GROUP BY ALL))""",
    """bud AS MATERIALIZED (SELECT k, cluster_id, budget, rank, fx, fy, row_id, score_norm AS score
  FROM cl JOIN pr USING (k, cluster_id) JOIN (SELECT unnest(range(1, 6)) AS budget) ON rank <= budget
  JOIN ps USING (fx, fy, row_id)
  QUALIFY row_number() OVER (PARTITION BY k, cluster_id, budget, row_id ORDER BY score_norm DESC, rank DESC) = 1)""",
]


@query(
    "pair_list",
    S.with_(*ASSIGN[: len(FOCUS)], ASSIGN[len(FOCUS) + len(PAIR_SCORES)])
    + "SELECT k, cluster_id, plot, fx, fy FROM cp",
)
def pair_list(spark, sf_dir):
    return cluster_pairs(spark, sf_dir)


@query(
    "pair_assign",
    S.with_(*ASSIGN)
    + "SELECT k, cluster_id, row_id, plot, fx, fy, round(score, 6) AS score FROM best",
)
def pair_assign(spark, sf_dir):
    return assigned(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    "pair_rank",
    S.with_(*ASSIGN) + "SELECT k, cluster_id, plot, fx, fy, round(total, 6) AS total, n, rank FROM pr",
)
def pair_rank(spark, sf_dir):
    return ranked_pairs(spark, sf_dir).withColumn("total", F.round("total", 6))


@query(
    "pair_budget",
    S.with_(*ASSIGN)
    + """SELECT k, cluster_id, budget, rank, fx, fy, round(coalesce(any_value(t), 0), 6) AS total, coalesce(any_value(c), 0) AS n
FROM pr JOIN (SELECT unnest(range(1, 6)) AS budget) ON rank <= budget LEFT JOIN (
  SELECT k, cluster_id, budget, rank, sum(score) AS t, count(*) AS c FROM bud GROUP BY ALL) USING (k, cluster_id, budget, rank)
GROUP BY k, cluster_id, budget, rank, fx, fy""",
)
def pair_budget(spark, sf_dir):
    totals = L.budget_totals(budgeted(spark, sf_dir), ranked_pairs(spark, sf_dir))
    return totals.withColumn("total", F.round("total", 6))


@query(
    "pair_roles",
    S.with_(*ASSIGN)
    + """SELECT row_id, CASE WHEN h.row_id IS NOT NULL THEN 1 WHEN c.row_id IS NOT NULL AND c.cluster_id = 1 THEN 2
  WHEN c.row_id IS NOT NULL THEN 3 ELSE 0 END AS role FROM of LEFT JOIN cl c USING (row_id)
LEFT JOIN (SELECT row_id FROM bud WHERE cluster_id = 1 AND budget = 2 AND rank = 1) h USING (row_id)""",
)
def pair_roles(spark, sf_dir):
    return L.plot_roles(
        staged_orders(spark, sf_dir), rule_top(spark, sf_dir), _pair_clusters(spark, sf_dir),
        budgeted(spark, sf_dir), k=5, cluster_id=1, budget=2, rank=1,
    )


COUNTED = L.PairDetector(n_dims=50, n_chains=10, depth=10, seed=5)
TOTAL_PRICE_TOP = 100


@query(
    "pair_count_min",
    S.with_(
        S.ORDER_FEATURES,
        _pair_vectors_sql(COUNTED.n_dims),
        S.half_ranges("pxs", "prng"),
        *S.count_min(COUNTED.plan(ALL_PAIRS), COUNTED.shape, COUNTED.n_dims, "pxs", "prng"),
        S.scores(COUNTED.n_chains).replace("depth_values", "cm_values"),
        PAIR_NAMES,
        "ends AS (SELECT ensemble, min(score) AS lo, max(score) AS hi FROM scores GROUP BY ensemble)",
        f"chosen AS (SELECT row_id FROM of ORDER BY o_totalprice DESC, row_id LIMIT {TOTAL_PRICE_TOP})",
    )
    + """SELECT fx, fy, row_id, round(score, 6) AS score,
  round(CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS score_norm
FROM scores JOIN ends USING (ensemble) JOIN pn USING (ensemble) SEMI JOIN chosen USING (row_id)""",
)
def pair_count_min(spark, sf_dir):
    """The dearest orders on every pair of numeric features, by counters."""
    orders = staged_orders(spark, sf_dir)
    dearest = orders.orderBy(F.desc("o_totalprice"), "row_id").limit(TOTAL_PRICE_TOP).select("row_id")
    scored = COUNTED.score(orders, ALL_PAIRS, dearest)
    return scored.withColumns({c: F.round(c, 6) for c in ("score", "score_norm")})


@query(
    "saved_pairs",
    S.with_(*ASSIGN) + "SELECT DISTINCT fx, fy, row_id, round(score_norm, 6) AS score FROM ps SEMI JOIN cl USING (row_id) SEMI JOIN cp USING (fx, fy)",
)
def saved_pairs(spark, sf_dir):
    """Pair scores of the strangest orders, saved and then found again by what they were made from."""
    orders, top = staged_orders(spark, sf_dir), rule_top(spark, sf_dir)
    pairs = L.distinct_pairs(cluster_pairs(spark, sf_dir))
    store = ResultStore(spark, f"{run_dir(spark)}/{uuid.uuid4().hex}/saved")
    made_from = {"detector": PAIRS, "pairs": pairs, "rows": orders, "outliers": top.select("row_id")}

    def again():
        raise ValueError("built twice")

    store.get("pair_scores", made_from, lambda: PAIRS.score(orders, pairs, top))
    found = store.get("pair_scores", made_from, again)
    return found.select("fx", "fy", "row_id", F.round("score_norm", 6).alias("score"))


MANY = 5000
MANY_RULES = f"""SELECT 5 AS k, (j % 5)::INT AS cluster_id, j AS rule_id, (j * 37 % 400) * 1000.0::DOUBLE AS lo1,
  (j * 37 % 400) * 1000.0::DOUBLE + 20000 + (j % 50) * 2000 AS hi1, (j % 40)::DOUBLE AS lo2, (j % 40 + 5 + j % 20)::DOUBLE AS hi2,
  CASE WHEN j % 3 = 0 THEN ['F', 'O', 'P'][(j // 3 % 3 + 1)::INT] END AS status FROM range({MANY}) AS g(j)"""


@query(
    "rules_at_scale",
    S.with_(
        S.ORDER_FEATURES,
        f"rule AS MATERIALIZED ({MANY_RULES})",
        "marked AS MATERIALIZED (SELECT *, left(o_orderpriority, 1)::INT - 1 AS c, o_totalprice > 200000 AS own FROM of)",
        """hit AS (SELECT rule_id, count(*) FILTER (own AND c = cluster_id) AS hits, count(*) FILTER (NOT own) AS outside
  FROM rule JOIN marked ON o_totalprice BETWEEN lo1 AND hi1 AND qty BETWEEN lo2 AND hi2 AND (status IS NULL OR status = o_orderstatus)
  GROUP BY rule_id)""",
        "size AS (SELECT c AS cluster_id, count(*) AS size FROM marked WHERE own GROUP BY c)",
    )
    + """SELECT k, cluster_id, rule_id, coalesce(hits, 0) AS hits, size, coalesce(outside, 0) AS outside,
  round(coalesce(hits, 0) / size, 6) AS coverage, round(CASE WHEN hits + outside > 0 THEN hits / (hits + outside) END, 6) AS purity
FROM rule LEFT JOIN hit USING (rule_id) JOIN size USING (cluster_id)""",
)
def rules_at_scale(spark, sf_dir):
    """5,000 saved rules over all orders, one scan of each side."""
    j = F.col("id")
    status = F.array(F.lit("F"), F.lit("O"), F.lit("P"))[(F.floor(j / 3) % 3).cast("int")]
    lo, low = (j * 37 % 400) * 1000.0, (j % 40).cast("double")
    condition = lambda f, kind, a, b, v: F.struct(
        F.lit(f).alias("feature"), F.lit(kind).alias("kind"), a.cast("double").alias("lo"), b.cast("double").alias("hi"), v.cast("string").alias("value")
    )
    none = F.lit(None)
    numbers = F.array(
        condition("o_totalprice", "interval", lo, lo + 20000 + (j % 50) * 2000, none),
        condition("qty", "interval", low, low + 5 + j % 20, none),
    )
    with_status = F.concat(numbers, F.array(condition("o_orderstatus", "value", none, none, status)))
    saved = spark.range(MANY).select(
        F.lit(5).alias("k"), (j % 5).cast("int").alias("cluster_id"), j.alias("rule_id"),
        F.when(j % 3 == 0, with_status).otherwise(numbers).alias("rule"),
    )
    marked = staged_orders(spark, sf_dir).withColumn("k", F.lit(5)).withColumn(
        "cluster_id", F.substring("o_orderpriority", 1, 1).cast("int") - 1
    )
    found = RI.score_rules(saved, marked.where("o_totalprice > 200000"), marked.where("o_totalprice <= 200000"))
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "purity")})
