"""Detection, ranking metrics and attribution on the example tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.operators import attribute as A
from strayrows.operators import chains as C
from strayrows.operators import countmin as CM
from strayrows.operators import metrics as M
from strayrows.operators.project import vectorize
from strayrows.plans import sql_parts as S
from strayrows.plans.registry import query
from strayrows.plans.views import (
    ORDER_NUMERIC,
    ORDER_NUMERIC_SPEC,
    ORDER_SPEC,
    labelled_documents,
    shared,
    staged_orders,
    table,
)
from strayrows.spec import FeatureSpec

CHAINS, DEPTH, SEED = 8, 5, 7
PLAN = C.ChainPlan.draw(len(ORDER_NUMERIC), CHAINS, DEPTH, SEED)
DETECT = S.detection(PLAN, ORDER_NUMERIC)
TOP = 50

PROJ_DIMS = 6
ORDER_TOKENS = list(ORDER_NUMERIC) + [f"o_orderstatus.{v}" for v in "FOP"] + [
    f"o_orderpriority.{v}" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
]


def order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize(
        staged_orders(spark, sf_dir).select("row_id", *ORDER_NUMERIC), ORDER_NUMERIC_SPEC
    )


def order_model(spark: SparkSession, sf_dir: str) -> C.ChainModel:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        _models[key] = C.fit_plan(order_vectors(spark, sf_dir), PLAN)
    return _models[key]


_models: dict[tuple, C.ChainModel] = {}


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "order-scores",
        lambda: order_model(spark, sf_dir).score(order_vectors(spark, sf_dir), fitted=True),
    )


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    return order_scores(spark, sf_dir).join(
        staged_orders(spark, sf_dir).select("row_id", label), "row_id"
    )


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "top-orders", lambda: C.top_k(order_scores(spark, sf_dir), TOP)
    )


def top_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        rows = order_vectors(spark, sf_dir).join(top_orders(spark, sf_dir), "row_id", "left_semi")
        return order_model(spark, sf_dir).depth_scores(rows)

    return shared(spark, sf_dir, "top-depths", build)


def top_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the plain numeric features for the top orders."""
    def build():
        imp = A.dimension_importance(top_depths(spark, sf_dir), len(ORDER_NUMERIC))
        return A.attribute(imp, ORDER_NUMERIC_SPEC)

    return shared(spark, sf_dir, "top-attribution", build)


# ---------------------------------------------------------------- detection

LINE_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "feature_ranges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi, CASE WHEN max({c}) = min({c}) "
        f"THEN 1.0::DOUBLE ELSE (max({c}) - min({c})) / 2.0::DOUBLE END AS half_range FROM lineitem"
        for c in LINE_NUMERIC
    ),
)
def feature_ranges(spark, sf_dir):
    spec = FeatureSpec(LINE_NUMERIC, frozenset())
    lines = table(spark, sf_dir, "lineitem").select(*LINE_NUMERIC)
    limits = lines.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.min(c).alias("lo"), F.max(c).alias("hi"))
                for c in spec.features
            ]
        ).alias("r")
    )
    half = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / 2)
    return limits.select(F.inline("r")).withColumn("half_range", half)


@query(
    "chain_bins",
    S.with_(*DETECT[:5]) + "SELECT row_id, chain, depth, bin FROM bins",
)
def chain_bins(spark, sf_dir):
    binned = C.bin_rows(order_vectors(spark, sf_dir), PLAN, order_model(spark, sf_dir).deltas)
    return binned.select("row_id", "chain", "depth", F.concat_ws(",", F.col("bin").cast("array<string>")).alias("bin"))


def _sketch_out(sketch: DataFrame) -> DataFrame:
    return sketch.select(
        "chain", "depth", F.concat_ws(",", F.col("bin").cast("array<string>")).alias("bin"), "cnt"
    )


@query("chain_sketch", S.with_(*DETECT[:6]) + "SELECT chain, depth, bin, cnt FROM sketch")
def chain_sketch(spark, sf_dir):
    return _sketch_out(order_model(spark, sf_dir).sketch)


@query(
    "chain_scores",
    S.with_(*DETECT)
    + """SELECT row_id, round(score, 6) AS score,
       round(CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS score_norm
FROM scores, (SELECT min(score) AS lo, max(score) AS hi FROM scores)""",
)
def chain_scores(spark, sf_dir):
    n = C.normalise(order_scores(spark, sf_dir))
    return n.select("row_id", F.round("score", 6).alias("score"), F.round("score_norm", 6).alias("score_norm"))


def strangest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 strangest orders, nothing shared with other queries."""
    from strayrows.plans.views import order_features
    from strayrows.staging import stage

    cores = spark.sparkContext.defaultParallelism
    rows = stage(order_features(spark, sf_dir).repartition(cores), "orders")
    vectors = vectorize(rows.select("row_id", *ORDER_NUMERIC), ORDER_NUMERIC_SPEC)
    scores = C.fit_plan(vectors, PLAN).score(vectors, fitted=True)
    return C.top_k(scores, 20).select("row_id", F.round("score", 6).alias("score"))


query(
    "chain_topk",
    S.with_(*DETECT, S.top(20)) + "SELECT row_id, round(score, 6) AS score FROM top_rows",
)(strangest_orders)


@query(
    "score_new_rows",
    S.with_(
        S.ORDER_FEATURES,
        S.long_vectors("of", ORDER_NUMERIC),
        S.half_ranges(where="SEMI JOIN (SELECT row_id FROM of WHERE o_orderstatus = 'F') USING (row_id)"),
        S.plan_values(PLAN),
        S.bins(),
        """sketch AS MATERIALIZED (SELECT chain, depth, bin, count(*) AS cnt
           FROM bins JOIN of USING (row_id) WHERE o_orderstatus = 'F' GROUP BY chain, depth, bin)""",
        S.DEPTH_VALUES,
        S.scores(),
    )
    + "SELECT row_id, o_orderstatus, round(score, 6) AS score FROM scores JOIN of USING (row_id)",
)
def score_new_rows(spark, sf_dir):
    """Fit on the finished orders, then score all: open ones were never counted."""
    orders = staged_orders(spark, sf_dir)
    vectors = order_vectors(spark, sf_dir)
    finished = orders.where(F.col("o_orderstatus") == "F").select("row_id", *ORDER_NUMERIC)
    model = C.fit_plan(vectorize(finished, ORDER_NUMERIC_SPEC), PLAN)
    return model.score(vectors).join(orders.select("row_id", "o_orderstatus"), "row_id").select(
        "row_id", "o_orderstatus", F.round("score", 6).alias("score")
    )


EVENT_PLAN = C.ChainPlan.draw(2, 6, 4, SEED)
EVENT_VECTORS = """ev AS (SELECT event_id AS row_id, value, user_id::DOUBLE AS u FROM events)"""
EVENT_RANGES = S.half_ranges(
    where="SEMI JOIN (SELECT event_id AS row_id FROM events WHERE event_type = 'click') USING (row_id)"
)


def event_vectors(spark, sf_dir, kind: Column | None = None):
    events = table(spark, sf_dir, "events")
    return (events if kind is None else events.where(kind)).select(
        F.col("event_id").alias("row_id"),
        F.array(F.col("value"), F.col("user_id").cast("double")).alias("x"),
    )


@query(
    "sketch_update",
    S.with_(
        EVENT_VECTORS,
        S.long_vectors("ev", ("value", "u")),
        EVENT_RANGES,
        S.plan_values(EVENT_PLAN),
        S.bins(),
        S.SKETCH,
    )
    + "SELECT chain, depth, bin, cnt FROM sketch",
)
def sketch_update(spark, sf_dir):
    """Counting the clicks, then all other events, equals counting the events once."""
    click = F.col("event_type") == "click"
    first = C.fit_plan(event_vectors(spark, sf_dir, click), EVENT_PLAN)
    return _sketch_out(first.update(event_vectors(spark, sf_dir, ~click)).sketch)


CM_SHAPE = CM.SketchShape(hashes=2, bits=10, seed=3)


def _count_min_sql() -> list[str]:
    mult = CM_SHAPE.multipliers(len(ORDER_NUMERIC))
    rows = ", ".join(
        f"({j},{k},{int(mult[j, k])}::HUGEINT)"
        for j in range(CM_SHAPE.hashes)
        for k in range(mult.shape[1])
    )
    wrap = 2**64
    return [
        *DETECT[:4],
        f"mult(j, dim, a) AS MATERIALIZED (VALUES {rows})",
        f"""hashed AS MATERIALIZED (
  SELECT row_id, chain, depth, split, j,
         ((((sum(b * a) % {wrap}) + {wrap}) % {wrap}) // {2 ** (64 - CM_SHAPE.bits)})::BIGINT AS bucket
  FROM (SELECT row_id, chain, depth, split, p.dim,
               floor((mult * x + u * delta) / delta)::HUGEINT AS b
        FROM xs v JOIN plan p ON v.dim = p.dim JOIN rng r ON r.dim = p.dim) t
  JOIN mult m ON m.dim = t.dim
  GROUP BY row_id, chain, depth, split, j)""",
        """cm AS MATERIALIZED (SELECT chain, depth, j, bucket, count(*) AS cnt
  FROM hashed GROUP BY chain, depth, j, bucket)""",
    ]


COUNT_MIN = _count_min_sql()


def order_count_min(spark: SparkSession, sf_dir: str) -> CM.CountMinModel:
    vectors = order_vectors(spark, sf_dir)
    return CM.CountMinDetector(len(ORDER_NUMERIC), CHAINS, DEPTH, SEED, CM_SHAPE).fit(vectors)


@query("count_min_cells", S.with_(*COUNT_MIN) + "SELECT chain, depth, j, bucket, cnt FROM cm")
def count_min_cells(spark, sf_dir):
    w, j = CM_SHAPE.width, CM_SHAPE.hashes
    cell = F.col("cell")
    table_row = F.floor(cell / w)
    return order_count_min(spark, sf_dir).cells.select(
        F.floor(table_row / (j * DEPTH)).cast("int").alias("chain"),
        (F.floor(table_row / j) % DEPTH + 1).cast("int").alias("depth"),
        (table_row % j).cast("int").alias("j"),
        (cell % w).alias("bucket"),
        "cnt",
    )


@query(
    "count_min_scores",
    S.with_(
        *COUNT_MIN,
        """depth_values AS MATERIALIZED (
  SELECT row_id, h.chain, h.depth, log2(1.0::DOUBLE + min(cnt)) + h.depth AS v
  FROM hashed h JOIN cm USING (chain, depth, j, bucket) GROUP BY row_id, h.chain, h.depth)""",
        S.scores(),
    )
    + "SELECT row_id, round(score, 6) AS score FROM scores",
)
def count_min_scores(spark, sf_dir):
    scores = order_count_min(spark, sf_dir).score(order_vectors(spark, sf_dir))
    return scores.select("row_id", F.round("score", 6).alias("score"))


WIDE_PLAN = C.ChainPlan.draw(len(ORDER_NUMERIC), 20, 20, SEED)
WIDE_SHAPE = CM.SketchShape(bits=16)


@query(
    "count_min_partitioned",
    S.with_(
        S.ORDER_FEATURES,
        S.long_vectors("of", ORDER_NUMERIC),
        S.half_ranges(),
        *S.count_min(WIDE_PLAN, WIDE_SHAPE, len(ORDER_NUMERIC)),
        S.scores().replace("depth_values", "cm_values"),
    )
    + "SELECT row_id, round(score, 6) AS score FROM scores",
)
def count_min_partitioned(spark, sf_dir):
    """2^16 counters a chain, depth and hash, partitioned by chain."""
    vectors = order_vectors(spark, sf_dir)
    detector = CM.CountMinDetector(len(ORDER_NUMERIC), 20, 20, SEED, WIDE_SHAPE)
    return detector.fit(vectors).score(vectors).select("row_id", F.round("score", 6).alias("score"))


@query(
    "depth_scores",
    S.with_(*DETECT, S.top(TOP))
    + """SELECT row_id, chain, depth, split, round(-v, 6) AS score
FROM depth_values SEMI JOIN top_rows USING (row_id)""",
)
def depth_scores(spark, sf_dir):
    return top_depths(spark, sf_dir).select(
        "row_id", "chain", "depth", "split", F.round(-F.col("v"), 6).alias("score")
    )


# --------------------------------------------------------------- projection

PROJECTED = [
    S.ORDER_FEATURES,
    S.weight_values(ORDER_TOKENS, PROJ_DIMS),
    """tok AS (
  SELECT row_id, ord, token, x FROM (
"""
    + " UNION ALL ".join(
        [f"SELECT row_id, {i} AS ord, '{c}' AS token, {c} AS x FROM of" for i, c in enumerate(ORDER_NUMERIC)]
        + [
            f"SELECT row_id, {len(ORDER_NUMERIC) + i}, '{c}.' || {c}, 1.0::DOUBLE FROM of"
            for i, c in enumerate(("o_orderstatus", "o_orderpriority"))
        ]
    )
    + "))",
]


@query(
    "mixed_projection",
    S.with_(*PROJECTED)
    + """SELECT row_id, k, round(sum(x * r), 6) AS y
FROM tok JOIN proj USING (token) GROUP BY row_id, k""",
)
def mixed_projection(spark, sf_dir):
    v = vectorize(staged_orders(spark, sf_dir), ORDER_SPEC, PROJ_DIMS)
    return v.select("row_id", F.posexplode("x").alias("k", "y")).withColumn("y", F.round("y", 6))


# ------------------------------------------------------------------ metrics

LABELLED = S.with_(
    *DETECT,
    """s AS MATERIALIZED (SELECT row_id, score, (o_orderstatus = 'F')::INT AS label
  FROM scores JOIN of USING (row_id))""",
)
AUC_SQL = """SELECT round(sum(win) / (any_value(p) * any_value(n)), 6) AS auc FROM (
  SELECT neg * (sum(pos) OVER (ORDER BY score DESC) - pos / 2.0::DOUBLE) AS win,
         (sum(pos) OVER ())::DOUBLE AS p, (sum(neg) OVER ())::DOUBLE AS n
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score))"""
AP_SQL = """SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM (
  SELECT pos, (sum(pos) OVER (ORDER BY score DESC))::DOUBLE AS tp,
         (sum(neg) OVER (ORDER BY score DESC))::DOUBLE AS fp
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score))"""
DOC_LABELLED = """WITH s AS MATERIALIZED (SELECT doc_id AS row_id, n_chars::DOUBLE AS score, toxic AS label
  FROM documents JOIN labels USING (doc_id))
"""


@query("roc_auc", LABELLED + AUC_SQL)
def roc_auc(spark, sf_dir):
    return M.roc_auc(labelled_scores(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("roc_auc_documents", DOC_LABELLED + AUC_SQL)
def roc_auc_documents(spark, sf_dir):
    return M.roc_auc(labelled_documents(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("avg_precision", LABELLED + AP_SQL)
def avg_precision(spark, sf_dir):
    return M.average_precision(labelled_scores(spark, sf_dir)).select(F.round("ap", 6).alias("ap"))


@query("avg_precision_documents", DOC_LABELLED + AP_SQL)
def avg_precision_documents(spark, sf_dir):
    return M.average_precision(labelled_documents(spark, sf_dir)).select(F.round("ap", 6).alias("ap"))


@query(
    "precision_at_k",
    LABELLED
    + """SELECT round(avg(label), 6) AS precision_at_k FROM (
  SELECT label FROM s ORDER BY score DESC, row_id LIMIT 100)""",
)
def precision_at_k(spark, sf_dir):
    out = M.precision_at_k(labelled_scores(spark, sf_dir), 100)
    return out.select(F.round("precision_at_k", 6).alias("precision_at_k"))


@query(
    "f1",
    DOC_LABELLED
    + """SELECT round(2.0::DOUBLE * sum(label * p) / sum(label + p), 6) AS f1
FROM (SELECT label, (score >= 2000)::INT AS p FROM s)""",
)
def f1(spark, sf_dir):
    predicted = labelled_documents(spark, sf_dir).withColumn(
        "prediction", F.when(F.col("score") >= 2000, 1).otherwise(0)
    )
    return M.f1(predicted).select(F.round("f1", 6).alias("f1"))


@query("outlier_share", DOC_LABELLED + "SELECT round(avg(label), 6) AS contamination FROM s")
def outlier_share(spark, sf_dir):
    out = M.outlier_share(labelled_documents(spark, sf_dir))
    return out.select(F.round("contamination", 6).alias("contamination"))


@query("class_counts", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def class_counts(spark, sf_dir):
    return M.class_counts(table(spark, sf_dir, "labels"), "toxic")


# -------------------------------------------------------------- attribution

IMPORTANCE = [
    *DETECT,
    S.top(TOP),
    """dv AS MATERIALIZED (SELECT row_id, chain, depth, split, round(v, 9) AS v
  FROM depth_values SEMI JOIN top_rows USING (row_id))""",
    """stops AS (SELECT row_id, chain, depth AS stop FROM dv
  QUALIFY row_number() OVER (PARTITION BY row_id, chain ORDER BY v, depth) = 1)""",
    f"""imp AS MATERIALIZED (
  SELECT t.row_id, k, coalesce(i, 0.0::DOUBLE) AS imp
  FROM (SELECT row_id, unnest(range({len(ORDER_NUMERIC)})) AS k FROM top_rows) t
  LEFT JOIN (
    SELECT row_id, split AS k, sum(m - v) / (count(DISTINCT chain) + 1) AS i
    FROM dv JOIN stops USING (row_id, chain), (SELECT max(v) AS m FROM dv)
    WHERE depth <= stop GROUP BY row_id, split) USING (row_id, k))""",
]
FEATURE_NAMES = "names(k, feature) AS (VALUES " + ", ".join(
    f"({i},'{f}')" for i, f in enumerate(ORDER_NUMERIC)
) + ")"
ATTRIBUTION = [
    *IMPORTANCE,
    FEATURE_NAMES,
    "attr AS MATERIALIZED (SELECT row_id, feature, imp AS importance FROM imp JOIN names USING (k))",
]


@query(
    "importance_dims",
    S.with_(*ATTRIBUTION) + "SELECT row_id, feature, round(importance, 6) AS importance FROM attr",
)
def importance_dims(spark, sf_dir):
    return _rounded(top_attribution(spark, sf_dir))


def _rounded(attribution: DataFrame) -> DataFrame:
    return attribution.select("row_id", "feature", F.round("importance", 6).alias("importance"))


# Attribution through a random projection: chains over projected mixed rows.
# Binning compares doubles, so the projected vector is taken from the numeric
# features only, as an explicit sum both engines evaluate in the same order.
WALK_DIMS = 8
WALK_PLAN = C.ChainPlan.draw(WALK_DIMS, CHAINS, DEPTH, 11)


def _walk_vector_sql() -> str:
    from strayrows.functions.tokens import projection_weights

    w = projection_weights(ORDER_NUMERIC, WALK_DIMS)
    cats = projection_weights(ORDER_TOKENS[len(ORDER_NUMERIC):], WALK_DIMS)
    selects = []
    for k in range(WALK_DIMS):
        terms = [f"{f} * {S.num(float(w[i, k]))}" for i, f in enumerate(ORDER_NUMERIC) if w[i, k] != 0]
        total = " + ".join(terms) if terms else "0.0::DOUBLE"
        for n, column in enumerate(("o_orderstatus", "o_orderpriority")):
            cases = " ".join(
                f"WHEN '{t.split('.', 1)[1]}' THEN {S.num(float(cats[i, k]))}"
                for i, t in enumerate(ORDER_TOKENS[len(ORDER_NUMERIC):])
                if t.startswith(column + ".")
            )
            selects_part = f"(CASE {column} {cases} END)"
            total = f"({total}) + ({selects_part}" if n == 0 else f"{total} + {selects_part})"
        selects.append(f"SELECT row_id, {k} AS dim, {total} AS x FROM of")
    return "xs AS MATERIALIZED (" + " UNION ALL ".join(selects) + ")"


WALK_TOP = 30
WALK_DETECT = [
    S.ORDER_FEATURES,
    _walk_vector_sql(),
    S.half_ranges(),
    S.plan_values(WALK_PLAN),
    S.bins(),
    S.SKETCH,
    S.DEPTH_VALUES,
    S.scores(),
]
WALK_FEATURES = [
    S.top(WALK_TOP),
    *[p.replace(f"range({len(ORDER_NUMERIC)})", f"range({WALK_DIMS})") for p in IMPORTANCE[-3:]],
    S.weight_values(ORDER_TOKENS, WALK_DIMS, signed=False),
    "feats(i, feature) AS (VALUES "
    + ", ".join(f"({i},'{f}')" for i, f in enumerate(ORDER_SPEC.features))
    + ")",
    """toks AS (SELECT row_id, i, feature, CASE feature WHEN 'o_orderstatus' THEN 'o_orderstatus.' || o_orderstatus
    WHEN 'o_orderpriority' THEN 'o_orderpriority.' || o_orderpriority ELSE feature END AS token
  FROM of SEMI JOIN top_rows USING (row_id), feats)""",
    """mem AS MATERIALIZED (SELECT row_id, i, feature, k, r FROM toks JOIN proj USING (token))""",
]
WALK = [*WALK_DETECT, *WALK_FEATURES]


def walk_rows(spark, sf_dir):
    return vectorize(staged_orders(spark, sf_dir), ORDER_SPEC, WALK_DIMS)


def walk_importance(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(importance of projections, own rows) of the top orders under projection."""
    def build():
        vectors = shared(spark, sf_dir, "walk-vectors", lambda: walk_rows(spark, sf_dir))
        model = C.fit_plan(vectors, WALK_PLAN)
        top = C.top_k(model.score(vectors, fitted=True), WALK_TOP)
        return model.depth_scores(vectors.join(top, "row_id", "left_semi"))

    depths = shared(spark, sf_dir, "walk-depths", build)
    imp = shared(
        spark, sf_dir, "walk-importance", lambda: A.dimension_importance(depths, WALK_DIMS)
    )
    return imp, staged_orders(spark, sf_dir).join(imp, "row_id", "left_semi")


def _attributed(method: str):
    def run(spark, sf_dir):
        imp, rows = walk_importance(spark, sf_dir)
        return _rounded(A.attribute(imp, ORDER_SPEC, rows, WALK_DIMS, method))

    return run


query(
    "importance_projected",
    S.with_(*WALK) + "SELECT row_id, k, round(imp, 6) AS importance FROM imp",
)(
    lambda spark, sf_dir: walk_importance(spark, sf_dir)[0]
    .select("row_id", F.posexplode("imp").alias("k", "importance"))
    .withColumn("importance", F.round("importance", 6))
)

query(
    "token_membership",
    S.with_(*WALK) + "SELECT row_id, feature, k FROM mem WHERE r <> 0",
)(
    lambda spark, sf_dir: A.edges(
        A.membership(walk_importance(spark, sf_dir)[1], ORDER_SPEC, WALK_DIMS), ORDER_SPEC
    )
)

query(
    "attr_average",
    S.with_(*WALK)
    + """SELECT row_id, feature,
       round(CASE WHEN sum(r) = 0 THEN 0 ELSE sum(r * imp) / sum(r) END, 6) AS importance
FROM mem JOIN imp USING (row_id, k) GROUP BY row_id, feature""",
)(_attributed("average"))


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0::DOUBLE ELSE {num} / {den} END"


def _walk_sql(alpha: float, rounds: int) -> str:
    parts = [
        *WALK,
        """e AS MATERIALIZED (SELECT row_id, i, k, r * imp AS w FROM mem JOIN imp USING (row_id, k))""",
        f"""g AS MATERIALIZED (SELECT row_id, i, k,
  {_ratio('w', 'sum(w) OVER (PARTITION BY row_id, i)')} AS a,
  {_ratio('w', 'sum(w) OVER (PARTITION BY row_id, k)')} AS b FROM e)""",
        """q AS MATERIALIZED (SELECT row_id, k, (imp - low) / sum(imp - low) OVER (PARTITION BY row_id) AS q
  FROM (SELECT *, least(0, min(imp) OVER (PARTITION BY row_id)) AS low FROM imp))""",
    ]
    n = WALK_DIMS + len(ORDER_SPEC.features)
    parts.append(
        f"d0 AS MATERIALIZED (SELECT DISTINCT row_id, i, 1.0::DOUBLE / {n} AS v FROM mem)"
    )
    parts.append(f"p0 AS MATERIALIZED (SELECT row_id, k, 1.0::DOUBLE / {n} AS v FROM imp)")
    for t in range(1, rounds + 1):
        parts.append(
            f"""nd{t} AS MATERIALIZED (SELECT g.row_id, i, {alpha}::DOUBLE * sum(b * v) AS v
  FROM g JOIN p{t - 1} p ON p.row_id = g.row_id AND p.k = g.k GROUP BY g.row_id, i)"""
        )
        parts.append(
            f"""np{t} AS MATERIALIZED (SELECT q.row_id, q.k,
    {alpha}::DOUBLE * any_value(s) + {1 - alpha}::DOUBLE * any_value(q) AS v FROM q JOIN (
      SELECT g.row_id, k, sum(a * v) AS s FROM g JOIN d{t - 1} d ON d.row_id = g.row_id AND d.i = g.i
      GROUP BY g.row_id, k) m ON m.row_id = q.row_id AND m.k = q.k GROUP BY q.row_id, q.k)"""
        )
        parts.append(
            f"""m{t} AS MATERIALIZED (SELECT row_id, sum(v) AS mass FROM (
    SELECT row_id, v FROM nd{t} UNION ALL SELECT row_id, v FROM np{t}) GROUP BY row_id)"""
        )
        for x, key in (("d", "i"), ("p", "k")):
            parts.append(
                f"{x}{t} AS MATERIALIZED (SELECT row_id, {key}, v / mass AS v FROM n{x}{t} JOIN m{t} USING (row_id))"
            )
    return (
        S.with_(*parts)
        + f"""SELECT row_id, feature, round(v / sum(v) OVER (PARTITION BY row_id), 6) AS importance
FROM d{rounds} JOIN feats USING (i)"""
    )


query("attr_walk", _walk_sql(0.5, 10))(_attributed("random_walk"))
query("attr_walk_damped", _walk_sql(0.2, 20))(_attributed("random_walk2"))


def _norm_sql(source: str, key: str) -> str:
    return f"""SELECT row_id, {key}, v / sqrt(sum(v * v) OVER (PARTITION BY row_id)) AS v FROM ({source})"""


def _hits_sql(alpha: float, rounds: int, structure_only: bool) -> str:
    parts = [
        *WALK,
        f"""b AS MATERIALIZED (SELECT row_id, i, k, r, {_ratio('r', 'sum(r) OVER (PARTITION BY row_id, k)')} AS b
  FROM mem)""",
    ]
    if structure_only:
        parts.append("p0 AS MATERIALIZED (SELECT row_id, k, 0.1::DOUBLE AS v FROM imp)")
    else:
        shifted = "SELECT row_id, k, imp - least(0, min(imp) OVER (PARTITION BY row_id)) AS v FROM imp"
        parts.append(f"p0 AS MATERIALIZED ({_norm_sql(shifted, 'k')})")
    for t in range(1, rounds + 1):
        d = f"""SELECT b.row_id, i, sum(b * v) AS v FROM b JOIN p{t - 1} p
  ON p.row_id = b.row_id AND p.k = b.k GROUP BY b.row_id, i"""
        parts.append(f"d{t} AS MATERIALIZED ({_norm_sql(d, 'i')})")
        if structure_only:
            p = f"""SELECT b.row_id, k, sum(b * v) AS v FROM b JOIN d{t} d
  ON d.row_id = b.row_id AND d.i = b.i GROUP BY b.row_id, k"""
        else:
            p = f"""SELECT m.row_id, m.k, {alpha}::DOUBLE * s + {1 - alpha}::DOUBLE * q.v AS v FROM (
    SELECT b.row_id, k, sum(r * v) AS s FROM b JOIN d{t} d ON d.row_id = b.row_id AND d.i = b.i
    GROUP BY b.row_id, k) m JOIN p0 q ON q.row_id = m.row_id AND q.k = m.k"""
        parts.append(f"p{t} AS MATERIALIZED ({_norm_sql(p, 'k')})")
    return (
        S.with_(*parts)
        + f"SELECT row_id, feature, round(v, 6) AS importance FROM d{rounds} JOIN feats USING (i)"
    )


query("attr_hits", _hits_sql(0.5, 20, False))(_attributed("hits"))
query("attr_structure", _hits_sql(0.5, 20, True))(_attributed("signed_hits"))


# Clusters given from outside: the order priority of the top rows, as k = 5.
CLUSTERS = """cl AS MATERIALIZED (SELECT row_id, 5 AS k, substr(o_orderpriority, 1, 1)::INT - 1 AS cluster_id
  FROM of SEMI JOIN top_rows USING (row_id))"""


def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "top-clusters",
        lambda: staged_orders(spark, sf_dir)
        .join(top_orders(spark, sf_dir), "row_id", "left_semi")
        .select(
            "row_id",
            F.lit(5).alias("k"),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("cluster_id"),
        ),
    )


@query(
    "cluster_top_features",
    S.with_(*ATTRIBUTION, CLUSTERS)
    + """SELECT k, cluster_id, feature, round(m, 6) AS importance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY k, cluster_id ORDER BY m DESC, feature) AS rank FROM (
    SELECT k, cluster_id, feature, avg(importance) AS m
    FROM attr JOIN cl USING (row_id) GROUP BY k, cluster_id, feature)) WHERE rank <= 3""",
)
def cluster_top_features(spark, sf_dir):
    mean = A.cluster_importance(top_attribution(spark, sf_dir), top_clusters(spark, sf_dir))
    return A.top_features(mean, 3).withColumn("importance", F.round("importance", 6))
