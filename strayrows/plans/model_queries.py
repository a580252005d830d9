"""Forest baseline, sampled attribution, injected outliers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.functions.tokens import projection_weights
from strayrows.operators import chains as C
from strayrows.operators import countmin as CM
from strayrows.operators import inject as N
from strayrows.operators import iforest as I
from strayrows.operators import shapley as SH
from strayrows.operators import trees as TR
from strayrows.operators.attribute import fold_one_hot
from strayrows.operators.prep import one_hot
from strayrows.operators.project import vectorize
from strayrows.plans import sql_parts as S
from strayrows.plans.detect_queries import (
    DETECT,
    EVENT_PLAN,
    EVENT_RANGES,
    EVENT_VECTORS,
    TOP,
    event_vectors,
    order_model,
    order_vectors,
    top_orders,
)
from strayrows.plans.mixed_forest import MixedForest, importance_of_runs
from strayrows.plans.registry import query
from strayrows.plans.views import (
    ORDER_NUMERIC,
    ORDER_SPEC,
    embeddings,
    shared,
    staged_orders,
    table,
)
from strayrows.spec import FeatureSpec
from strayrows.staging import run_dir, stage
from strayrows.streaming import blocks as B
from strayrows.streaming import updates as U

# -------------------------------------------------------------------- forest


def forest(spark: SparkSession, sf_dir: str) -> I.ForestModel:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _forests:
        _forests[key] = I.ForestDetector(256, 256, 3).fit(order_vectors(spark, sf_dir))
    return _forests[key]


_forests: dict[tuple, I.ForestModel | MixedForest] = {}


def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "forest-scores",
        lambda: forest(spark, sf_dir).score(order_vectors(spark, sf_dir)),
    )


@query("iforest_scores")
def iforest_scores(spark, sf_dir):
    return forest_scores(spark, sf_dir)


@query("iforest_predict")
def iforest_predict(spark, sf_dir):
    predicted = I.predict(forest_scores(spark, sf_dir), contamination=0.1)
    return predicted.groupBy("prediction").agg(F.count("*").alias("n"))


@query("iforest_auc")
def iforest_auc(spark, sf_dir):
    labels = staged_orders(spark, sf_dir).select(
        "row_id", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    )
    return I.evaluate(forest_scores(spark, sf_dir), labels)


@query("iforest_embeddings")
def iforest_embeddings(spark, sf_dir):
    """Forest over the 64-dimensional embedding vectors."""
    vectors = embeddings(spark, sf_dir).select("row_id", "x")
    return I.ForestDetector(256, 256, 5).fit(vectors).score(vectors)


@query("iforest_paths")
def iforest_paths(spark, sf_dir):
    rows = order_vectors(spark, sf_dir).join(top_orders(spark, sf_dir), "row_id", "left_semi")
    return forest(spark, sf_dir).path_importance(rows, ORDER_NUMERIC)


@query("iforest_ranks")
def iforest_ranks(spark, sf_dir):
    runs = TR.importance_over_runs(order_vectors(spark, sf_dir), ORDER_NUMERIC, range(5), 100, 256)
    return TR.ranked_importance(runs)


def mixed_forest(spark: SparkSession, sf_dir: str) -> MixedForest:
    key = (spark.sparkContext.applicationId, sf_dir, "mixed")
    if key not in _forests:
        _forests[key] = MixedForest.fit(staged_orders(spark, sf_dir), ORDER_SPEC, I.ForestDetector(256, 256, 7))
    return _forests[key]


@query("forest_mixed")
def forest_mixed(spark, sf_dir):
    """Forest scores of orders with their categories as indicators."""
    return mixed_forest(spark, sf_dir).score(staged_orders(spark, sf_dir))


@query("fold_paths")
def fold_paths(spark, sf_dir):
    """Path importance of the strangest orders, indicators folded back to their category."""
    forest, orders = mixed_forest(spark, sf_dir), staged_orders(spark, sf_dir)
    top = C.top_k(forest.score(orders), 20).select("row_id")
    return forest.attribution(orders.join(top, "row_id", "left_semi"))


@query("forest_runs")
def forest_runs(spark, sf_dir):
    """Features by importance over repeated forests, with the mean F1 against finished orders."""
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return importance_of_runs(staged_orders(spark, sf_dir).withColumn("label", label), ORDER_SPEC, range(5))


# ------------------------------------------------------------------- shapley


@query("shapley_chain_scores")
def shapley_chain_scores(spark, sf_dir):
    """Attribution of the chain detector taken as a black box."""
    vectors = order_vectors(spark, sf_dir)
    rows = vectors.join(top_orders(spark, sf_dir), "row_id", "left_semi")
    model = order_model(spark, sf_dir)
    return SH.shapley(rows, vectors, model.score, ORDER_NUMERIC)


@query("shapley_forest")
def shapley_forest(spark, sf_dir):
    vectors = order_vectors(spark, sf_dir)
    rows = vectors.join(top_orders(spark, sf_dir), "row_id", "left_semi")
    return SH.absolute(
        SH.shapley(rows, vectors, forest(spark, sf_dir).score, ORDER_NUMERIC)
    )


@query("tree_shapley")
def tree_shapley(spark, sf_dir):
    """Exact Shapley values of the strangest orders under the forest, by size."""
    rows = order_vectors(spark, sf_dir).join(top_orders(spark, sf_dir), "row_id", "left_semi")
    return SH.absolute(TR.tree_shapley(forest(spark, sf_dir), rows, ORDER_NUMERIC))


@query(
    "tree_shapley_sums",
    S.with_(*DETECT, S.top(TOP)) + f"SELECT row_id, {len(ORDER_NUMERIC)}::BIGINT AS features, 0.0::DOUBLE AS gap FROM top_rows",
)
def tree_shapley_sums(spark, sf_dir):
    """What the Shapley values of a row leave unexplained of its path length: nothing."""
    rows = order_vectors(spark, sf_dir).join(top_orders(spark, sf_dir), "row_id", "left_semi")
    model = forest(spark, sf_dir)
    sums = TR.tree_shapley(model, rows, ORDER_NUMERIC).groupBy("row_id").agg(
        F.sum("importance").alias("explained"), F.count("*").alias("features")
    )
    left = F.col("expected") - F.col("length") - F.col("explained")
    return sums.join(TR.path_lengths(model, rows), "row_id").select("row_id", "features", F.round(F.abs(left), 6).alias("gap"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "fold_one_hot",
    """SELECT c_custkey AS row_id, 'segment' AS feature, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1.0::DOUBLE
  WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 ELSE 0 END AS importance FROM customer
UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer""",
)
def fold_query(spark, sf_dir):
    """Importances of indicator columns folded back to the category they encode."""
    rows = table(spark, sf_dir, "customer")
    known = F.array(*[F.lit(s) for s in SEGMENTS])
    indicators = rows.select(
        F.col("c_custkey").alias("row_id"), F.posexplode(one_hot(F.col("c_mktsegment"), SEGMENTS)).alias("i", "active")
    ).select(
        "row_id", known[F.col("i")].alias("column"), "active", (F.col("i") + 1.0).alias("importance")
    )
    numeric = rows.select(
        F.col("c_custkey").alias("row_id"), F.lit("c_acctbal").alias("column"), F.lit(1.0).alias("active"),
        F.col("c_acctbal").alias("importance"),
    )
    return fold_one_hot(indicators.unionByName(numeric), {s: "segment" for s in SEGMENTS})


# ------------------------------------------------------------------ injection


@query(
    "category_share",
    "SELECT p_brand AS value, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_brand",
)
def category_share(spark, sf_dir):
    return N.category_shares(table(spark, sf_dir, "part"), "p_brand").withColumn("share", F.round("share", 6))


@query(
    "rare_category",
    """SELECT p_brand AS value, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part
GROUP BY p_brand ORDER BY count(*), p_brand LIMIT 1""",
)
def rare_category(spark, sf_dir):
    shares = N.category_shares(table(spark, sf_dir, "part"), "p_brand")
    return N.rare_category(shares).withColumn("share", F.round("share", 6))


INJECT_SPEC = FeatureSpec(
    ("o_totalprice", "qty", "max_price", "n_lines", "max_disc", "o_orderstatus", "o_orderpriority"),
    frozenset({"o_orderstatus", "o_orderpriority"}),
)
INJECT_GROUPS = (
    N.OutlierGroup(("o_totalprice", "o_orderpriority"), "global"),
    N.OutlierGroup(("qty", "max_price"), "local"),
)


def injected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def build():
        rows = staged_orders(spark, sf_dir).select("row_id", *INJECT_SPEC.features)
        made, truth = N.inject(
            rows, INJECT_SPEC, INJECT_GROUPS, epsilon=0.1, seed=4
        )
        _truth[(spark.sparkContext.applicationId, sf_dir)] = stage(truth, "truth")
        return made

    made = shared(spark, sf_dir, "injected", build)
    return made, _truth[(spark.sparkContext.applicationId, sf_dir)]


_truth: dict[tuple, DataFrame] = {}


@query("inject")
def inject(spark, sf_dir):
    return injected(spark, sf_dir)[0]


@query("inject_truth")
def inject_truth(spark, sf_dir):
    return injected(spark, sf_dir)[1]


@query("inject_detect")
def inject_detect(spark, sf_dir):
    """How well the projected chains find the injected rows."""
    from strayrows.operators.metrics import roc_auc

    made, _ = injected(spark, sf_dir)
    vectors = vectorize(made.drop("label"), INJECT_SPEC, 10)
    vectors = stage(vectors, "injected-vectors")
    scores = C.ChainDetector(10, 20, 8, 1).fit(vectors).score(vectors)
    return roc_auc(scores.join(made.select("row_id", "label"), "row_id"))


# ------------------------------------------------------------------- streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of (row_id, x) in four micro-batches, by ranges of row_id.

    Files are taken by their time: each range is written after the one before it, as as many files as there are
    cores, which make a batch.
    """
    parts = f"{run_dir(spark)}/{uuid.uuid4().hex}/event-files"
    events = event_vectors(spark, sf_dir)
    lo, hi = events.agg(F.min("row_id"), F.max("row_id")).first()
    quarter = F.floor((F.col("row_id") - F.lit(lo)) * 4 / F.lit(hi - lo + 1))
    for i in range(4):
        events.where(quarter == i).repartition(1).write.mode("append").parquet(parts)
    schema = "row_id bigint, x array<double>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(parts)


def _event_deltas(spark, sf_dir) -> list[float]:
    first = event_vectors(spark, sf_dir, F.col("event_type") == "click")
    return C.half_ranges(C.ranges(first, 2))


@query(
    "stream_update",
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
def stream_update(spark, sf_dir):
    """Counts kept by a stream equal the counts of one batch."""
    out = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    counts = U.streaming_sketch(_event_stream(spark, sf_dir), EVENT_PLAN, _event_deltas(spark, sf_dir))
    U.write_latest(counts, f"{out}/sketch", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/sketch").select(
        "chain", "depth", F.concat_ws(",", F.col("bin").cast("array<string>")).alias("bin"), "cnt"
    )


BLOCK_SHAPE = CM.SketchShape(bits=12)


@query(
    "stream_update_bounded",
    S.with_(
        EVENT_VECTORS,
        S.long_vectors("ev", ("value", "u")),
        EVENT_RANGES,
        *S.count_min(EVENT_PLAN, BLOCK_SHAPE, 2),
    )
    + " UNION ALL ".join(
        f"SELECT chain, depth, {j} AS j, b{j}::BIGINT AS bucket, count(*) AS cnt FROM cm_hashed GROUP BY ALL"
        for j in range(BLOCK_SHAPE.hashes)
    ),
)
def stream_update_bounded(spark, sf_dir):
    """Counters that a custom stateful operator keeps, a fixed number of state values."""
    out, shape = f"{run_dir(spark)}/{uuid.uuid4().hex}", BLOCK_SHAPE
    B.use_rocksdb(spark)
    blocks = B.running_blocks(_event_stream(spark, sf_dir), EVENT_PLAN, _event_deltas(spark, sf_dir), shape)
    U.write_blocks(blocks, f"{out}/blocks", f"{out}/checkpoint").awaitTermination()
    row = F.floor(F.col("cell") / shape.width)
    return B.opened_blocks(U.latest_blocks(spark, f"{out}/blocks")).select(
        F.floor(row / (shape.hashes * EVENT_PLAN.depth)).cast("int").alias("chain"),
        (F.floor(row / shape.hashes) % EVENT_PLAN.depth + 1).cast("int").alias("depth"),
        (row % shape.hashes).cast("int").alias("j"),
        (F.col("cell") % shape.width).alias("bucket"),
        "cnt",
    )


def _scores_by_epoch(hashes: int, bootstrap: bool) -> list[str]:
    """Scores from the counts of the epochs before; with `bootstrap` epoch 0 has been counted once already."""
    parts, joins, least = [], "", []
    for j in range(hashes):
        parts.append(
            f"""own{j} AS MATERIALIZED (SELECT chain, depth, b{j}, epoch, count(*) AS n
  FROM cm_hashed JOIN batches USING (row_id) GROUP BY ALL)"""
        )
        once = "WHEN o.epoch = 0 THEN 2" if bootstrap else ""
        first = f"WHEN o.epoch = 0 AND t.epoch = 0 THEN {int(bootstrap)}"
        parts.append(
            f"""seen{j} AS MATERIALIZED (SELECT t.chain, t.depth, t.b{j}, t.epoch,
  sum(CASE {first} WHEN o.epoch >= t.epoch THEN 0 {once} ELSE 1 END * o.n) AS n{j}
  FROM own{j} t JOIN own{j} o ON o.chain = t.chain AND o.depth = t.depth AND o.b{j} = t.b{j} GROUP BY ALL)"""
        )
        joins += f" JOIN seen{j} USING (chain, depth, b{j}, epoch)"
        least.append(f"n{j}")
    value = f"log2(1.0::DOUBLE + least({', '.join(least)})) + depth"
    last = f"""v AS (SELECT row_id, epoch, chain, {value} AS v FROM cm_hashed JOIN batches USING (row_id){joins})"""
    return [*parts, last]


SCORES_BY_EPOCH = """SELECT row_id, epoch, round(round(-avg(m), 9), 6) AS score FROM (
  SELECT row_id, epoch, chain, min(v) AS m FROM v GROUP BY row_id, epoch, chain) GROUP BY row_id, epoch"""


def _read_scores(spark: SparkSession, path: str) -> DataFrame:
    return U.read_scores(spark, path).select("row_id", "epoch", F.round("score", 6).alias("score"))


QUARTERS = "(row_id - (SELECT min(event_id) FROM events)) * 4 // (SELECT max(event_id) - min(event_id) + 1 FROM events)"
TYPED_SPEC = FeatureSpec(("value", "u", "event_type"), frozenset({"event_type"}))
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
TYPED_PLAN, TYPED_SHAPE = C.ChainPlan.draw(10, 20, 8, 4), CM.SketchShape(bits=12)


def _typed_vectors_sql() -> str:
    number = projection_weights(["value", "u"], 10)
    kind = projection_weights([f"event_type.{t}" for t in EVENT_TYPES], 10)
    rows = []
    for k in range(10):
        terms = " + ".join(f"{f} * {S.num(float(number[i, k]))}" for i, f in enumerate(("value", "u")) if number[i, k] != 0.0)
        cases = " ".join(f"WHEN '{t}' THEN {S.num(float(kind[i, k]))}" for i, t in enumerate(EVENT_TYPES))
        rows.append(f"SELECT row_id, {k} AS dim, ({terms or '0.0::DOUBLE'}) + CASE event_type {cases} END AS x FROM ev")
    return "xs AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")"


@query(
    "stream_new_category",
    S.with_(
        "ev AS (SELECT event_id AS row_id, value, user_id::DOUBLE AS u, event_type FROM events)",
        f"batches AS (SELECT row_id, CASE WHEN event_type = 'error' THEN greatest({QUARTERS}, 2) ELSE {QUARTERS} END AS epoch FROM ev)",
        _typed_vectors_sql(),
        S.half_ranges(where="SEMI JOIN (SELECT row_id FROM batches WHERE epoch = 0) USING (row_id)"),
        *S.count_min(TYPED_PLAN, TYPED_SHAPE, 10)[:-1],
        *_scores_by_epoch(TYPED_SHAPE.hashes, bootstrap=True),
    )
    + SCORES_BY_EPOCH,
)
def stream_new_category(spark, sf_dir):
    """Events with their type as a category; errors come with the last batches only."""
    spec = TYPED_SPEC
    events = event_vectors(spark, sf_dir).select("row_id", F.col("x")[0].alias("value"), F.col("x")[1].alias("u")).join(
        table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type"), "row_id"
    )
    events = stage(events, "typed-events")
    lo, hi = events.agg(F.min("row_id"), F.max("row_id")).first()
    quarter = F.floor((F.col("row_id") - F.lit(lo)) * 4 / F.lit(hi - lo + 1))
    batch = F.when(F.col("event_type") == "error", F.greatest(quarter, F.lit(2))).otherwise(quarter)
    out = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    for i in range(4):
        events.where(batch == i).repartition(1).write.mode("append").parquet(f"{out}/files")
    schema = "row_id bigint, value double, u double, event_type string"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/files")
    first = vectorize(events.where(batch == 0), spec, 10)
    start = CM.CountMinDetector(10, 20, 8, 4, TYPED_SHAPE).fit(first)
    U.score_and_count(vectorize(arriving, spec, 10), start, f"{out}/run", f"{out}/checkpoint").awaitTermination()
    return _read_scores(spark, f"{out}/run")


SCORED_SHAPE = CM.SketchShape(bits=10)


@query(
    "stream_scores",
    S.with_(
        EVENT_VECTORS,
        S.long_vectors("ev", ("value", "u")),
        EVENT_RANGES,
        f"batches AS (SELECT row_id, {QUARTERS} AS epoch FROM ev)",
        *S.count_min(EVENT_PLAN, SCORED_SHAPE, 2)[:-1],
        *_scores_by_epoch(SCORED_SHAPE.hashes, bootstrap=False),
    )
    + SCORES_BY_EPOCH,
)
def stream_scores(spark, sf_dir):
    """Every event scored against the counts of the events before its batch."""
    out = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    shape = SCORED_SHAPE
    deltas = _event_deltas(spark, sf_dir)
    empty = spark.createDataFrame([], "cell bigint, cnt bigint")
    start = CM.CountMinModel(EVENT_PLAN, deltas, shape, empty)
    U.score_and_count(
        _event_stream(spark, sf_dir), start, f"{out}/run", f"{out}/checkpoint"
    ).awaitTermination()
    return _read_scores(spark, f"{out}/run")
