"""Preparation, exploration, sources and sinks."""

import math

import pytest
from pyspark.sql import functions as F

from strayrows.functions import joins
from strayrows.operators import explore as X
from strayrows.operators import prep as P
from strayrows.operators.pairs import PairDetector
from strayrows.sources import tables as IO
from strayrows.sources.store import ResultStore
from strayrows.spec import FeatureSpec, split_roles


def test_roles_come_from_the_schema(spark):
    df = spark.createDataFrame([(1, 2, "a", True, 1)], "id int, n int, c string, f boolean, y int")
    spec = FeatureSpec.from_schema(df.schema, id="id", label="y")
    assert spec.numeric == ("n",) and spec.categories == ("c", "f")
    row = split_roles(df, spec).first()
    assert (row["row_id"], row["n"], row["f"], row["label"]) == (1, 2.0, "true", 1)
    with pytest.raises(TypeError):
        FeatureSpec.from_schema(spark.sql("select 1 as row_id, current_timestamp() as t").schema)


def test_non_finite_rows_go(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, math.inf), (3, -math.inf), (4, math.nan), (5, None)], "row_id bigint, v double"
    )
    assert [r["row_id"] for r in P.drop_non_finite(df, ["v"]).collect()] == [1]


def test_force_numeric_and_names(spark):
    df = spark.createDataFrame([("1.5", "x")], "`Flow Byts/s` string, `B C` string")
    out = P.snake_case(df)
    assert out.columns == ["flow_byts/s", "b_c"]
    assert P.force_numeric(out, ["flow_byts/s"]).first()[0] == 1.5
    assert P.force_numeric(out, ["b_c"], strict=False).first()[1] is None
    with pytest.raises(Exception):
        P.force_numeric(out, ["b_c"]).collect()


def test_dense_key_and_label(spark):
    df = spark.range(0, 101, 1, 7).select(F.when(F.col("id") < 3, "ok").otherwise("bad").alias("c"))
    keyed = P.with_row_key(df, dense=True)
    assert sorted(r["row_id"] for r in keyed.collect()) == list(range(101))
    assert P.binary_label(df, "c", "ok").where("label = 0").count() == 3


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_encode_and_decode(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    values = ["b"] * 30 + ["a", "d", "c", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id bigint, c string")
    encoded, tables = P.encode(df, ["c"])
    got = {r["row_id"]: r["c"] for r in encoded.collect()}
    assert len(got) == 34 and got[0] == 1 and got[30] == 0 and got[31] == 3 and got[33] is None
    back = {r["row_id"]: r["c"] for r in P.decode(encoded, tables).collect()}
    assert back == dict(enumerate(values))


def test_one_hot_unknown_is_zero(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    got = [r[0] for r in df.select(P.one_hot(F.col("c"), ["a", "b"])).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0]]
    v = spark.createDataFrame([([0.1, 0.9, 0.5, 0.2, 0.4],)], "v array<double>")
    assert v.select(P.one_hot_inverse(F.col("v"), [2, 3])).first()[0] == [1, 0]
    none = df.select(P.one_hot_inverse(P.one_hot(F.col("c"), ["a", "b"]), [2])[0]).collect()
    assert [r[0] for r in none] == [0, None]


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    bounds = P.limits(df, ["a", "b"])
    scaled = P.min_max(df, bounds)
    assert [tuple(r) for r in scaled.collect()] == [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)]
    assert [tuple(r) for r in P.denormalise(scaled, bounds, as_int=True).collect()] == [(1, 5), (3, 5), (2, 5)]
    low = spark.createDataFrame([(-0.5,), (2.0,)], "a double")
    assert [r[0] for r in P.clip_low(low, ["a"]).collect()] == [0.0, 2.0]


def test_selection(spark):
    df = spark.createDataFrame([(10, 0.1, 1), (20, 0.9, 0), (35, 0.9, 1)], "row_id bigint, score double, label int")
    assert [r["row_id"] for r in P.select_outliers(df, 2).collect()] == [20, 35]
    assert {r["row_id"] for r in P.select_outliers(df, 1, use_label=True).collect()} == {10, 35}
    with pytest.raises(ValueError):
        P.select_outliers(df.drop("label"), 1, use_label=True)
    with pytest.raises(ValueError):
        P.score_or_label(df.drop("score"), use_label=False)
    outliers = df.where("row_id = 35")
    assert {r["row_id"]: r["anomaly"] for r in P.flag_outliers(df, outliers).collect()} == {10: 0, 20: 0, 35: 1}
    assert {r["row_id"] for r in P.normal_rows(df, outliers).collect()} == {10, 20}
    a = [r["row_id"] for r in P.shuffled(df, 1).collect()]
    assert a == [r["row_id"] for r in P.shuffled(df.repartition(3), 1).collect()]


def test_histograms(spark):
    df = spark.createDataFrame([(float(v), int(v > 7)) for v in range(11)], "v double, anomaly int")
    h = X.histogram(df, "v", "anomaly", 5).collect()
    assert sum(r["n"] for r in h) == 11
    assert {(r["bucket"], r["anomaly"]): r["n"] for r in h}[(4, 1)] == 3
    flat = spark.createDataFrame([(2.0, 0), (2.0, 0)], "v double, anomaly int")
    assert [r["n"] for r in X.histogram(flat, "v", "anomaly", 5).collect()] == [2]
    d = X.density_2d(df, "v", "anomaly", 2).collect()
    assert {(r["bx"], r["by"]): r["n"] for r in d} == {(0, 0): 5, (1, 0): 3, (1, 1): 3}


def test_read_delimited_with_question_marks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("negative,41,F,?\nhypothyroid, 23,M,1.5\n")
    df = IO.read_delimited(spark, str(path), "kind string, age int, sex string, tsh double", header=False, missing="?")
    assert [tuple(r) for r in df.collect()] == [("negative", 41, "F", None), ("hypothyroid", 23, "M", 1.5)]
    path.write_text("index,v,c\n3,1.5,a\n")
    assert IO.read_delimited(spark, str(path)).first().asDict() == {"index": 3, "v": 1.5, "c": "a"}


def test_read_attribute_file(spark, tmp_path):
    path = tmp_path / "t.arff"
    path.write_text("% note\n@relation r\n@attribute a {x,y}\n@attribute b real\n@data\nx,1.5\ny,?\n")
    df = IO.read_attribute_file(spark, str(path), "a string, b double")
    assert [tuple(r) for r in df.collect()] == [("x", 1.5), ("y", None)]


def test_wide_and_long_attribution(spark, tmp_path):
    spec = FeatureSpec(("a", "b/s"), frozenset())
    long = spark.createDataFrame(
        [(1, "a", 0.25), (1, "b/s", 0.75), (2, "a", 1.0)], "row_id bigint, feature string, importance double"
    )
    wide = IO.widen(long, spec)
    assert {tuple(r) for r in wide.collect()} == {(1, 0.25, 0.75), (2, 1.0, 0.0)}
    assert IO.lengthen(wide, spec).count() == 4
    with pytest.raises(ValueError):
        IO.lengthen(wide.drop("a_ex"), spec)
    IO.write_attribution(long, spec, str(tmp_path / "ex"), text=True)
    text = spark.read.csv(str(tmp_path / "ex"))
    assert len(text.columns) == 3 and text.count() == 2


def test_members_are_partitioned_and_rules_appended(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i)) for i in range(6)], "row_id bigint, v double")
    clusters = spark.createDataFrame([(2, i, i % 2) for i in range(4)], "k int, row_id bigint, cluster_id int")
    IO.write_members(clusters, rows, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert {r["row_id"] for r in back.where("k = 2 and cluster_id = 1").collect()} == {1, 3}
    rule = spark.createDataFrame([(2, 0, "Feature v is: 1.", 0.5, 0.5)], "k int, cluster_id int, rule_text string, coverage double, purity double")
    for _ in range(2):
        IO.append_rule(rule, str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 2


def test_store_rebuilds_what_was_made_from_something_else(spark, tmp_path):
    built = []
    store = ResultStore(spark, str(tmp_path / "store"))

    def result(depth, rows, reuse=True, name="scores"):
        def build():
            built.append((depth, rows.count()))
            return spark.range(depth)

        return store.get(name, {"detector": PairDetector(depth=depth), "rows": rows, "pairs": [("a", "b")]}, build, reuse).count()

    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "row_id bigint, c string")
    assert result(4, rows) == 4 and result(4, rows.repartition(5)) == 4
    assert built == [(4, 3)]  # neither order nor files matter
    assert result(5, rows) == 5 and result(4, rows.distinct()) == 4 and result(4, rows.withColumn("c", F.lit("a"))) == 4
    assert built == [(4, 3), (5, 3), (4, 2), (4, 3)]
    assert result(4, rows) == 4 and result(4, rows, name="other") == 4 and len(built) == 5
    assert result(4, rows, reuse=False) == 4 and len(built) == 6

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.get("broken", {}, broken)
    assert not store.has("broken", store.key({}))


def test_files_that_describe_themselves(spark, tmp_path):
    arff = tmp_path / "t.arff"
    arff.write_text(
        "% note\n@relation r\n@ATTRIBUTE a {x,y}\n@attribute 'b c' real % not a comment\n@attribute d  NUMERIC\n@attribute e {0,1}\n\n@data\n"
        "x, 1.5,2,0\n% more\ny,?,-3e2,1\n'y',0,?,?\n".replace(" % not a comment", "")
    )
    df = IO.read_attribute_file(spark, str(arff))
    assert df.dtypes == [("a", "string"), ("b c", "double"), ("d", "double"), ("e", "string")]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, [("x", 1.5, 2.0, "0"), ("y", None, -300.0, "1"), ("y", 0.0, None, None)]))
    names, data = tmp_path / "t.names", tmp_path / "t.data"
    names.write_text("| made\nsick, negative.   | classes\n\nage:\tcontinuous.\nsex: M, F.\nTSH: continuous.\n")
    data.write_text("negative,41,F,?\nsick,?,M,1.5\n")
    df = IO.read_named(spark, str(data), str(names))
    assert df.dtypes == [("class", "string"), ("age", "double"), ("sex", "string"), ("TSH", "double")]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, [("negative", 41.0, "F", None), ("sick", None, "M", 1.5)]))
    data.write_text("41,F,?,negative\n")
    assert IO.read_named(spark, str(data), str(names), label_last=True).first().asDict() == {"age": 41.0, "sex": "F", "TSH": None, "class": "negative"}
