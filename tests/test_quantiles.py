import numpy as np

from riskframe.operators import curves
from riskframe.operators.quantiles import column_quantiles, exact_quantiles


def test_quantiles_equal_linear_interpolation(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([np.full(300, 2.5), r.normal(size=400)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0), ("c", None)], "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.731, 1.0]
    for sizes in ({}, {"buckets": 16, "few": 40}):
        got = {r_["g"]: r_["q"] for r_ in exact_quantiles(df, "v", probs, ["g"], **sizes).collect()}
        assert np.allclose(got["a"], np.quantile(x, probs)) and got["b"] == [7.0] * 6 and "c" not in got
    assert column_quantiles(df.where("g = 'c'"), ["v"], [0.5]) == {"v": [None]}


def test_prefix_sums_in_many_buckets_and_one_dominant_group(spark):
    df = spark.range(6000).selectExpr("if(id < 5940, 'big', concat('g', id % 7)) as m", "double(id % 4001) as p", "1L as n")
    df = df.groupBy("m", "p").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    one = {(r["m"], r["p"]): (r["cum_n"], r["tot_n"]) for r in curves.cumulative_desc(df, "p", ["n"], ["m"], 1).collect()}
    many = curves.cumulative_desc(df, "p", ["n"], ["m"], 4000)
    assert one == {(r["m"], r["p"]): (r["cum_n"], r["tot_n"]) for r in many.collect()}


def test_scratch_tables_are_deleted_on_request(spark, monkeypatch):
    from riskframe import session
    monkeypatch.setattr(session, "_WRITTEN", [])
    t = session.materialize(spark.range(3).toDF("id"), "t")
    path = session._WRITTEN[0]
    assert t.count() == 3 and session.release_scratch(spark) == 1
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    x = [-inf, -1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, 1.0, 1.0 + 2e-16, 1e-300, 3.0, 3.0, inf] + [float(k) for k in range(40)]
    df = spark.createDataFrame([(v, 1) for v in x] + [(None, 1), (2.0, 0)], "v double, n int")
    ranks = [k / (len(x) - 1) for k in range(len(x))]
    for sizes in ({}, {"buckets": 1 << 16, "few": 2}):
        got = exact_quantiles(df, "v", ranks, weight="n", **sizes).first()["q"]
        low, high = sorted(x)[0], sorted(x)[-1]
        assert got[0] == low and got[-1] == high
        finite = [(g, e) for g, e in zip(got, sorted(x)) if abs(e) < 1e300]
        assert len(finite) == len(x) - 4 and all(abs(g - e) <= 1e-9 for g, e in finite)
    only = spark.createDataFrame([(nan,), (1.0,), (nan,)], "v double")
    q = exact_quantiles(only, "v", [0.0, 1.0]).first()["q"]
    assert q[0] == 1.0 and q[1] != q[1]
    assert [r["q"] for r in exact_quantiles(only.where("v < 0"), "v", [0.5]).collect()] == [[None]]
    assert exact_quantiles(only.where("v < 0").selectExpr("1 as g", "v"), "v", [0.5], ["g"]).collect() == []


def test_weighted_quantiles_equal_repeated_rows(spark):
    df = spark.range(300).selectExpr("string(id % 2) as g", "double(id * 7919 % 83) as v", "id % 4 as n")
    repeated = df.selectExpr("g", "v", "explode(array_repeat(1, int(n))) as one")
    a = {r["g"]: r["q"] for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"], "n").collect()}
    b = {r["g"]: r["q"] for r in exact_quantiles(repeated, "v", [0.1, 0.5, 0.9], ["g"], buckets=12, few=30).collect()}
    assert a == b
