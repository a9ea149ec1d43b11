"""Commit log and quarantine of the batch stream; saved stages."""
import json
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.plans import model_store
from riskframe.plans.preparation import KnnImputer, ModeImputer, OneHot, RobustScaler
from riskframe.streaming import model_stream

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("c", T.StringType())])


def test_records_are_typed_or_set_aside(spark):
    lines = ['{"id": 1, "x": 2, "c": "a"}', '{"id": null, "x": "NA", "c": "", "more": [1]}', '{"id": 3, "c": "b"}', '[1]', "", "{oops",
             '{"id": 4, "x": "many", "c": true}', '{"x": 1.5, "c": "n/a"}', None]
    rows, aside = model_stream.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"), SCHEMA, ["x", "c"])
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, 2.0, "a"), (None, None, None), (None, 1.5, None)], key=str)
    assert dict(map(tuple, aside.collect())) == {lines[2]: "missing x", "[1]": "not a JSON object", "{oops": "not a JSON object",
                                                 lines[6]: "bad x"}


def test_killed_batches_add_no_row_twice(spark):
    d = tempfile.mkdtemp(prefix="rf-stream-")
    src, out, ckpt = (os.path.join(d, n) for n in ("in", "out", "ckpt"))
    os.makedirs(src)
    for i in range(4):
        with open(os.path.join(src, f"{i}.jsonl"), "w") as f:
            f.write("\n".join([json.dumps({"id": i * 10 + j, "x": j, "c": "k"}) for j in range(5)] + ["bad"]))
    calls = []

    def score(rows):
        calls.append(1)
        if len(calls) == 3:  # dies in its third batch
            raise RuntimeError("killed")
        return rows.withColumn("p", F.col("x") * 2)

    run = lambda: model_stream.score_stream_batches(spark, src, SCHEMA, ["x", "c"], score, out, ckpt, files_per_batch=1)
    with pytest.raises(Exception, match="killed"):
        run()
    # written but not committed: not read, and written anew by the restart
    spark.createDataFrame([(99, 1.0, "k", 2.0)], "id long, x double, c string, p double").write.parquet(f"{out}/scored/batch=2")
    assert model_stream.read_scored(spark, out).count() == 10
    run()
    got = sorted(r["id"] for r in model_stream.read_scored(spark, out).collect())
    assert got == sorted(i * 10 + j for i in range(4) for j in range(5))
    assert model_stream.read_quarantine(spark, out).count() == 4
    # committed, but Spark didn't learn of it: nothing is written
    again = spark.createDataFrame([('{"id": 7, "x": 1, "c": "k"}',)], "value string")
    assert not model_stream.write_batch(again, 3, SCHEMA, ["x", "c"], score, out)
    assert model_stream.read_scored(spark, out).count() == 20


def test_saved_stages_give_the_same_rows_in_another_process(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 13), float(i * i % 17), None if i % 5 == 0 else "abc"[i % 3]) for i in range(60)]
    schema = "id long, u double, v double, c string"
    df = spark.createDataFrame(rows, schema)
    fitted = Pipeline(stages=[KnnImputer(inputCols=["u", "v"], keyCol="id", neighbors=3), RobustScaler(inputCols=["u", "v"]),
                              ModeImputer(inputCols=["c"]), OneHot(inputCols=["c"])]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="rf-stages-"), "m")
    fitted.write().save(path)
    want = sorted(map(tuple, fitted.transform(df).collect()))
    assert sorted(map(tuple, PipelineModel.load(path).transform(df).collect())) == want
    code = ("import json, sys; from riskframe.session import local_session; from pyspark.ml import PipelineModel; s = local_session(2)\n"
            f"df = s.createDataFrame(json.loads(sys.argv[1]), '{schema}')\n"
            f"print(json.dumps(sorted(map(tuple, PipelineModel.load('{path}').transform(df).collect()))))")
    done = subprocess.run([sys.executable, "-c", code, json.dumps(rows)], capture_output=True, text=True, timeout=200,
                          cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert [tuple(r) for r in json.loads(done.stdout.strip().splitlines()[-1])] == want, done.stderr[-2000:]


def test_manifests_switch_whole_versions(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="rf-store-"), "m")
    with pytest.raises(FileNotFoundError):
        model_store.current(spark, d)
    first, second = model_store.new_version(d), model_store.new_version(d)
    model_store.publish(spark, d, first)
    assert model_store.current(spark, d) == first
    model_store.publish(spark, d, second, profile="heart")
    assert model_store.current(spark, d) == second and len(os.listdir(f"{d}/manifests")) >= 2
    assert not model_store.publish_file(spark, f"{d}/manifests/000000002.json", "{}")
