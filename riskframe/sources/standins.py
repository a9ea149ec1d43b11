"""Stand-in patient views derived from the driver's tables.

The clinical CSVs of the reference are private, so every registered query runs
on views that Spark derives from the driver tables; their work grows with the
tables. Each view has a twin in ``riskframe.plans.oracle`` written in DuckDB SQL.

* ``obs``        mixed-type patient-like rows with natural NULLs (key ``id``)
* ``scored``     three "models" scoring every lineitem, labels drawn from a
                 known probability, many tied scores (key ``id``, model ``m``)
* ``points``     8-d numeric vectors from ``embeddings`` (key ``vec_id``)
* ``heart_obs``  heart column names, values hashed from the order key
* ``kidney_obs`` kidney column names, values hashed from the order key
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.rng import h
from riskframe.sources.tables import read_table

# Numeric / categorical column sets of the stand-in views (fixed values).
OBS_NUMERIC = ["o_totalprice", "c_acctbal", "n_lines", "qty", "max_price", "region_no"]
OBS_CATEGORICAL = ["o_orderstatus", "c_mktsegment", "n_name"]
POINT_COLS = [f"x{i}" for i in range(1, 9)]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded by design
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    # partial (map-side) aggregation collapses ~4 lines per order before the shuffle
    lines = (read_table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.sum("l_quantity").alias("qty"),
                  F.max("l_extendedprice").alias("max_price")))
    k = F.col("o_orderkey")
    return (orders
            .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .join(customer, orders.o_custkey == customer.c_custkey)
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(k.alias("id"), "o_totalprice", "c_acctbal",
                    F.col("n_lines").cast("double").alias("n_lines"), "qty", "max_price",
                    F.col("n_regionkey").cast("double").alias("region_no"), "o_orderstatus",
                    F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("c_mktsegment"),
                    "n_name",
                    F.when(h(3, k) % 50 == 0, F.lit(None).cast("int"))
                     .otherwise(F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("num")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, m, pi, p, y): model m's score p for each lineitem; y ~ Bernoulli(pi0²/1e6)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (12 * F.col("l_quantity").cast("bigint")
         + 40 * F.round(F.col("l_discount") * 100).cast("bigint")).alias("pi0"))
    # the label hash depends on the row only: computed once, before the fan-out
    li = li.withColumn("y", F.when(h("y", F.col("id")) % 1000000 < F.col("pi0") * F.col("pi0"), 1).otherwise(0))
    # three models per row by a generator (no join)
    li = li.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    # model 0 carries no noise: CASE skips its hash
    noise = F.when(F.col("m") == 0, F.lit(0)).otherwise(
        (h("n", F.concat(F.col("id"), F.lit("|"), F.col("m"))) % 201) - 100)
    pi = F.greatest(F.lit(0), F.least(F.lit(1000), F.col("pi0") + F.col("m") * noise))
    return (li.withColumn("pi", pi)
            .select("id", "m", "pi",
                    (F.col("pi").cast("double") * F.col("pi") / F.lit(1000000.0)).alias("p"), "y"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight features per vector: the sums of eight components each, so all 64 are read."""
    e = read_table(spark, sf_dir, "embeddings")
    part = lambda i: F.col("embedding")[i].cast("double")
    sums = [sum((part(8 * j + i) for i in range(1, 8)), part(8 * j)).alias(f"x{j + 1}") for j in range(8)]
    return e.select("vec_id", *sums, "label")


# Category vocabularies of the hashed heart stand-in (fixed values).
HEART_SEX = ["female", "male", "male"]
HEART_DATASET = ["Cleveland", "Hungary", "Switzerland", "VA Long Beach"]
HEART_CP = ["asymptomatic", "atypical angina", "non-anginal", "typical angina"]
HEART_RESTECG = ["lv hypertrophy", "normal", "st-t abnormality"]
HEART_SLOPE = ["downsloping", "flat", "upsloping"]
HEART_THAL = ["fixed defect", "normal", "reversable defect"]
HEART_NUMERIC = ["age", "trestbps", "chol", "thalch", "oldpeak", "ca"]
HEART_CATEGORICAL = ["sex", "dataset", "cp", "fbs", "restecg", "exang", "slope", "thal"]


def _pick(vocab: list[str], tag: str, k) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in vocab]), (h(tag, k) % len(vocab) + 1).cast("int"))


def heart_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hashed heart patient per order."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    null_if = lambda tag, mod, val: F.when(h(tag, k) % mod == 0, F.lit(None).cast("double")).otherwise(val)
    return o.select(
        k.alias("id"),
        (29 + h("age", k) % 49).cast("double").alias("age"),
        _pick(HEART_SEX, "sx", k).alias("sex"),
        _pick(HEART_DATASET, "ds", k).alias("dataset"),
        _pick(HEART_CP, "cp", k).alias("cp"),
        null_if("na1", 20, (90 + h("bp", k) % 111).cast("double")).alias("trestbps"),
        null_if("na3", 30, (120 + h("ch", k) % 400).cast("double")).alias("chol"),
        (h("fb", k) % 5 == 0).alias("fbs"),
        _pick(HEART_RESTECG, "re", k).alias("restecg"),
        null_if("na2", 25, (60 + h("hr", k) % 143).cast("double")).alias("thalch"),
        (h("ex", k) % 3 == 0).alias("exang"),
        ((h("op", k) % 63) / F.lit(10.0)).alias("oldpeak"),
        _pick(HEART_SLOPE, "sl", k).alias("slope"),
        null_if("na4", 40, (h("ca", k) % 4).cast("double")).alias("ca"),
        F.when(h("na5", k) % 15 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(HEART_THAL, "th", k)).alias("thal"),
        F.when(h(3, k) % 50 == 0, F.lit(None).cast("int"))
         .otherwise(F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("num"))


# Hashed kidney stand-in: (column, offset, modulus, divisor, NULL every n-th or 0) — fixed values.
KIDNEY_SPEC = [
    ("age", 18, 63, 1, 0), ("bmi", 160, 300, 10, 30), ("bp_systolic", 90, 110, 1, 25),
    ("bp_diastolic", 50, 60, 1, 25), ("serum_creatinine", 3, 120, 10, 20), ("blood_urea_nitrogen", 5, 60, 1, 20),
    ("calcium", 80, 30, 10, 35), ("phosphorus", 20, 40, 10, 35), ("egfr", 10, 120, 1, 0)]
KIDNEY_GENDER = ["Female", "Male"]
KIDNEY_ETHNICITY = ["Mexican American", "Non-Hispanic Asian", "Non-Hispanic Black", "Non-Hispanic White",
                    "Other Hispanic"]


def kidney_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kidney participant per order; the measures turn the order's price by a hashed step."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    cols = []
    for name, off, mod, div, na in KIDNEY_SPEC:
        v = ((F.lit(off) + (h(f"k{name}", k) + cents) % mod) / F.lit(float(div))).cast("double")
        if na:
            v = F.when(h(f"na{name}", k) % na == 0, F.lit(None).cast("double")).otherwise(v)
        cols.append(v.alias(name))
    return o.select(k.alias("participant_id"), *cols,
                    _pick(KIDNEY_GENDER, "kg", k).alias("gender"), _pick(KIDNEY_ETHNICITY, "ke", k).alias("ethnicity"),
                    ((h("kckd", k) + cents) % 7 == 0).cast("double").alias("ckd_present"))
