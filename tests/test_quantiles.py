import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fieldcheck.operators import aggregates as A

NAMES = ("q_min", "q1", "median", "q3", "q_max")


def exact(spark, groups, parts=3, **kw):
    data = [(k, float(x)) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(data, "k string, value double").repartition(parts)
    counts = A.value_counts(df, ["k"])
    return {r["k"]: [r[n] for n in NAMES] for r in A.quantiles(counts, ["k"], **kw).collect()}


def check(got, groups):
    assert set(got) == {k for k, xs in groups.items() if len(xs)}
    for k, xs in got.items():
        np.testing.assert_allclose(xs, np.quantile(groups[k], A.FIVE_NUMBERS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("max_groups", [None, 10])
def test_against_brute_force(spark, parts, max_groups):
    rng = np.random.default_rng(7)
    groups = {
        "skewed": np.concatenate([np.full(3000, 36.5), rng.normal(36, 1, 2000)]),
        "signs": rng.normal(0, 100, 501), "wide": 10 ** rng.uniform(-12, 12, 400),
        "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "zeros": np.zeros(9),
        "close": 1e6 + rng.uniform(0, 1e-3, 300),
    }
    check(exact(spark, groups, parts, max_groups=max_groups), groups)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abc"), st.lists(
    st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40), min_size=1))
def test_any_values(spark, groups):
    check(exact(spark, groups), groups)


def test_null_group_and_bad_numbers(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("a", 2.0)], "k string, value double")
    got = {r["k"]: r["median"] for r in A.quantiles(A.value_counts(df, ["k"]), ["k"]).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_sketch_is_close(spark):
    df = spark.range(10001).selectExpr("'a' AS k", "CAST(id AS double) AS value")
    r = A.quantiles_approx(df, ["k"]).first()
    assert [abs(r[n] - e) <= 2 for n, e in zip(NAMES, (0, 2500, 5000, 7500, 10000))] == [True] * 5


def test_values_close_to_each_other(spark):
    """200,000 different epoch milliseconds and two far values: exact, and spread over many runs."""
    df = spark.range(200_000).selectExpr("'a' AS k", "CAST(1757000000000 + id * 7 % 150001 + id AS double) AS value")
    df = df.union(spark.sql("SELECT 'a', CAST(x AS double) FROM VALUES (-1e300), (1e300) AS t(x)")).dropDuplicates(["value"])
    counts = A.value_counts(df, ["k"])
    got = A.quantiles(counts, ["k"]).first()
    values = np.sort(np.array([r[0] for r in df.select("value").collect()]))
    np.testing.assert_allclose([got[n] for n in NAMES], np.quantile(values, A.FIVE_NUMBERS), rtol=1e-15)
    runs = counts.join(A.sketched(counts, ["k"]), "k").groupBy(A.run_of("value", "_pivots").alias("r")).agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("r").collect()
    assert len(runs) > 0.9 * A.PIVOTS and max(r["n"] for r in runs) < 4 * len(values) / A.PIVOTS
    assert all(x["hi"] < y["lo"] for x, y in zip(runs, runs[1:]))


def test_a_value_that_fills_most_rows(spark):
    df = spark.range(30_000).selectExpr("CAST(if(id % 3 = 0, id, 12345.5) AS double) AS value", "id % 2 AS k")
    values = np.array([[r["value"], r["k"]] for r in df.collect()])
    for by, groups in ((["k"], {0: values[values[:, 1] == 0, 0], 1: values[values[:, 1] == 1, 0]}), ([], {None: values[:, 0]})):
        for r in A.quantiles(A.value_counts(df, by), by).collect():
            np.testing.assert_allclose([r[n] for n in NAMES], np.quantile(groups[r["k"] if by else None], A.FIVE_NUMBERS), rtol=1e-12)


def test_quantiles_exchange_little(spark):
    """Besides the counted values themselves: sketches, counts of runs (twice) and wanted values (twice)."""
    df = spark.range(5000).selectExpr("CAST(id AS double) AS value", "id % 2 AS k")
    out = A.quantiles(A.value_counts(df, ["k"]), ["k"], max_groups=2)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange hashpartitioning\((\S+?)#\d+L?, (\S+?)#", text))) <= 4


def test_row_numbers_of_close_values(spark):
    from pyspark.sql import functions as F

    from fieldcheck.operators.ranking import with_row_number

    df = spark.range(5000).selectExpr("id % 2 AS g", "1757000000000 + id * 13 AS t").repartition(4)
    out = with_row_number(df, ["g"], "t")
    bad = out.filter(F.col("row_id") != F.floor((F.col("t") - 1757000000000) / 26) + 1)
    assert out.columns == ["g", "t", "row_id"] and out.count() == 5000 and bad.isEmpty()
