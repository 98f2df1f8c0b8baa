from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weekpanel.contracts import ContractError, assert_known, assert_unique, require_columns
from weekpanel.operators import joins, ranking
from weekpanel.operators import rows as R
from weekpanel.operators.aggregates import classification_report, correlation_pairs, exact_quantiles, mode_of
from weekpanel.operators.neighbours import knn_classify, nearest
from weekpanel.operators.regression import var_fit
from weekpanel.operators.sampling import balance_binary, fold_assign, stratified_split
from weekpanel.operators.sets import upsert


def hot(spark, n=3000):
    """A third of the rows share one key; keys may be missing."""
    rnd = random.Random(1)
    return spark.createDataFrame(
        [("hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rnd.randrange(40)}"), rnd.randrange(10), i) for i in range(n)],
        "k string, o int, i int",
    ).repartition(7)


def expected_numbers(data):
    seen, out = {}, {}
    for k, o, i in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        out[i] = seen.get(k, 0)
        seen[k] = out[i] + 1
    return out


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_occurrence_index_both_ways(spark, limit):
    df = hot(spark)
    want = expected_numbers([tuple(r) for r in df.collect()])
    got = ranking.occurrence_index(df, ["k"], [F.col("o"), F.col("i")], "n", limit, 6)
    assert {r["i"]: r["n"] for r in got.collect()} == want


def test_bucketed_position(spark):
    df = hot(spark)
    want = expected_numbers([tuple(r) for r in df.collect()])
    got = ranking.bucketed_position(df, ["k"], F.col("o"), [F.col("i")])
    assert {r["i"]: r["position"] - 1 for r in got.collect()} == want


def test_global_position(spark):
    df = hot(spark)
    got = ranking.global_position(df, [F.desc("o"), F.asc("i")], "id", 5)
    data = sorted(((r["o"], r["i"], r["id"]) for r in got.collect()), key=lambda r: (-r[0], r[1]))
    assert [r[2] for r in data] == list(range(1, len(data) + 1))


def test_occurrence_join_matches_duplicates_one_to_one(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 9)], "k string, s int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "q")], "k string, h string")
    for limit in (100, 1):
        out = joins.occurrence_join(left, right, ["k"], [F.col("s")], [F.col("h")], ["h"], limit)
        assert rows(out.select("k", "s", "h")) == [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "q"), ("b", 9, None)]


def test_two_branch_dedup(spark):
    data = [("1", "A", "h", "s"), ("1", "A", "h2", "s2"), ("1", "B", "h", "s"), ("nan", "A", "h", "s"), (None, "A", "h", "s"),
            ("None", "A", "h", "s2"), ("", "A", "h", "s2")]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in data], "ID string, Ticker string, Headline string, Summary string")
    out = R.dedup_two_branches(df, "ID", "Ticker", ["Ticker", "Headline", "Summary"])
    assert out.count() == 4
    assert rows(R.dedup_two_branches(out, "ID", "Ticker", ["Ticker", "Headline", "Summary"])) == rows(out)


def test_best_per_key_orders_missing_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 3), (None, 1, 4), (None, 2, 5)], "k string, v int, i int")
    assert rows(R.best_per_key(df, ["k"], [F.col("v")], ["i"])) == [("a", 5, 3), (None, 2, 5)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    once = upsert(old, new, ["k"])
    assert rows(once) == [("a", 9), ("b", 3)] and rows(upsert(once, new, ["k"])) == rows(once)
    assert rows(upsert(old, new.limit(0), ["k"])) == rows(old)


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    for bad in (lambda: require_columns(df, ["z"]), lambda: assert_unique(df, ["k"]), lambda: assert_known(df, "k", ["b"])):
        with pytest.raises(ContractError):
            bad()
    dim = spark.createDataFrame([("b", 1)], "k string, id int")
    with pytest.raises(Exception, match="no single row for"):
        joins.foreign_key(df, dim, {"k": "k"}, "id").collect()


def test_filters_accept_scalar_list_and_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a",)], "k string")
    for v in ("a", ["a"], table, ["a"] + [f"x{i}" for i in range(2000)]):
        assert rows(R.filter_in(df, "k", v)) == [("a",)]
        if not isinstance(v, str):
            assert rows(R.filter_not_in(df, "k", v)) == [("b",), (None,)]


def test_mode_and_quantiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 1, 2, 2, 3, 10, 4]] + [("h", 5.0), ("n", None)], "g string, v double")
    assert rows(mode_of(df, "v", ["g"])) == [("g", 1.0, 2), ("h", 5.0, 1)]
    q = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, "g", "v", [0.25, 0.5]).collect()}
    assert q == {"g": (float(np.quantile([1, 1, 2, 2, 3, 10, 4], 0.25)), 2.0), "h": (5.0, 5.0)}


def test_correlations_with_missing_values_both_ways(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 3)) + 100.0
    data = [[None if rnd.random() < 0.2 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(data, "a double, b double, c double")
    a = {(r["a"], r["b"]): r["r"] for r in correlation_pairs(df, ["a", "b", "c"]).collect()}
    b = {(r["a"], r["b"]): r["r"] for r in correlation_pairs(df, ["a", "b", "c"], 0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_report_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (2, 0)], "y int, p int")
    out = {r["class"]: r for r in classification_report(df, "y", "p").collect()}
    assert (out["0"]["precision"], out["0"]["recall"], out["0"]["support"]) == (0.5, 1.0, 2)
    assert out["2"]["precision"] == 0.0 and out["2"]["f1"] == 0.0
    assert abs(out["macro avg"]["recall"] - 0.5) < 1e-12 and abs(out["weighted avg"]["recall"] - 0.6) < 1e-12


def brute_balance(data, m):
    """Quotas and even spacing, written down directly."""
    groups = {}
    for t, d, r in data:
        groups.setdefault((t, d[:4]), []).append((d, r))
    sizes = {g: len(v) for g, v in groups.items()}
    big = m >= len(groups)
    weights = {g: n - 1 if big else n for g, n in sizes.items()}
    total = m - len(groups) if big else m
    s = sum(weights.values())
    exact = {g: (w / s * total if s else 0.0) for g, w in weights.items()}
    quota = {g: math.floor(x) for g, x in exact.items()}
    order = sorted(exact, key=lambda g: (-(exact[g] - quota[g]), -weights[g], g))
    for g in order[: total - sum(quota.values())]:
        quota[g] += 1
    out = []
    for g, v in groups.items():
        q, v = quota[g] + (1 if big else 0), sorted(v)
        out += v if q >= len(v) else [v[math.floor((i + 0.5) * len(v) / q)] for i in range(q)]
    return sorted(r for _, r in out)


@pytest.mark.parametrize("share,tickers", [(0.3, 4), (0.02, 12), (0.5, 3), (0.1, 5)])
def test_balance_equals_brute_force(spark, share, tickers):
    rnd = random.Random(int(share * 100) + tickers)
    data = []
    for t in range(tickers):
        for y in (2021, 2022):
            for w in range(rnd.randrange(2, 30)):
                data.append((f"T{t}", f"{y}-{1 + w // 3:02d}-{1 + w % 3 * 7:02d}", int(rnd.random() < share), len(data)))
    df = spark.createDataFrame(data, "Ticker string, d string, y int, r int").selectExpr("Ticker", "cast(d as date) as WeekEndingFriday", "y", "r")
    got = [tuple(r) for r in balance_binary(df.repartition(5), "y").collect()]
    again = [tuple(r) for r in balance_binary(df.orderBy(F.rand(2)), "y").collect()]
    assert sorted(got) == sorted(again)
    counts = {c: sum(1 for x in data if x[2] == c) for c in (0, 1)}
    if counts[0] == counts[1]:
        assert len(got) == len(data)
        return
    major = max(counts, key=counts.get)
    want = brute_balance([(t, d, r) for t, d, y, r in data if y == major], min(counts.values()))
    assert sorted(r for _, _, y, r in got if y == major) == want
    assert sum(1 for g in got if g[2] != major) == min(counts.values())


def test_balance_leaves_one_class_alone(spark):
    df = spark.createDataFrame([("A", "2021-01-01", 1), ("A", "2021-01-08", 1)], "Ticker string, d string, y int")
    df = df.selectExpr("Ticker", "cast(d as date) as WeekEndingFriday", "y")
    assert balance_binary(df, "y").count() == 2


def test_stratified_split_is_a_partition(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(233)], "id int, y int")
    train, test = stratified_split(df, "y", ["id"])
    assert test.count() == math.ceil(0.2 * 233) and rows(train.union(test)) == rows(df)
    assert rows(stratified_split(df.repartition(9), "y", ["id"])[1]) == rows(test)
    sizes = fold_assign(df, "y", ["id"]).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_equal_brute_force_both_ways(spark, metric):
    rnd = np.random.default_rng(5)
    data = [(i, [float(x) for x in rnd.integers(-3, 4, 4)], int(rnd.integers(0, 3))) for i in range(150)]
    df = spark.createDataFrame(data, "id int, v array<double>, label int")
    test, train = df.filter("id % 3 = 0"), df.filter("id % 3 <> 0")

    def unit(x):
        x = np.array(x)
        n = np.linalg.norm(x)
        return x / n if metric == "cosine" and n else x

    want = set()
    for i, v, _ in data[::3]:
        d = sorted((round(float(np.linalg.norm(unit(v) - unit(u))), 9), j) for j, u, _ in data if j % 3)
        want.add((i, tuple(sorted(j for _, j in d[:5]))))
    for limit in (10**9, 0):
        found = {}
        for r in nearest(test, train, 5, "id", "v", "label", metric, limit, 30).collect():
            found.setdefault(r["test_id"], []).append(r["train_id"])
        got = {(i, tuple(sorted(j))) for i, j in found.items()}
        # equal distances may differ in the last bit between the two formulas, only for the cosine form
        assert got == want if metric == "euclidean" else len(got & want) > 40
    assert knn_classify(test, train, 5, "id", "v", "label").count() == 50


def test_var_equals_least_squares_over_many_batches(spark):
    rnd = np.random.default_rng(7)
    n, p = 400, 2
    share = rnd.dirichlet([2, 3, 4], n).round(4)
    price = np.cumsum(rnd.normal(size=n)) + 50
    data = [("A", i, float(price[i]), *map(float, share[i])) for i in range(n)] + [("B", i, 1.0 * i, 0.1, 0.2, 0.7) for i in range(4)]
    df = spark.createDataFrame(data, "Ticker string, w int, y double, a double, b double, c double")
    x = np.array([[1, *[v for lag in range(1, p + 1) for v in (price[i - lag], *share[i - lag])]] for i in range(p, n)])
    y = price[p:]
    full, *_ = np.linalg.lstsq(x, y, rcond=None)
    keep = [0, 1, 5]
    small, *_ = np.linalg.lstsq(x[:, keep], y, rcond=None)
    r1, r0 = ((y - x @ full) ** 2).sum(), ((y - x[:, keep] @ small) ** 2).sum()
    rank = np.linalg.matrix_rank(x)
    f = ((r0 - r1) / (rank - 3)) / (r1 / (len(y) - rank))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = var_fit(df, "Ticker", "w", "y", ["a", "b", "c"], p).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert [r["Ticker"] for r in got] == ["A"]
    r = got[0]
    beta = np.array([r["coefficients"][k] for k in ["const", *[f"L{lag}.{c}" for lag in (1, 2) for c in "yabc"]]])
    assert r["n_obs_used"] == n and np.allclose(x @ beta, x @ full, atol=1e-6)
    assert abs(r["f_statistic"] - f) < 1e-6 * max(1.0, f) and 0 <= r["p_value"] <= 1


def test_foreign_key_stops_at_a_lost_fact(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    dim = spark.createDataFrame([("a", 7)], "k string, id int")
    assert rows(joins.foreign_key(df.filter("k = 'a'"), dim, {"k": "k"}, "id")) == [(1, 7)]
    for bad in (joins.foreign_key(df, dim, {"k": "k"}, "id"), joins.foreign_key(df, dim.union(dim).union(dim.withColumn("k", F.lit("b"))), {"k": "k"}, "id")):
        with pytest.raises(Exception, match="no single row"):
            bad.collect()


def test_lists_with_a_missing_value(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    for tail in ([], [f"x{i}" for i in range(2000)]):
        assert rows(R.filter_not_in(df, "k", ["a", None, *tail])) == [("b",), (None,)]
        assert rows(R.filter_in(df, "k", ["a", None, *tail])) == [("a",)]


def test_quantiles_with_one_outlier(spark):
    values = [*range(5000), 10**12]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = exact_quantiles(df, "g", "v", [0.1, 0.5, 0.99, 1.0]).first()
    assert [got[f"q{i}"] for i in range(4)] == [float(np.quantile(values, p)) for p in (0.1, 0.5, 0.99, 1.0)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_in_buckets(spark, metric):
    from weekpanel.operators.neighbours import knn_classify, nearest, nearest_in_buckets

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * 20
    data = [(i, (centres[i % 12] + rng.standard_normal(8)).tolist(), i % 12) for i in range(1200)]
    df = spark.createDataFrame(data, "id long, v array<double>, label int")
    test, train = df.filter("id % 10 = 0"), df.filter("id % 10 > 0")
    whole = nearest(test, train, 4, "id", "v", "label", metric)
    for rows_of_block in (20_000, 50):  # the parts of a large bucket lie in several tasks
        found = nearest_in_buckets(test, train, 4, "id", "v", "label", metric, block_rows=rows_of_block)
        hit = whole.join(found.select("test_id", "train_id"), ["test_id", "train_id"]).count()
        assert hit >= 0.9 * whole.count() and found.groupBy("test_id").count().filter("count > 4").count() == 0
    assert rows(knn_classify(test, train, 4, "id", "v", "label", metric, in_buckets=True)) == rows(test.select("id", "label"))
    assert nearest_in_buckets(test, train.limit(0), 4, "id", "v", "label", metric).count() == 0
