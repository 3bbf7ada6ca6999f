"""Semantics that are easy to get wrong, on fixtures of a few rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import gates as G
from tidemark.operators import inference as I
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.operators import ranking as R
from tidemark.operators import similarity as V
from tidemark.operators import simulation as X
from tidemark.operators import windows as W
from tidemark.sources import files


def day(i: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(i)


def bars(spark, rows, symbol="A"):
    data = [(symbol, day(i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, close double, volume double")


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_profit_factor_conventions(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("m", 1.0), ("m", -2.0), ("z", 0.0)], "k string, r double")
    out = {r.k: r for r in df.groupBy("k").agg(*[A.profit_factor(F.col("r"), c).alias(c) for c in ("null", "gross", "inf")]).collect()}
    assert (out["g"]["null"], out["g"]["gross"], out["g"]["inf"]) == (None, 3.0, math.inf)
    assert out["m"]["gross"] == 0.5 and out["z"]["inf"] is None


def test_streaks_differ_on_zero(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([-1.0, 0.0, -1.0, 1.0, -1.0])], "i int, r double").withColumn("k", F.lit("a"))
    assert one(W.worst_streak(df, F.col("r") <= 0, "k", "i"), "worst_streak") == [(3,)]
    assert one(W.worst_streak(df, F.col("r") < 0, "k", "i"), "worst_streak") == [(1,)]


def test_true_range_of_the_first_bar(spark):
    out = W.atr(bars(spark, [(1, 3, 1, 2, 1), (5, 6, 5, 5, 1)]), 2, 1).orderBy("date")
    assert one(out, "tr", "atr") == [(2.0, 2.0), (4.0, 3.0)]


def test_quantiles_are_three_things(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 4)], "k string, x double")
    assert one(df.groupBy("k").agg(*A.distribution(F.col("x"))), "p25", "median") == [(1.75, 2.5)]
    assert one(V.conformal_threshold(df, ["k"], "x", 0.5), "threshold") == [(3.0,)]


def test_duplicate_rules(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("b", 1, 30)], "s string, d int, v int")
    assert sorted(one(R.keep_last(df, ["s", "d"], [F.col("v").desc()]), "s", "v")) == [("a", 20), ("b", 30)]
    assert one(R.drop_all_copies(df, ["s", "d"]), "s", "v") == [("b", 30)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 50)), min_size=1, max_size=60), st.integers(1, 20))
def test_capped_top_k_equals_greedy(rows, limit):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(rows)], "id int, b int, s int")
    cap, taken, used = math.ceil(limit * 0.3), [], {}
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][1], i))
    for i in order:
        if used.get(rows[i][0], 0) < cap and len(taken) < limit:
            taken.append(i)
            used[rows[i][0]] = used.get(rows[i][0], 0) + 1
    taken += [i for i in order if i not in taken][: limit - len(taken)]
    assert {r.id for r in R.capped_top_k(df, "b", "s", "id", limit, 0.3).collect()} == set(taken)


def test_business_days(spark):
    rows = [(day(a), day(b)) for a in range(9) for b in range(a, 25)]
    out = spark.createDataFrame(rows, "a date, b date").withColumn("n", S.business_days(F.col("a"), F.col("b"))).collect()
    assert all(r.n == sum((r.a + dt.timedelta(i)).weekday() < 5 for i in range((r.b - r.a).days)) for r in out)


def test_missing_benchmark_counts_as_zero(spark):
    ledger = W.gap_ledger(bars(spark, [(10, 12, 9, 10, 1), (11, 12, 9, 10, 1)]), "SPY")
    matrix = spark.createDataFrame([("t", 0.0, 9.0, "any", "down")], "test_id string, min_gap double, max_gap double, direction string, regime string")
    assert one(X.run_matrix(ledger, matrix, "2024-06-01", {"x1": 0.0}), "test_id", "n") == [("t", 1)]


@pytest.mark.parametrize(
    ("path", "outcome", "r"),
    [
        ([(10, 16, 8, 10)], "stop", -1.0),  # both barriers within a bar: the stop wins
        ([(10, 11, 9.5, 10), (7, 8, 6, 7)], "stop_gap", -3.0),
        ([(10, 11, 9.5, 10), (16, 17, 15, 16)], "target_gap", 6.0),
        ([(8, 9, 7, 8)], "skip_gap", None),
        ([(10, 11, 9.5, 10.5)] * 3, "time", 0.5),
        ([(10, 15, 9.5, 14)], "target", 5.0),
        ([(10, 11, 9.5, 10)], "open", None),
    ],
)
def test_triple_barrier(spark, path, outcome, r):
    df = X.forward_path(bars(spark, [(10, 10, 10, 10, 1), *[(*p, 1) for p in path]]), 3).filter(F.col("date") == F.lit(day(0)))
    got = X.triple_barrier(df, "path", F.lit(9.0), F.lit(15.0), 3).first()
    assert got.outcome == outcome and got.r == (pytest.approx(r) if r is not None else None)


def test_full_hold_and_truncation(spark):
    b = bars(spark, [(i + 1, i + 2, i, i + 1, 1) for i in range(6)])
    signal = F.col("date") >= F.lit(day(2))
    assert len(X.fixed_hold(b, signal, 3).collect()) == 0
    assert one(X.fixed_hold(b, signal, 3, truncate=True), "entry_date", "exit_date") == [(day(3), day(5))]


def test_asof_takes_equal_times_and_nearest_prefers_the_earlier(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, "k", t(10)), (2, "k", t(1)), (3, "q", t(10))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("k", t(10), "x"), ("k", t(4), "w"), ("k", t(16), "y")], "k string, ts timestamp, v string")
    assert sorted(one(J.asof(left, right, ["k"], "ts", ["v"]), "id", "v")) == [(1, "x"), (2, None), (3, None)]
    assert sorted(one(J.asof(left, right, ["k"], "ts", ["v"], tolerance=3), "id", "v")) == [(1, "x"), (2, None), (3, None)]
    mid = spark.createDataFrame([(1, "k", t(7)), (2, "k", t(20))], "id int, k string, ts timestamp")
    assert sorted(one(J.nearest(mid, right, ["k"], "ts", "v"), "id", "v")) == [(1, "w"), (2, "y")]


def test_non_overlap_is_strict(spark):
    df = spark.createDataFrame([("a", 1, 3, 1), ("a", 3, 4, 2), ("a", 4, 6, 3), ("a", 5, 9, 4)], "s string, b int, e int, id int")
    assert sorted(one(J.non_overlapping(df, ["s"], "b", "e", "id"), "id")) == [(1,), (3,)]


def test_cyclic_pairs_report_empty_buckets(spark):
    real = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 9)], "b string, id int")
    pool = spark.createDataFrame([("x", 100), ("x", 101)], "b string, id int")
    assert sorted(one(J.cyclic_pairs(real, pool, "b", "id"), "id", "matched")) == [(0, 100), (1, 101), (2, 100), (3, 101), (4, 100), (9, None)]


def test_benjamini_hochberg_example(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    out = I.benjamini_hochberg(spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, k int, p double"), ["f"], "p", "k").orderBy("k").collect()
    assert [r.rejected for r in out] == [True, True] + [False] * 8
    assert all(a.q_value <= b.q_value for a, b in zip(out, out[1:], strict=False)) and out[2].q_light > out[4].q_light


def test_normal_cdf(spark):
    z = [-8.0, -1.96, -0.3, 0.0, 0.5, 3.0, 7.5]
    got = one(spark.createDataFrame([(x,) for x in z], "z double").select("z", S.normal_cdf(F.col("z")).alias("p")), "z", "p")
    assert all(p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-9) for x, p in got)


def test_bootstraps_bracket_and_repeat(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("a", i, rng.gauss(0.5, 1)) for i in range(300)], "k string, i int, r double")
    one_, two = (I.stationary_bootstrap(df, ["k"], ["i"], "r", draws=200).first() for _ in range(2))
    assert one_ == two and one_.low < one_["mean"] < one_.high and one_.p < 0.05
    means = [r["mean"] for r in I.cluster_bootstrap(df, ["i"], "r").collect()]
    assert len(means) == 100 and min(means) < one_["mean"] < max(means)


def test_dtw_against_plain_recursion():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m, band in ((5, 5, 1), (7, 4, 2), (6, 6, 6)):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        width = max(band, abs(n - m))
        best = {(0, 0): 0.0}
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                if abs(i - j) <= width:
                    best[i, j] = math.dist(a[i - 1], b[j - 1]) + min(best.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        assert V.dtw(a, b, band) == pytest.approx(best[n, m] / max(n, m))


def test_knn_blocks_equal_whole(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, i % 2, [rng.random() for _ in range(4)]) for i in range(60)], "id int, g int, v array<double>")
    whole, small = ({r.id: round(r.knn, 9) for r in V.knn_distance(df, "id", "g", "v", 3, block).collect()} for block in (1024, 7))
    assert whole == small and len(whole) == 60


def test_prototype_slices_equal_whole(spark):
    rng = random.Random(3)
    bank = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(20)], "label int, centroid array<double>")
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(30)], "id int, v array<double>")
    whole, sliced = (sorted(one(V.nearest_prototypes(df, bank, "id", "label", "v", n), "id", "nearest", "ambiguity")) for n in (100, 3))
    assert whole == sliced


def test_quality_normalises_and_reports(spark):
    raw = spark.createDataFrame([("A", "1", "2", "0.5", "1.5", "x"), ("A", "1", "2", "0.5", "1.5", "7")], "symbol string, Open string, High string, Low string, `Adj Close` string, Volume string")
    out = Q.normalize(raw.selectExpr("symbol", "try_cast(Open as double) Open", "try_cast(High as double) High", "try_cast(Low as double) Low", "try_cast(`Adj Close` as double) `Adj Close`", "try_cast(Volume as double) Volume"), ["symbol"])
    assert one(out, "close", "volume") == [(1.5, 7.0)]
    bad = Q.check(bars(spark, [(1, 2, 3, 1, -1)])).first()
    assert bad.violations == ["NEGATIVE_VOLUME", "HIGH_BELOW_LOW", "LOW_ABOVE_BODY"]


def test_leakage_guard(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, f double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, 1.0)], "k int, f double")
    assert sorted(one(Q.leakage(a, b, ["k"], ["f"]), "k")) == [(2,), (3,)]


def test_weeks_without_bars_stay(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0), ("A", dt.date(2024, 1, 17), 2.0)], "symbol string, date date, close double")
    assert one(W.weekly_close(df).orderBy("week"), "close") == [(1.0,), (None,), (2.0,)]


def test_gates(spark):
    df = spark.createDataFrame([(5, None), (500, 2.0)], "n int, pf double")
    tests = [(F.col("n") < 10, "SMALL"), (F.col("pf").isNull(), "NO_PF"), (F.col("n") < 100, "SMALL")]
    assert one(df.select(G.reasons(tests).alias("r"), G.ladder(tests, "PASS").alias("l")), "r", "l") == [(["SMALL", "NO_PF"], "SMALL"), ([], "PASS")]


def test_bar_scan(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,1,5\n2024-01-02,1,2,1,1.5,6\n2024-01-03,x,2,1,1,5\nbad,1,1,1,1,1\n")
    (tmp_path / "BBB.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,1,5\n")
    last = files.scan_bars(spark, str(tmp_path))
    assert sorted(one(last, "symbol", "close", "open")) == [("AAA", 1.0, None), ("AAA", 1.5, 1.0), ("BBB", 1.0, 1.0)]
    assert files.scan_bars(spark, str(tmp_path), "drop").count() == 2
    with pytest.raises(ValueError, match="repeated"):
        files.scan_bars(spark, str(tmp_path), "error")
    with pytest.raises(ValueError, match="forbidden"):
        files.scan_bars(spark, str(tmp_path), forbidden=["2024-01-03"])
    (tmp_path / "CCC.csv").write_text("date,open\n")


def test_universe_scan(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("symbol,secType,selected\n aaa ,stk,TRUE\nAAA,etf,1\nbbb,,no\nccc,,Yes\n,x,1\n")
    assert sorted(one(files.scan_universe(spark, str(path)), "symbol", "product_class")) == [("AAA", "STK"), ("CCC", "STK")]
    with pytest.raises(ValueError, match="symbol"):
        path.write_text("name\nx\n")
        files.scan_universe(spark, str(path))


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    files.write_table(df, f"{tmp_path}/t", ["k"])
    files.write_table(df.filter("k = 'a'").withColumn("v", F.lit(9)), f"{tmp_path}/t", ["k"])
    assert sorted(one(spark.read.parquet(f"{tmp_path}/t"), "k", "v")) == [("a", 9), ("b", 2)]
    files.write_csv(df, f"{tmp_path}/c", ["v", "k"])
    m = files.manifest(spark, f"{tmp_path}/c", "*.csv")
    assert files.manifest_hash(m).first().files == m.count() > 0
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert files.scan_json_rows(spark, str(tmp_path / "j.json"), schema).count() == 2
    assert sorted(one(files.upsert(df, spark.createDataFrame([("b", 7)], "k string, v int"), ["k"]), "k", "v")) == [("a", 1), ("b", 7)]


def test_session_minutes_toward_zero(spark):
    t = lambda m, s: dt.datetime(2024, 1, 1, 9, m, s)
    df = spark.createDataFrame([(t(29, 30), t(30, 0)), (t(31, 59), t(30, 0))], "a timestamp, b timestamp")
    assert one(df.select(S.session_minute(F.col("a"), F.col("b")).alias("m")), "m") == [(0,), (1,)]


def test_periods_and_timeframes(spark):
    df = spark.createDataFrame([("2y", "15m"), ("6mo", "1h"), ("3wk", "x"), ("45d", "5m"), ("max", "1m")], "p string, f string")
    assert one(df.select(S.period_months(F.col("p")).alias("p"), S.timeframe_minutes(F.col("f")).alias("f")), "p", "f") == [(24, 15), (6, 60), (1, 5), (2, 5), (None, 1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 7))
def test_tiles_equal_ntile(days, tiles):
    from pyspark.sql import SparkSession, Window

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d int, i int").withColumn("want", F.ntile(tiles).over(Window.orderBy("d", "i")))
    out = R.indexed(df, [], "d", ["i"]).withColumn("got", R.tile(F.col("index"), F.col("index_of"), tiles)).collect()
    assert all(r.got == r.want for r in out)


def test_soft_warping_of_a_series_with_itself(spark):
    from tidemark.operators import shapes

    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [5.0, 5.0, 5.0]), (3, None)], "id int, v array<double>")
    got = {r.id: r.divergence for r in shapes.soft_dtw_divergence(df, "id", "v", [0.0, 1.0, 2.0]).collect()}
    assert got[1] == pytest.approx(0) and got[2] > 1 and got[3] is None


def test_two_new_trades_a_day(spark):
    from tidemark.operators import portfolio

    rows = [("p", s, day(a), day(b), 0.0) for s, a, b in (("A", 0, 3), ("B", 0, 1), ("C", 0, 1), ("A", 2, 4), ("B", 2, 5), ("C", 4, 5), ("A", 4, 6))]
    df = spark.createDataFrame(rows, "portfolio string, symbol string, entry_date date, exit_date date, ret double")
    got = sorted(one(portfolio.two_new_a_day(df), "symbol", "entry_date"))
    assert got == [("A", day(0)), ("A", day(4)), ("B", day(0)), ("B", day(2)), ("C", day(4))]


def test_two_new_trades_by_plain_fold(spark):
    from tidemark.operators import portfolio

    rng = random.Random(8)
    rows = [(rng.choice("pq"), rng.choice("ABCDEFGH"), day(a), day(a + rng.randint(-1, 9)), float(i)) for i in range(600) for a in [rng.randint(0, 80)]]
    want, opened, locked = [], {}, {}
    for r in sorted(rows):
        p, s, start, end, _ = r
        if opened.get((p, start), 0) < 2 and locked.get((p, s), day(-9)) < start:
            opened[p, start] = opened.get((p, start), 0) + 1
            locked[p, s] = end
            want.append(r)
    df = spark.createDataFrame([*rows, ("p", "A", None, day(3), 0.0), ("p", "A", day(3), None, 0.0)], "portfolio string, symbol string, entry_date date, exit_date date, ret double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in portfolio.two_new_a_day(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) > 50
    assert portfolio.two_new_a_day(df.limit(0)).count() == 0


def test_bootstrap_in_chunks_is_as_wide_as_whole(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, i, rng.gauss(0.1, 1)) for k in "ab" for i in range(2000)] + [("a", 1, None), ("c", 1, 2.0)], "k string, i int, r double")
    spans = {c: {r.k: (r.n, r.high - r.low) for r in I.stationary_bootstrap(df, ["k"], ["i"], "r", draws=400, chunk=c).collect()} for c in (10_000, 128)}
    for k in "ab":
        n, whole = spans[10_000][k]
        # Of independent values the interval is 2 * 1.96 / sqrt(n) wide, about 0.088.
        assert n == 2000 and 0.07 < whole < 0.11 and abs(spans[128][k][1] / whole - 1) < 0.25
    assert spans[128]["c"] == (1, 0.0)
    assert I.stationary_bootstrap(df.limit(0), ["k"], ["i"], "r").count() == 0


def test_newey_west_in_chunks_is_the_whole(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, day(i // 9), i, rng.gauss(0.2, 1)) for k in "ab" for i in range(100)], "k string, d date, i int, r double")
    whole, parts = ({r.k: (r.n, round(r["mean"], 12), round(r.t, 9)) for r in I.newey_west(df, ["k"], ["d", "i"], "r", 3, c).collect()} for c in (1000, 7))
    x = np.array([r.r for r in df.filter("k = 'a'").orderBy("i").collect()])
    e = x - x.mean()
    v = e @ e / 100 + 2 * sum((1 - k / 4) * (e[k:] @ e[:-k]) / 100 for k in (1, 2, 3))
    assert whole == parts and abs(parts["a"][2] - x.mean() / math.sqrt(v / 100)) < 1e-6
    assert I.newey_west(df.limit(0), ["k"], ["d", "i"], "r", 3).count() == 0


def test_outliers_are_noise_and_calibration_rows_apart(spark):
    rows = [(i, 0, [float(i % 5), 0.0]) for i in range(40)] + [(100 + i, 1, [50.0 + i % 5, 0.0]) for i in range(40)] + [(900, 1, [500.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, label int, x array<double>")
    bank = V.prototypes(v.filter("id < 900"), "label", "x")
    got = {r.id: (r.nearest, r.assigned) for r in V.assign_within(v, bank, "id", "label", "x").collect()}
    assert got[900] == (1, -1) and got[0] == (0, 0) and got[102] == (1, 1)
    held = v.filter(V.held_for_calibration("id")).count()
    assert 0 < held < 40


def test_event_gain_quota_scaling_and_report_edges(spark):
    from tidemark.operators import evidence as E
    from tidemark.operators.windows import by

    assert E.quotas([20, 40, 60], 100) == {20: 34, 40: 33, 60: 33} and E.quotas([], 5) == {}
    bars = spark.createDataFrame([("A", day(0), 10.0, 10.0, 10.0), ("A", day(1), 12.0, 9.0, 11.0), ("A", day(2), 11.0, 5.0, 6.0)], "symbol string, date date, high double, low double, close double")
    got = [(round(r.gain, 6), r.direction, r.passed) for r in E.event_gain(bars, by(), 1, 0.1).orderBy("date").collect()]
    assert got == [(0.2, "long", True), (0.545455, "short", True), (0.0, "", False)]
    arrays = spark.sql("SELECT array(1.0D, 4.0D, 9.0D) AS v, array(0.0D, 0.0D) AS c, array(1.0D, 2.0D) AS m, array(0.0D, 2.0D) AS s, array(1.0D) AS short, array(1.0D, double('nan')) AS bad")
    c = lambda n: F.col(n)
    row = arrays.select(E.scaled_for(c("v"), c("c"), c("m"), c("s")), E.scaled_for(c("short"), c("c"), c("m"), c("s")), E.scaled_for(c("v"), c("c"), c("bad"), c("s"))).first()
    assert tuple(row) == ([0.0, 1.0], None, None)
    fine = spark.createDataFrame([(i, int(i >= 80), 0.9 if i >= 80 else 0.02) for i in range(100)], "i int, y int, p double")
    assert E.calibration_report(fine, "y", "p", ["i"]).first().passed
    for bad, reason in ((fine.limit(3), "insufficient_samples"), (fine.withColumn("y", F.lit(2)), "labels_must_be_binary"), (fine.withColumn("p", F.when(F.col("i") > 0, F.col("p"))), "probabilities_must_be_finite_unit_interval"), (fine.limit(0), "insufficient_samples")):
        got = E.calibration_report(bad, "y", "p", ["i"]).first()
        assert got.reason == reason and not got.passed
    assert E.calibration_report(fine.withColumn("w", F.lit(0.0)), "y", "p", ["i"], "w").first().reason == "sample_weight_invalid"


def test_family_check_finds_the_real_edge(spark):
    from tidemark.operators import shapes

    rng = random.Random(5)
    df = spark.createDataFrame([(f"m{k}", day(i), rng.gauss(0.3 if k == 0 else 0.0, 1)) for k in range(6) for i in range(250)], "m string, d date, r double")
    got = {r.m: r.p_family for r in shapes.family_max(df, "m", "d", "r").collect()}
    assert got["m0"] < 0.05 and min(v for k, v in got.items() if k != "m0") > 0.05
    stepped = sorted((-r.t, r.p_adjusted, r.m) for r in shapes.romano_wolf(df, "m", "d", "r").collect())
    assert stepped[0][2] == "m0" and stepped[0][1] < 0.05
    assert all(a[1] <= b[1] for a, b in zip(stepped, stepped[1:], strict=False)) and all(p <= got[m] + 1e-9 or p <= stepped[0][1] for _, p, m in stepped)


def test_cups():
    import numpy as np

    from tidemark.operators.shapes import find_cup

    t = np.linspace(-1, 1, 60)
    assert find_cup(100 + 25 * t**2)[0] and not find_cup(100 - 25 * t**2)[0] and not find_cup(100 + 25 * t)[0] and not find_cup(t[:5])[0]


def test_streamed_monitors_equal_plain_loops(spark, data):
    from tidemark.streaming import jobs

    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts", "event_id").collect()
    up, down, n, want = {}, {}, {}, []
    for e in events:
        k = e.event_type
        n[k] = n.get(k, 0) + 1
        up[k], down[k] = max(0.0, up.get(k, 0.0) + e.value - 55.0), max(0.0, down.get(k, 0.0) - (e.value - 50.0) - 5.0)
        if up[k] > 200 or down[k] > 200:
            want.append((k, n[k], "up" if up[k] > 200 else "down"))
            up[k] = down[k] = 0.0
    got = jobs.run_available(jobs.drift_monitor(jobs.read_events(spark, data), "event_type", "value", 50.0, 5.0, 200.0))
    assert sorted(one(got, "event_type", "n", "side")) == sorted(want)
    recent, admitted = {}, {}
    for e in events:
        now = e.ts.timestamp()
        recent[e.user_id] = [t for t in recent.get(e.user_id, []) if t > now - 3600]
        admitted[e.event_id] = len(recent[e.user_id]) < 2
        if admitted[e.event_id]:
            recent[e.user_id].append(now)
    got = jobs.run_available(jobs.admission(jobs.read_events(spark, data), "user_id", 3600, 2))
    assert {r.event_id: r.admitted for r in got.collect()} == admitted


def test_sessions_close_after_the_gap(spark, data):
    from tidemark.streaming import jobs

    got = jobs.run_available(jobs.sessions(jobs.read_events(spark, data))).collect()
    assert got and all((r.end - r.start).total_seconds() >= 1800 for r in got)


def test_spending_reaches_alpha(spark):
    from tidemark.operators import reports

    got = [r.s for r in spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "t double").select(reports.obrien_fleming(F.col("t")).alias("s")).collect()]
    assert got[0] < 1e-6 and got[0] < got[1] < got[2] == pytest.approx(0.05)


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_soft_dtw_equals_plain_recursion(spark):
    from tidemark.operators import shapes

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=7), rng.normal(size=5)

    def plain(x, y, gamma):
        t = {(0, 0): 0.0}
        for i in range(len(x)):
            for j in range(len(y)):
                near = [t[k] for k in ((i, j + 1), (i + 1, j), (i, j)) if k in t]
                t[i + 1, j + 1] = (x[i] - y[j]) ** 2 - gamma * np.log(sum(np.exp(-v / gamma) for v in near))
        return t[len(x), len(y)]

    want = plain(a, b, 0.7) - 0.5 * (plain(a, a, 0.7) + plain(b, b, 0.7))
    df = spark.createDataFrame([(1, a.tolist()), (2, None), (3, b.tolist())], "id long, v array<double>")
    got = {r.id: r.divergence for r in shapes.soft_dtw_divergence(df, "id", "v", b.tolist(), 0.7).collect()}
    assert got[1] == pytest.approx(want) and got[2] is None and got[3] == pytest.approx(0, abs=1e-9)


def test_cusum_carries_its_state_over_batches(spark):
    rng = np.random.default_rng(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, float(x)) for k in "ab" for i, x in enumerate(rng.normal(size=200))] + [("c", 0, None), ("c", 1, 9.0)]
        df = spark.createDataFrame(rows, "k string, i long, x double").repartition(4)
        got = {r.k: (r.n, r.first_trigger) for r in W.cusum(df, "k", ["i"], "x", 0.0, 0.2, 4.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in "abc":
        up = down = hit = 0
        for _, i, x in (r for r in rows if r[0] == k):
            up, down = (max(0, up + x - 0.2), max(0, down - x - 0.2)) if x is not None else (up, down)
            hit = hit or (i + 1 if max(up, down) > 4 else 0)
        assert got[k] == (sum(r[0] == k for r in rows), hit)


def test_prices_of_zero_give_infinities_as_in_sql(spark):
    # Opens a session at zero, so that returns and the distance to the average price divide by it.
    rows = [("a", 1, i, p) for i, p in enumerate([0.0, 0.0, 2.0, 4.0, 0.0, 3.0])]
    bars = spark.createDataFrame(rows, "symbol string, session int, ts int, close double").withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    con = duckdb.connect()
    con.execute("CREATE TABLE b (ts INTEGER, p DOUBLE)")
    con.executemany("INSERT INTO b VALUES (?, ?)", [(i, p) for _, _, i, p in rows])
    want = con.sql("SELECT p / lag(p) OVER w - 1, p / lag(p, 3) OVER w - 1, (p / avg(p) OVER w - 1) * 10000 FROM b WINDOW w AS (ORDER BY ts) ORDER BY ts").fetchall()
    got = [tuple(r) for r in W.vwap(W.feature_cube(bars)).orderBy("ts").select("ret1", "ret3", "distance_bps").collect()]
    assert [[repr(x) for x in r] for r in got] == [[repr(x) for x in r] for r in want]
    assert got[1][0] != got[1][0] and got[2][0] == float("inf")


def test_quantiles_by_counts(spark):
    rng = np.random.default_rng(5)
    groups = {"few": [3.0], "two": [-1.0, 8.0], "same": [0.25] * 9, "signs": [-0.0, 0.0, -2.5, 7.0, 1e-310, -1e200, 1e200, 8.0, 7.999999999999999], "many": [*np.exp(rng.normal(0, 3, 500)), *-rng.random(300), *([0.1] * 99)]}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("none", None)], "k string, x double")
    got = {r.k: (r.a, r.b, r.c) for r in A.quantiles(df, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.9])), rel=1e-12, abs=1e-300), k


def test_without_top_rows_of_small_groups(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("a", 3, -7.0), ("a", 4, 1.0), ("b", 1, 2.0), ("b", 2, 3.0), (None, 1, 1.0), (None, 2, 2.0), (None, 3, 4.0), ("c", 1, None), ("c", 2, None), ("c", 3, None)]
    out = A.without_top_rows(spark.createDataFrame(rows, "k string, i int, x double"), "k", "x", [F.abs("x").desc(), "i"], 2)
    assert {r.k: (r["mean"], r.n) for r in out.collect()} == {"a": (1.0, 2), None: (1.0, 1), "c": (None, 1)}


def test_knn_of_close_and_odd_vectors(spark):
    # Far from zero, where products round away the distances; one vector isn't finite.
    rng = np.random.default_rng(2)
    v = (1e6 + rng.normal(0, 1e-3, (60, 4))).tolist() + [[float("nan"), 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, "a" if i < 30 else "b", x) for i, x in enumerate(v)], "id int, g string, v array<double>")
    got = {r.id: r.knn for r in V.knn_distance(df, "id", "g", "v", 3).collect()}
    for i in range(60):
        same = [j for j in range(61) if (j < 30) == (i < 30) and j != i and j != 60]
        assert got[i] == pytest.approx(np.mean(sorted(math.dist(v[i], v[j]) for j in same)[:3]), rel=1e-12)


def test_drift_monitor_takes_bare_numbers(spark, data):
    from tidemark.streaming import jobs

    out = jobs.drift_monitor(jobs.read_events(spark, data), "event_type", "value", 50.0, 5.0, 200.0)
    assert "_us" in out._jdf.queryExecution().logical().toString()
