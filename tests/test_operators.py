"""Operators on small rows with known results, and features that must not look ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe.functions import scalars
from tideframe.operators import asof, bars, features, labels, metrics, predicates, quality, ranking, scan, schedules


def walk(n=300, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    open_ = np.r_[100, close[:-1]]
    return pd.DataFrame({"symbol": "x", "t": np.arange(n) * 3600, "close_t": np.arange(1, n + 1) * 3600, "open": open_, "high": np.maximum(open_, close) + 1, "low": np.minimum(open_, close) - 1, "close": close, "volume": rng.integers(1, 50, n), "quote_volume": close * 10, "taker_buy": close * 4, "trades": 5})


def test_recurrence_equals_ewm(spark):
    p = walk(700)
    df = spark.createDataFrame(p)
    for span in (2, 12, 200):
        got = features.ema(df, "close", span, "y").orderBy("t").toPandas()["y"].to_numpy()
        want = p["close"].ewm(span=span, adjust=False, min_periods=span).mean().to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_recurrence_starts_at_the_first_value(spark):
    df = spark.createDataFrame([("x", i, None if i < 3 else float(i)) for i in range(8)], "symbol string, t int, v double")
    got = [r["y"] for r in scan.recurrence(df, ["symbol"], "t", {"y": ("v", 0.5)}).orderBy("t").collect()]
    assert got[:4] == [None, None, None, 3.0] and got[4] == 3.5


def test_wilder_indicators(spark):
    p = walk()
    got = features.wilder_indicators(spark.createDataFrame(p)).orderBy("t").toPandas()
    d = p["close"].diff()
    up, down = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (d, -d))
    np.testing.assert_allclose(got["wilder_rsi"].to_numpy(), (100 - 100 / (1 + up / down)).to_numpy(), rtol=1e-9)
    fast, slow = (p["close"].ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26))
    np.testing.assert_allclose(got["macd_line"].to_numpy(), (fast - slow).to_numpy(), rtol=1e-7, atol=1e-9)


def test_features_do_not_look_ahead(spark):
    p = walk(120)
    whole = features.wilder_indicators(features.core_features(spark.createDataFrame(p))).where("t < 288000").orderBy("t").toPandas()
    cut = features.wilder_indicators(features.core_features(spark.createDataFrame(p[p["t"] < 288000]))).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(whole, cut, check_dtype=False, rtol=1e-9)


def test_barrier_label_golden(spark):
    rows = [(100, 101, 99, 100), (100, 103, 99.5, 102), (102, 106, 101, 105), (105, 107, 104, 106)]
    df = spark.createDataFrame([("x", i, *map(float, r)) for i, r in enumerate(rows)], "symbol string, t int, open double, high double, low double, close double")
    r = labels.barrier_labels(df, 3, 0.02, 0.04, 0.001).orderBy("t").first()
    assert (r["stop_price"], r["target_price"], r["bars_to_target"], r["target_before_stop"]) == (98.0, 104.0, 2, True)
    assert r["mfe_r"] == pytest.approx(3.5) and r["mae_r"] == pytest.approx(-0.25) and r["realized_r"] == pytest.approx(1.95)


def test_labels_without_a_whole_window(spark):
    df = spark.createDataFrame([("x", 0, 1.0, 1.0, 1.0, 1.0)], "symbol string, t int, open double, high double, low double, close double")
    r = labels.barrier_labels(df, 3, 0.02, 0.04, 0.001).first()
    assert r["reason"] == "insufficient_window" and r["realized_r"] is None and r["target_before_stop"] is None


def test_trailing_exit(spark):
    rows = [(100, 100, 100, 100), (100, 103, 99.5, 102), (102, 102, 99, 99)]
    df = spark.createDataFrame([("x", i, *map(float, r)) for i, r in enumerate(rows)], "symbol string, t int, open double, high double, low double, close double")
    for tie, bars in (("stop_first", 1), ("target_first", 2)):
        r = labels.trailing_exit(df, 2, 0.02, 1.0, 0.1, 1.0, cost=0.001, tie=tie).orderBy("t").first()
        assert (r["exit_reason"], r["exit_bars"], r["breakeven_bars"]) == ("dynamic_stop", bars, 1) and r["exit_r"] == pytest.approx(0.45)
    # Trailing doesn't wait for the break-even level; a short mirrors a long; too few bars give nulls.
    far = labels.trailing_exit(df, 2, 0.02, 9.0, 0.1, 1.0).orderBy("t").first()
    assert (far["exit_bars"], far["breakeven_bars"]) == (1, None) and far["exit_r"] == pytest.approx(0.5)
    mirrored = df.select("symbol", "t", (200 - F.col("open")).alias("open"), (200 - F.col("low")).alias("high"), (200 - F.col("high")).alias("low"), (200 - F.col("close")).alias("close"))
    short = labels.trailing_exit(mirrored, 2, 0.02, 1.0, 0.1, 1.0, cost=0.001, side=F.lit("short")).orderBy("t").first()
    assert (short["exit_reason"], short["exit_bars"]) == ("dynamic_stop", 1) and short["exit_r"] == pytest.approx(0.45)
    assert labels.trailing_exit(df, 3, 0.02, 1.0, 0.1, 1.0).where("exit_r IS NOT NULL OR exit_reason IS NOT NULL").count() == 0


def test_outcome_metrics_golden(spark):
    df = spark.createDataFrame([("b", i, r) for i, r in enumerate([1.9, -1.1, 0.4])], "book string, id int, net_r double")
    m = metrics.outcome_metrics(df).first()
    assert (m["trades"], m["mean_r"], m["win_rate"]) == (3, pytest.approx(0.4), pytest.approx(2 / 3)) and m["profit_factor"] == pytest.approx(2.3 / 1.1, abs=1e-6)
    c = metrics.equity_curve(df, 10000.0, 0.01, ["book"], ["id"])
    d = metrics.longest_drawdown(c, ["book"], ["id"]).first()
    assert d["final_equity"] == pytest.approx(10118.22164, abs=1e-4) and d["max_drawdown"] == pytest.approx(0.011, abs=1e-6)


def test_book_summary_golden(spark):
    payload = '{"bids": [["99", "50"], ["98", "9.6939"]], "asks": [["101", "5"], ["102", "20"]]}'
    x = bars.book_summary(bars.book_levels(spark.createDataFrame([(1, payload)], "id int, payload string")), ["id"]).first()
    assert (x["best_bid"], x["best_ask"], x["mid"], x["spread_bps"]) == (99, 101, 100, 200)


def test_asof_takes_the_latest_known(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "symbol string, t int")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0), ("a", 25, 3.0)], "symbol string, rt int, v double")
    got = {(r["symbol"], r["t"]): r["v"] for r in asof.asof(left, right, "t", "rt", ["symbol"], ["v"]).collect()}
    assert got == {("a", 10): 1.0, ("a", 20): 2.0, ("b", 5): None}
    strict = {(r["symbol"], r["t"]): r["v"] for r in asof.asof(left, right, "t", "rt", ["symbol"], ["v"], allow_exact=False).collect()}
    assert strict["a", 10] is None
    aged = {(r["symbol"], r["t"]): r["v"] for r in asof.asof(left, right, "t", "rt", ["symbol"], ["v"], max_age=4).collect()}
    assert aged["a", 20] is None


def test_interval_join_has_each_pair_once(spark):
    left = spark.createDataFrame([("a", 5, 25)], "symbol string, lo int, hi int")
    right = spark.createDataFrame([("a", i) for i in range(40)], "symbol string, t int")
    assert sorted(r["t"] for r in asof.interval_join(left, right, "lo", "hi", "t", ["symbol"], 20).collect()) == list(range(5, 26))


def test_admission_counts_down_on_skips_only(spark):
    df = spark.createDataFrame([("a", i, i, r) for i, r in enumerate([-1.0, 1.0, 1.0, 1.0, 1.0])], "symbol string, id long, decision_t long, net_r double")
    assert sorted(r["id"] for r in ranking.admitted(df, 2, 2).collect()) == [0, 3]


def test_abstention_fails_closed(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "id int, x double")
    got = {r["id"]: (r["missing"], r["blocked"]) for r in predicates.abstain(df, [[predicates.Condition("x", ">", 2)]]).collect()}
    assert got == {1: (["x"], True), 2: ([], True), 3: ([], False)}


def test_unknown_operator():
    with pytest.raises(ValueError):
        predicates.Condition("x", "~", 1).column


def test_candle_rules_and_guard(spark):
    df = spark.createDataFrame([(2, 1, 10.0, 9.0, 8.0, 9.5, -1)], "t int, close_t int, open double, high double, low double, close double, volume int")
    assert quality.violations(df, quality.candle_rules()).first()["violations"] == ["close_after_open", "high_covers_body", "volume_not_negative"]
    with pytest.raises(ValueError):
        quality.require_columns(df.withColumn("net_r", F.lit(1)), ["t"])


def test_scalars(spark):
    df = spark.createDataFrame([("BTCUSDT", "15m", "2024-01-01T00:00:00Z", 0.0)], "s string, tf string, at string, z double")
    r = df.select(scalars.base_asset(F.col("s")).alias("b"), scalars.quote_asset(F.col("s")).alias("q"), scalars.timeframe_seconds(F.col("tf")).alias("n"), F.unix_seconds(scalars.rfc3339(F.col("at"))).alias("t"), scalars.ratio(F.lit(1), F.col("z")).alias("r"), scalars.clip(F.lit(None).cast("double"), 0.5, 2).alias("c")).first()
    assert tuple(r) == ("BTC", "USDT", 900, 1704067200, None, None)


def test_weighted_split_spends_the_month(spark):
    days = pd.date_range("2024-01-01", "2024-02-29").date
    df = spark.createDataFrame(pd.DataFrame({"symbol": "x", "day": days, "close": np.linspace(50, 80, len(days))}))
    got = schedules.weighted_split(schedules.ma_distance_weight(df, 5), 100).groupBy("month").agg(F.sum("spend").alias("s")).collect()
    assert all(r["s"] == pytest.approx(100) for r in got) and len(got) == 2
