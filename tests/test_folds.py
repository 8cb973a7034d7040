"""Folds with memory, as-of joins and sums in parts, and definitions that golden rows fix."""

import random

import pytest
from pyspark.sql import functions as F

from tideframe.operators import asof as aj
from tideframe.operators import folds, metrics, swing

CANDIDATE = "symbol string, id long, decision_t long, exit_t long, net_r double, risk double, probability double"


def reasons(spark, rows, **options):
    df = spark.createDataFrame(rows, CANDIDATE)
    checks = {"missing_model_estimate": F.col("probability").isNull()}
    return {r["id"]: r["reason"] for r in folds.admission(df, ["symbol"], checks, **options).collect()}


def test_exposure_is_released_at_the_exit(spark):
    rows = [("BTC", 1, 1, 2, 1.0, 0.01, 0.8), ("BTC", 2, 2, 3, 1.0, 0.01, 0.8)]
    assert reasons(spark, rows, max_exposure=0.01) == {1: None, 2: None}


def test_exposure_that_is_open_or_has_no_exit_blocks(spark):
    rows = [("BTC", 1, 1, 9, 1.0, 0.01, 0.8), ("BTC", 2, 2, 3, 1.0, 0.01, None), ("BTC", 3, 3, 4, 1.0, 0.01, 0.8), ("ETH", 4, 3, None, 1.0, 0.01, 0.8), ("ETH", 5, 900, 901, 1.0, 0.01, 0.8)]
    want = {1: None, 2: "missing_model_estimate", 3: "symbol_exposure_cap", 4: None, 5: "symbol_exposure_cap"}
    assert reasons(spark, rows, max_exposure=0.01) == want


def test_cap_and_cooldown(spark):
    rows = [("B", i, i, i, r, 0.01, 1.0) for i, r in enumerate([-1.0, 1.0, 1.0, 1.0, 1.0])]
    assert reasons(spark, rows, cap=2, cooldown=2) == {0: None, 1: "cooldown", 2: "cooldown", 3: None, 4: "trade_cap"}
    assert reasons(spark, [], cap=2) == {}


def test_profit_exits_against_brute_force(spark):
    some = random.Random(4)
    for _ in range(4):
        bars, closes = [], {}
        for symbol in ("a", "b"):
            price = 100.0
            for n in range(some.choice([1, 30, 120])):
                price *= 1 + some.uniform(-0.06, 0.06)
                bars.append((symbol, n, price * (1 + some.random() / 50), price * (1 - some.random() / 50), price, some.random() < 0.4, some.random() < 0.5))
        target, cost, least, most = 0.08, 0.01, some.choice([0, 1, 3]), some.choice([2, 10])
        df = spark.createDataFrame(bars, "symbol string, n long, high double, low double, close double, fading boolean, enters boolean").orderBy(F.rand(3))
        got = {(r["symbol"], r["entry_n"]): (r["exit_n"], r["reason"], r["status"], round(r["return_share"], 12), round(r["best"], 12), round(r["worst"], 12)) for r in folds.profit_exits(df, target, cost, least, most).collect()}
        want = {}
        for symbol in ("a", "b"):
            rows = [b for b in bars if b[0] == symbol]
            for entry in rows:
                if not entry[6]:
                    continue
                at, why = rows[-1], "open_unrealized"
                for b in rows[entry[1] + 1 :]:
                    gain, held = b[4] / entry[4] - 1, b[1] - entry[1]
                    if held >= least and b[5] and gain >= target:
                        at, why = b, "profit_fade"
                        break
                    if held >= max(least, most) and b[5] and gain >= cost:
                        at, why = b, "profitable_time_fade"
                        break
                path = rows[entry[1] + 1 : at[1] + 1]
                best, worst = max([0.0] + [b[2] / entry[4] - 1 for b in path]), min([0.0] + [b[3] / entry[4] - 1 for b in path])
                want[symbol, entry[1]] = (at[1], why, "open" if why == "open_unrealized" else "closed", round(at[4] / entry[4] - 1, 12), round(best, 12), round(worst, 12))
        assert got == want


def test_swing_exit_ends_with_its_path(spark):
    """A path that is cut short is sold at its end, and so is an entry without a path."""
    bars = spark.createDataFrame([("a", n, 101.0 + n, 99.0, 100.0 + n, False) for n in range(3)], "symbol string, n long, high double, low double, close double, fading boolean")
    entries = bars.select("symbol", F.col("n").alias("entry_n"), F.col("close").alias("entry"))
    got = swing.swing_exit(entries, bars, "n", 0.5, 1, 10).orderBy("entry_n").collect()
    assert [(r["exit_n"], r["reason"]) for r in got] == [(2, "time_stop")] * 3
    assert got[2]["best"] == 0.0 and got[0]["best"] == pytest.approx(0.03) and got[0]["worst"] == pytest.approx(-0.01)


def test_asof_in_parts_is_asof(spark):
    some = random.Random(8)
    left = spark.createDataFrame([(some.choice("abc"), some.choice([None, some.randint(0, 400)]), i) for i in range(300)], "k string, t long, i long")
    right = spark.createDataFrame([(some.choice("ab"), some.choice([None, some.randint(0, 400)]), some.randint(0, 5)) for _ in range(60)], "k string, at long, v long")
    for exact in (True, False):
        for age in (None, 20):
            one = sorted(map(tuple, aj.asof(left, right, "t", "at", ["k"], ["v"], age, exact, bucket=None).collect()), key=str)
            for bucket in (7, 64, 10**6):
                assert sorted(map(tuple, aj.asof(left, right, "t", "at", ["k"], ["v"], age, exact, bucket=bucket).collect()), key=str) == one


def test_asof_has_no_window_over_a_whole_key(spark):
    left = spark.createDataFrame([("a", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 2)], "k string, at long, v long")
    plan = aj.asof(left, right, "t", "at", ["k"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_b#" in line.rsplit("], [", 2)[1] for line in windows) == 1


def test_interval_sums_against_pairs(spark):
    some = random.Random(9)
    points = [(some.choice("ab"), some.choice([None, some.randint(-50, 100)]), some.choice([None, float(some.randint(1, 9))])) for _ in range(200)]
    spans = [(some.choice("abc"), i, a, a + some.randint(0, 10)) for i in range(80) for a in [some.randint(-60, 110)]]
    left = spark.createDataFrame(spans, "k string, id long, a long, b long")
    right = spark.createDataFrame(points, "k string, t long, v double")
    for bucket in (10, 17, 1000):
        got = {r["id"]: (r["n"], r["s"]) for r in aj.interval_sums(left, right, "a", "b", "t", ["k"], "id", {"n": F.lit(1), "s": F.col("v")}, bucket).collect()}
        for k, i, a, b in spans:
            inside = [v for key, t, v in points if key == k and t is not None and a <= t <= b]
            assert got[i] == (len(inside), pytest.approx(sum(v or 0 for v in inside)))
    with pytest.raises(Exception, match="longer than a bucket"):
        aj.interval_sums(left, right, "a", "b", "t", ["k"], "id", {"n": F.lit(1)}, 3).collect()


def test_month_of_one_trade(spark):
    day = 86400
    trades = spark.createDataFrame([("b", 1, 0, 5.0), ("b", 2, 40 * day, 10.0), ("b", 3, 41 * day, -2.0)], "book string, id long, decision_t long, net_r double")
    curve = metrics.equity_curve(trades, 1000.0, 0.01, ["book"], ["decision_t", "id"])
    got = [(r["month"], round(r["month_return"], 9), round(r["gain"], 6), r["win_rate"]) for r in metrics.monthly_rollup(curve, ["book"], 1000.0).orderBy("month").collect()]
    assert got == [("1970-01", 0.05, 50.0, 1.0), ("1970-02", 0.078, 81.9, 0.5)]


def test_sortino_takes_the_deviation_of_losing_days(spark):
    days = spark.createDataFrame([("b", i, v) for i, v in enumerate([100.0, 90.0, 99.0, 79.2, 79.2])], "book string, day long, equity double")
    r = metrics.risk_adjusted(days, ["book"]).first()
    mean = (-0.1 + 0.1 - 0.2 + 0.0) / 4
    assert r["sortino"] == pytest.approx(mean / 0.05 * 365**0.5)  # of -0.1 and -0.2
    rising = metrics.risk_adjusted(days.where("day < 1 OR day = 2"), ["book"]).first()
    assert (rising["sharpe"], rising["sortino"]) == (0.0, 0.0)


def test_guard_is_shut_until_its_lookbacks_are_full(spark):
    days = spark.createDataFrame([(i, 100.0 + i, {"x": float(i), "y": float(-i)}) for i in range(12)], "day long, v double, closes map<string,double>")
    opens = lambda **k: [r["open"] for r in swing.market_guard(days, "day", "v", **k).orderBy("day").collect()]
    assert opens(lookback=5) == [False] * 5 + [True] * 7
    assert opens(recent=2, min_recent=0.0, trend=8, min_trend=0.0) == [False] * 8 + [True] * 4
    assert opens(recent=2, min_rising=0.5, closes="closes")[2:] == [True] * 10
    assert not any(opens(recent=2, min_rising=0.6, closes="closes"))
