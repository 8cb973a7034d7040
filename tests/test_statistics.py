"""Ranks and quantiles in parts, resampling of groups, walk-forward folds and trade resolution against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import labels, stats


def test_ranks_and_quantiles_in_parts(spark):
    some = random.Random(3)
    rows = [(some.choice(["a", "b", None]), some.choice([None, float(some.randint(0, 30)), some.random() * 30])) for _ in range(400)] + [("c", 5.0)] * 60
    df = spark.createDataFrame(rows, "k string, v double")
    for cells in (2, 9, 64):
        got = stats.with_average_rank(df, "v", ["k"], "r", cells).collect()
        assert len(got) == len(rows)
        for k in ("a", "b", "c", None):
            own = sorted((-1.0 if v is None else v) for key, v in rows if key == k)
            for r in got:
                if r["k"] == k:
                    v = -1.0 if r["v"] is None else r["v"]
                    assert r["r"] == (own.index(v) + 1 + len(own) - own[::-1].index(v)) / 2
        for q in (0.0, 0.37, 0.5, 1.0):
            there = df.where("k IS NOT NULL")
            found = {r["k"]: r["q"] for r in stats.grouped_quantile(there, ["k"], "v", q, "q", cells).collect()}
            assert found == {k: pytest.approx(np.quantile([v for key, v in rows if key == k and v is not None], q)) for k in "abc"}


def test_bootstrap_of_groups(spark):
    rows = [("long", i, float(i % 7)) for i in range(50)] + [("short", i, float(i)) for i in range(5)] + [("one", 0, 2.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {r["k"]: r for r in stats.block_bootstrap(df, "v", "t", 12, 60, 7, span=10, by=["k"]).collect()}
    assert set(got) == {"long", "short", "one"}
    assert (got["short"]["low"], got["short"]["high"]) == (0.0, 4.0)  # the range, where n <= block
    assert got["one"]["naive_t"] is None and got["one"]["low"] == got["one"]["high"] == 2.0
    values = np.array([i % 7 for i in range(50)], float)
    assert got["long"]["naive_t"] == pytest.approx(values.mean() / (values.std(ddof=1) / 50**0.5))
    import hashlib

    means = []
    for it in range(60):
        picked = []
        for j in range(5):
            at = int(hashlib.md5(f"{it * 5 + j}:7".encode()).hexdigest()[:8], 16) % 39
            picked += list(values[at : at + (2 if j == 4 else 12)])
        means.append(np.mean(picked))
    assert (got["long"]["low"], got["long"]["high"]) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    alone = stats.block_bootstrap(df.where("k = 'long'"), "v", "t", 12, 60, 7).first()
    assert alone["low"] == pytest.approx(got["long"]["low"]) and alone["n"] == 50


def test_difference_of_two_parts(spark):
    df = spark.createDataFrame([("x", i, i < 4, float(i)) for i in range(8)] + [("y", 0, True, 1.0)], "k string, t long, a boolean, v double")
    (r,) = stats.difference_interval(df, ["k"], F.col("a"), "v", "t", 10, 20, 1).collect()
    half = (1.5**2 + 1.5**2) ** 0.5  # of the ranges 0..3 and 4..7
    assert (r["k"], r["difference"], r["n"]) == ("x", -4.0, 8) and r["low"] == pytest.approx(-4 - half) and r["high"] == pytest.approx(-4 + half)


def test_walk_forward_against_numpy(spark):
    some = np.random.default_rng(5)
    n, day = 600, 86400
    t = np.sort(some.integers(0, 300 * day, n))
    a, b = some.normal(size=n), some.normal(size=n) * 3
    y = (a - 0.2 * b + some.normal(size=n) > 0).astype(int)
    end = t + some.integers(1, 5 * day, n)
    rows = [(i, int(t[i]), int(end[i]), float(a[i]), None if i % 50 == 0 else float(b[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t long, e long, a double, b double, y int")
    predictions, report = stats.walk_forward(df, ["a", "b"], "y", "t", "e", folds=5, embargo=7 * day, min_train=100, selectivity=0.3, penalty=2.0)
    got = {r["id"]: (r["fold"], r["probability"], r["selected"]) for r in predictions.collect()}
    found = {r["fold"]: r for r in report.collect()}
    use = [r for r in rows if r[4] is not None]
    low, high = t.min(), t.max()
    seen = set()
    for fold in range(5):
        start, stop = low + (high - low) * fold / 5, low + (high - low) * (fold + 1) / 5
        train = [r for r in use if r[2] < start - 7 * day]
        test = [r for r in use if start <= r[1] < stop or fold == 4 and r[1] == high]
        if len(train) < 100:
            assert fold not in found
            continue
        assert max(r[2] for r in train) < min(r[1] for r in test) - 7 * day + 1  # nothing overlaps the window
        x = np.array([r[3:5] for r in train])
        mean, dev = x.mean(0), x.std(0)
        z, target = (x - mean) / dev, np.array([r[5] for r in train], float)
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(2), z.T @ target)
        score = lambda r, w=w, mean=mean, dev=dev, target=target: 1 / (1 + np.exp(-(target.mean() + (np.array(r[3:5]) - mean) / dev @ w)))
        cut = np.quantile([score(r) for r in train], 0.7)
        for r in test:
            assert got[r[0]] == (fold, pytest.approx(score(r), abs=1e-9), score(r) >= cut)
        pairs = [(score(p), score(q)) for p in test if p[5] for q in test if not q[5]]
        assert found[fold]["auc"] == pytest.approx(np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs]), abs=1e-7)
        assert (found[fold]["train_size"], found[fold]["test_size"], found[fold]["train_end"]) == (len(train), len(test), max(r[1] for r in train))
        seen |= {r[0] for r in test}
    assert set(got) == seen and len(found) >= 3


def test_open_trades_are_resolved_with_their_path(spark):
    bars = spark.createDataFrame([("x", 60 * (i + 1), *b) for i, b in enumerate([(101.0, 99.5, 100.5), (103.5, 100.0, 103.0), (104.5, 102.0, 102.0), (102.0, 97.0, 97.5)])], "symbol string, close_t long, high double, low double, close double")
    trades = spark.createDataFrame([("x", 1, 30, "long", 100.0, 98.0, 104.0), ("x", 2, 30, "short", 100.0, 102.0, 96.0), ("x", 3, 130, "long", 102.0, 90.0, 120.0), ("y", 4, 30, "long", 1.0, 0.9, 1.2), ("x", 5, 240, "long", 1.0, 0.9, 1.2)], "symbol string, id long, t long, side string, entry double, stop_price double, target_price double")
    got = {r["id"]: r for r in labels.resolve_trades(trades, bars, 4, 0.02, 0.001).collect()}
    one = got[1]
    assert (one["status"], one["exit_reason"], one["exit_t"], one["exit_price"], one["bars_held"]) == ("closed", "target", 180, 104.0, 3)
    assert one["net_r"] == pytest.approx(2.0 - 0.05) and one["mfe_r"] == pytest.approx(2.25) and one["mae_r"] == pytest.approx(-1.5) and one["reached"] == [True] * 4
    lock = one["policies"]["breakeven_lock_0_1r_trail_1_5r_after_1r"]  # 3.5 up raises the stop to 0.25 R, which the same bar reaches
    assert (lock["exit_reason"], lock["bars_held"], lock["breakeven_bars"]) == ("dynamic_stop", 2, 2) and lock["net_r"] == pytest.approx(0.25 - 0.05)
    assert got[2]["exit_reason"] == "stop" and got[2]["exit_t"] == 120 and got[2]["gross_r"] == pytest.approx((100 / 102 - 1) / 0.02)
    assert got[3]["status"] == "open" and got[3]["policies"] is None  # two of four bars
    assert got[4]["status"] == got[5]["status"] == "open"
    short = {r["id"]: r for r in labels.resolve_trades(trades.where("id = 3"), bars, 2, 0.02, 0.001).collect()}[3]
    assert (short["exit_reason"], short["exit_price"], short["bars_held"]) == ("horizon_exit", 97.5, 2)
