"""The study frame against pandas' own rolling and exponential means."""

import numpy as np
import pandas as pd

from tideframe.operators import features


def bars_of(symbol, n, seed, step=3600):
    some = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(some.normal(0, 0.01, n)))
    open_ = np.concatenate(([100.0], close[:-1]))
    volume = some.integers(0, 50, n).astype(float) * 10
    return pd.DataFrame({"symbol": symbol, "t": 1_700_000_000 // step * step + step * np.arange(n), "open": open_, "high": np.maximum(open_, close) * 1.002, "low": np.minimum(open_, close) * 0.997, "close": close, "quote_volume": volume, "taker_buy": volume * 0.3, "trades": some.integers(0, 9, n)}).assign(close_t=lambda x: x["t"] + step)


def smooth(x, alpha, n):
    return x.ewm(alpha=alpha, adjust=False, min_periods=n).mean()


def z(x, n):
    r = x.rolling(n, min_periods=n)
    return (x - r.mean()) / r.std(ddof=0).replace(0, np.nan)


def frame_of(b):
    c, h, low = b["close"], b["high"], b["low"]
    before = c.shift(1)
    tr = pd.concat([h - low, (h - before).abs(), (low - before).abs()], axis=1).max(axis=1)
    atr = smooth(tr, 1 / 20, 20)
    up, down = h.diff(), -low.diff()
    t14 = smooth(tr, 1 / 14, 14)
    plus, minus = (smooth(pd.Series(np.where((x > y) & (x > 0), x, 0.0)), 1 / 14, 14) / t14 * 100 for x, y in ((up, down), (down, up)))
    gain, loss = (smooth(x.clip(lower=0), 1 / 14, 14) for x in (c.diff(), -c.diff()))
    ema = {n: smooth(c, 2 / (n + 1), n) for n in (8, 12, 18, 20, 26, 50, 200)}
    line = ema[12] - ema[26]
    signal = smooth(line, 0.2, 9)
    mean, dev = c.rolling(20).mean(), c.rolling(20).std(ddof=0)
    top, bottom = h.rolling(20).max().shift(1), low.rolling(20).min().shift(1)
    r1, vol, trades = c.pct_change(), b["quote_volume"].replace(0, np.nan), b["trades"].replace(0, np.nan)
    rv = r1.rolling(30).std(ddof=0)
    body = (c - b["open"]).abs()
    return pd.DataFrame({"t": b["t"], "atr_pct": atr / c, "rsi": 100 - 100 / (1 + gain / loss), "adx": smooth(((plus - minus).abs() / (plus + minus) * 100).fillna(0.0), 1 / 14, 14), "ema_short_rel": ema[8] / c - 1, "ema_long_rel": ema[50] / c - 1, "ema_stack": np.sign(ema[8] - ema[18]) + np.sign(ema[50] - ema[200]), "ema_long_slope": ema[50].pct_change(5), "macd_hist_norm": (line - signal) / atr, "macd_above_signal": (line > signal).astype(float), "boll_position": (c - mean + 2 * dev) / (4 * dev), "boll_width": 4 * dev / mean, "keltner_position": (c - ema[20] + atr) / (2 * atr), "donchian_position": (c - bottom) / (top - bottom), "donchian_span_atr": (top - bottom) / atr, "return_30": c.pct_change(30), "return_6": c.pct_change(6), "realized_vol": rv, "vol_of_vol": z(rv, 60), "atr_pct_z": z(atr / c, 60), "taker_buy_share": b["taker_buy"] / vol, "volume_z": z(b["quote_volume"], 60), "trade_size_z": z(vol / trades, 60), "body_fraction": body / (h - low)})


def same(got, want, columns):
    for c in columns:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-7, atol=1e-9, err_msg=c)


def test_study_frame_in_chunks_is_that_of_pandas(spark):
    bars = [bars_of("a", 420, 1), bars_of("b", 90, 2)]
    for span in (100 * 3600, 10**9):  # chunks of 100 bars, and one
        out = features.study_frame(spark.createDataFrame(pd.concat(bars)), span=span).toPandas().sort_values(["symbol", "t"])
        assert len(out) == 510
        for b in bars:
            want = frame_of(b.reset_index(drop=True))
            same(out[out["symbol"] == b["symbol"].iloc[0]], want, [c for c in want.columns if c != "t"])


def test_context_is_that_of_closed_bars(spark):
    fine, coarse = bars_of("a", 300, 3), [bars_of("a", 80, 4, 6 * 3600), bars_of("r", 80, 5, 6 * 3600)]
    for c in coarse:
        c["t"] -= 200 * 3600
        c["close_t"] -= 200 * 3600
    out = features.study_features(spark.createDataFrame(fine), spark.createDataFrame(pd.concat(coarse)), "r").toPandas().sort_values("t")
    for c, names in ((coarse[0], {f"d1_{x}": x for x in features.CONTEXT}), (coarse[1], {f"ref_{x}": x for x in ("ema_long_rel", "realized_vol", "return_6")})):
        known = frame_of(c.reset_index(drop=True)).assign(close_t=c["close_t"].to_numpy())
        want = pd.merge_asof(fine[["close_t"]], known[["close_t", *names.values()]], on="close_t")
        same(out, want.rename(columns={v: k for k, v in names.items()}), names)
    at = pd.to_datetime(out["t"], unit="s")
    assert (out["hour_of_day"] == at.dt.hour).all() and (out["day_of_week"] == at.dt.dayofweek).all()
    inputs = {"symbol", "t", "close_t", "open", "high", "low", "close", "quote_volume", "taker_buy", "trades", "donchian_high", "donchian_low", "atr"}
    assert len(set(out.columns) - inputs) == 39
