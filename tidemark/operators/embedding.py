"""Bar windows as vectors of fixed length: channels resampled to POINTS, and scalars, of all sliding windows of a chunk at once.

A vector is nine channels, 23 scalars, three more channels, 23 more scalars: 334 numbers. LAYOUT names them in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import indexed

POINTS = 24
#: Fixed order: a stored vector may be a prefix of the whole.
CHANNELS = ("price", "returns", "volume", "range", "close_position", "body", "volatility", "drawdown", "from_low")
SCALARS = (
    "cumulative_return", "slope", "downside_vol", "upside_vol", "local_drawdown", "local_runup", "last_quarter_return", "volume_trend", "atr_pct", "trend_regime", "volatility_regime", "gap_pct",
    "breakout_strength", "breakdown_strength", "liquidity_score", "distance_sma20_atr", "long_trigger", "short_trigger", "weekly_return", "weekly_trend", "strength_first", "strength_second", "alignment",
)
MORE_CHANNELS = ("range_velocity", "pressure", "swing_state")
MORE_SCALARS = (
    "volume_early", "volume_mid", "volume_late", "volume_acceleration", "range_expansion", "valley", "peak", "flag", "impulse_corr", "hh_rate", "hl_rate", "lh_rate", "ll_rate", "swing_trend",
    "gap_up_held", "gap_down_held", "market_return", "market_breadth", "sector_strength", "industry_strength", "strength_sector", "strength_industry", "market_regime",
)
LAYOUT = [f"{c}_{i}" for c in CHANNELS for i in range(POINTS)] + list(SCALARS) + [f"{c}_{i}" for c in MORE_CHANNELS for i in range(POINTS)] + list(MORE_SCALARS)
#: Benchmark closes as of each bar: two of the market, the sector's and the industry's.
BENCHMARKS = ("bench_first", "bench_second", "bench_sector", "bench_industry")
TINY = 1e-9


def slot(name: str) -> int:
    return LAYOUT.index(name)


def _grid(size: int, points: int) -> np.ndarray:
    """Weights (size x points) that resample a row of `size` values linearly, ends on ends."""
    at = np.linspace(0, size - 1, points)
    low = np.minimum(at.astype(int), size - 2)
    out = np.zeros((size, points))
    np.add.at(out, (low, np.arange(points)), 1 - (at - low))
    np.add.at(out, (low + 1, np.arange(points)), at - low)
    return out


def _slope(y: np.ndarray) -> np.ndarray:
    """Least-squares slope of each row over -1 to 1."""
    x = np.linspace(-1, 1, y.shape[1])
    return y @ x / (x @ x)


def _standard(y: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and deviation 1; rows without spread are 0."""
    spread = y.std(axis=1, keepdims=True)
    return np.where(spread > 0, (y - y.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1), 0.0)


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of rows; 0 without spread."""
    return np.mean(_standard(a) * _standard(np.broadcast_to(b, a.shape)), axis=1)


def _trailing_std(r: np.ndarray, size: int = 5) -> np.ndarray:
    """Sample deviation of the last `size` values up to each, of at least two; else 0."""
    out = np.zeros_like(r)
    for j in range(1, r.shape[1]):
        out[:, j] = r[:, max(0, j - size + 1) : j + 1].std(axis=1, ddof=1)
    return out


def _swings(high: np.ndarray, low: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rates of higher and lower pivots, and the state that the last of them left, at each bar."""
    n, size = high.shape
    state, count = np.zeros((n, size)), {k: np.zeros(n) for k in ("hh", "lh", "hl", "ll")}
    last = {"h": np.full(n, np.nan), "l": np.full(n, np.nan)}
    for j in range(1, size - 1):
        for kind, x, pivot in (("h", high, (high[:, j] >= high[:, j - 1]) & (high[:, j] >= high[:, j + 1])), ("l", low, (low[:, j] <= low[:, j - 1]) & (low[:, j] <= low[:, j + 1]))):
            known = pivot & ~np.isnan(last[kind])
            up = known & (x[:, j] > last[kind])
            count["h" + kind] += up
            count["l" + kind] += known & ~up
            state[:, j] += np.where(up, 1.0, np.where(known, -1.0, 0.0))
            last[kind] = np.where(pivot, x[:, j], last[kind])
    for j in range(1, size):
        state[:, j] = np.where(state[:, j] == 0, state[:, j - 1], state[:, j])
    total = np.maximum(1, sum(count.values()))
    rates = {f"{k}_rate": v / total for k, v in count.items()}
    return rates | {"swing_trend": (count["hh"] + count["hl"] - count["lh"] - count["ll"]) / total}, np.clip(state, -1, 1)


def _weekly(close: np.ndarray, week: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return from the first week's close to the last's, and the slope of the weekly closes; a week without bars leaves no slope."""
    ends = np.concatenate([week[:, 1:] != week[:, :-1], np.ones((len(week), 1), bool)], axis=1)
    weeks = week[:, -1] - week[:, 0] + 1
    first = close[np.arange(len(close)), ends.argmax(axis=1)]
    scaled = close / np.maximum(first, TINY)[:, None] - 1
    x = -1 + 2 * (week - week[:, :1]) / np.maximum(weeks - 1, 1)[:, None]
    # Evenly spaced over -1 to 1, so the squares add up to m (m + 1) / (3 (m - 1)).
    squares = weeks * (weeks + 1) / (3 * np.maximum(weeks - 1, 1))
    slope = np.where((weeks >= 2) & (ends.sum(axis=1) == weeks), (scaled * x * ends).sum(axis=1) / squares, 0.0)
    return np.where(weeks >= 2, scaled[:, -1], local), slope


def _benchmark(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return over the window (0 with fewer than two values) and breadth (nan with fewer than five), of the values that are known."""
    n, size = b.shape
    known = ~np.isnan(b)
    count = known.sum(axis=1)
    rows = np.arange(n)
    first, last = b[rows, known.argmax(axis=1)], b[rows, size - 1 - known[:, ::-1].argmax(axis=1)]
    ret = np.where(count >= 2, last / np.maximum(first, TINY) - 1, 0.0)
    recent = known & (np.cumsum(known[:, ::-1], axis=1)[:, ::-1] <= 20)
    mean = np.where(recent, b, 0).sum(axis=1) / np.maximum(recent.sum(axis=1), 1)
    return ret, np.where(count >= 5, ((last >= mean) * 1.0 + (last >= first)) / 2, np.nan)


def _market(local: np.ndarray, benches: list[np.ndarray]) -> dict[str, np.ndarray]:
    (first, b1), (second, b2), (sector, _), (industry, _) = map(_benchmark, benches)
    lead = np.where(first != 0, first, second)
    used = (first != 0) * 1 + (second != 0)
    market = (first + second) / np.maximum(used, 1)
    breadths = np.stack([b1, b2])
    some = (~np.isnan(breadths)).sum(axis=0)
    breadth = np.where(some > 0, np.nansum(breadths, axis=0) / np.maximum(some, 1), 0.5)
    in_sector = np.where(sector != 0, sector, market)
    return {
        "strength_first": local - first, "strength_second": local - second, "alignment": np.where((local == 0) | (lead == 0) | (np.sign(local) == np.sign(lead)), 1.0, -1.0),
        "market_return": market, "market_breadth": breadth, "sector_strength": in_sector, "industry_strength": np.where(industry != 0, industry, in_sector),
        "strength_sector": np.where(sector != 0, local - sector, 0.0), "strength_industry": np.where(industry != 0, local - industry, 0.0),
        "market_regime": np.clip(market * 10 + (breadth - 0.5) * 1.5, -1, 1),
    }


def _triggers(close, open_, high, low, before, top, bottom, mean) -> dict[str, np.ndarray]:
    """1 for a break of the former extreme, 0.78 for a reclaim of it, 0.58 for momentum, else 0."""
    score = lambda broke, reclaimed, moving: np.where(broke, 1.0, np.where(reclaimed, 0.78, np.where(moving, 0.58, 0.0)))
    return {
        "long_trigger": score(close >= top * 0.995, (low <= top) & (close > top * 0.99) & (close > open_), (close > before) & (close > mean)),
        "short_trigger": score(close <= bottom * 1.005, (high >= bottom) & (close < bottom * 1.01) & (close < open_), (close < before) & (close < mean)),
    }


def _gaps(gap, close, open_, high, low, top, bottom) -> dict[str, np.ndarray]:
    """1 where a gap of over half a percent was tested against the former extreme, reclaimed and went on."""
    up = (gap > 0.005) & (low <= top) & (close > np.maximum(open_, top * 0.995)) & (close > open_) & (close >= low + (high - low) * 0.65)
    down = (gap < -0.005) & (high >= bottom) & (close < np.minimum(open_, bottom * 1.005)) & (close < open_) & (close <= low + (high - low) * 0.35)
    return {"gap_up_held": up * 1.0, "gap_down_held": down * 1.0}


def _atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, size: int = 14) -> np.ndarray:
    """Mean true range of `size` bars within the window; bars before have the first one's. Windows below size + 1 bars have 0."""
    if high.shape[1] <= size:
        return np.zeros_like(high)
    tr = high - low
    tr[:, 1:] = np.maximum(tr[:, 1:], np.maximum(np.abs(high[:, 1:] - close[:, :-1]), np.abs(low[:, 1:] - close[:, :-1])))
    means = sliding_window_view(tr, size, axis=1).mean(axis=2)
    return np.concatenate([np.repeat(means[:, :1], size - 1, axis=1), means], axis=1)


def embed(open_, high, low, close, volume, week, benches) -> np.ndarray:
    """Vectors (n x 334) of n windows, each a row of the matrices (n x size, at least 5 bars). benches: four such matrices, nan where unknown."""
    n, size = close.shape
    safe = np.maximum(close, TINY)
    returns = np.zeros_like(close)
    returns[:, 1:] = np.diff(np.log(safe), axis=1)
    returns = np.clip(returns, *np.quantile(returns, (0.01, 0.99), axis=1)[:, :, None])
    local = close[:, -1] / close[:, 0] - 1
    price = close / np.maximum(close[:, :1], TINY) - 1
    rel = np.clip(volume / np.maximum(np.median(volume, axis=1, keepdims=True), 1), 0, 5) / 5
    span = np.maximum(high - low, TINY)
    spread = np.clip((high - low) / safe, 0, 0.35) / 0.35
    vol = _trailing_std(returns)
    vol = np.minimum(vol, np.quantile(vol, 0.95, axis=1, keepdims=True) + TINY)
    vol /= np.where(vol.max(axis=1, keepdims=True) > 0, vol.max(axis=1, keepdims=True), 1)
    top_so_far = np.maximum.accumulate(close, axis=1)
    down = (close - top_so_far) / np.maximum(top_so_far, TINY)
    up = close / np.maximum(np.minimum.accumulate(close, axis=1), TINY) - 1

    c, o, h, lo = close[:, -1], open_[:, -1], high[:, -1], low[:, -1]
    before = close[:, -2]
    look = min(20, max(2, size - 1))
    top, bottom = high[:, -look - 1 : -1].max(axis=1), low[:, -look - 1 : -1].min(axis=1)
    mean20, mean50 = close[:, -20:].mean(axis=1), close[:, -50:].mean(axis=1)
    ranges = _atr(high, low, close)
    atr_pct = ranges[:, -1] / c if size >= 15 else np.zeros(n)
    usual = np.median(ranges[:, -50:] / np.maximum(close[:, -50:], TINY), axis=1)
    gap = o / np.maximum(before, TINY) - 1
    turnover = (close[:, -look:] * volume[:, -look:]).mean(axis=1)
    states, swing = _swings(high, low)
    weekly_return, weekly_trend = _weekly(close, week, c / np.maximum(close[:, 0], TINY) - 1)
    thirds = [slice(0, (size + 2) // 3), slice((size + 2) // 3, (2 * size + 2) // 3), slice((2 * size + 2) // 3, size)]
    early, mid, late = (rel[:, t].mean(axis=1) for t in thirds)
    price16, rel16 = (_standard(x @ _grid(size, 16)) for x in (price, rel))
    x16 = np.linspace(-1, 1, 16)
    flag = np.concatenate([np.linspace(0, 1, 6), np.linspace(0.65, 0.45, 5), np.linspace(0.45, 1.15, 5)])
    found = {
        "cumulative_return": local, "slope": _slope(price), "downside_vol": np.minimum(returns, 0).std(axis=1), "upside_vol": np.maximum(returns, 0).std(axis=1), "local_drawdown": -down.min(axis=1), "local_runup": up.max(axis=1),
        "last_quarter_return": c / close[:, size * 3 // 4] - 1, "volume_trend": _slope(rel), "atr_pct": atr_pct, "trend_regime": np.where((c >= mean20) & (mean20 >= mean50), 1.0, np.where((c <= mean20) & (mean20 <= mean50), -1.0, 0.0)),
        "volatility_regime": np.minimum(np.where(usual > 0, atr_pct / np.maximum(usual, TINY), 1.0), 5.0), "gap_pct": gap, "breakout_strength": c / np.maximum(top, TINY) - 1, "breakdown_strength": bottom / np.maximum(c, TINY) - 1,
        "liquidity_score": np.minimum(1.0, np.log1p(np.maximum(turnover, 0)) / np.log1p(50_000_000.0)), "distance_sma20_atr": (c - mean20) / np.maximum(np.maximum(ranges[:, -1], c * 0.01), TINY),
        "weekly_return": weekly_return, "weekly_trend": weekly_trend, "volume_early": early * 5, "volume_mid": mid * 5, "volume_late": late * 5, "volume_acceleration": late - early,
        "range_expansion": spread[:, thirds[2]].mean(axis=1) - spread[:, thirds[0]].mean(axis=1), "valley": np.maximum(0, _corr(price16, -np.abs(x16))), "peak": np.maximum(0, _corr(price16, np.abs(x16))),
        "flag": np.maximum(0, _corr(price16, flag)), "impulse_corr": _corr(np.diff(price16, axis=1, prepend=price16[:, :1]), rel16),
    } | states | _triggers(c, o, h, lo, before, top, bottom, mean20) | _gaps(gap, c, o, h, lo, top, bottom) | _market(c / np.maximum(close[:, 0], TINY) - 1, benches)
    channels = {
        "price": price, "returns": returns, "volume": rel, "range": spread, "close_position": np.clip((close - low) / span, 0, 1), "body": np.clip(np.abs(close - open_) / span, 0, 1), "volatility": vol, "drawdown": down, "from_low": up,
        "range_velocity": np.diff(spread, axis=1, prepend=spread[:, :1]), "pressure": np.sign(returns) * rel, "swing_state": swing,
    }
    grid = _grid(size, POINTS) if size != POINTS else np.eye(size)
    blocks = [channels[x] @ grid if x in channels else found[x][:, None] for x in (*CHANNELS, *SCALARS, *MORE_CHANNELS, *MORE_SCALARS)]
    return np.nan_to_num(np.concatenate(blocks, axis=1), nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


def embed_windows(bars: DataFrame, sizes: list[int], key: str = "symbol", order: str = "date", chunk: int = 2048, part: int = 512) -> DataFrame:
    """(key, order, size, vector) of every window of each size, by its last bar.

    bars: open, high, low, close, volume and, where known, the BENCHMARKS columns. Bars with a null among the first five or in key or
    order take no part; a key's bars must have an order each of their own. A key's series is cut into chunks of bars, each with the
    bars before it that its windows need, so no task holds a series; `part` windows are worked on at once.
    """
    if min(sizes) < 5 or max(sizes) > chunk:
        raise ValueError(f"sizes must be from 5 to {chunk}")
    prices = ["open", "high", "low", "close", "volume"]
    week = F.floor((F.datediff(F.to_date(order), F.lit("1970-01-01").cast("date")) + 3) / 7)
    benches = [(F.col(b) if b in bars.columns else F.lit(None)).cast("double").alias(b) for b in BENCHMARKS]
    known = bars.dropna(subset=[key, order, *prices]).select(key, order, *[F.col(p).cast("double").alias(p) for p in prices], week.alias("_week"), *benches).withColumn("_day", F.to_date(order))
    placed = indexed(known, [key], "_day", [order], "_at").drop("_day", "_at_of")
    own = F.floor(F.col("_at") / chunk)
    homes = F.when(F.col("_at") % chunk > chunk - max(sizes), F.array(own, own + 1)).otherwise(F.array(own))
    kinds = dict(bars.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        at, chunk_no = table["_at"].to_numpy(), table["_chunk"][0].as_py()
        o, h, lo, c, v, w, *b = (table[x].to_numpy().astype(float) for x in (*prices, "_week", *BENCHMARKS))
        out = []
        for size in sizes:
            # The windows that end at this chunk's own bars; `at` has no holes.
            first = max(size - 1, int(np.searchsorted(at, chunk_no * chunk)))
            for begin in range(first, len(at), part):
                ends = np.arange(begin, min(begin + part, len(at)))
                cut = lambda x, ends=ends, size=size: sliding_window_view(x[ends[0] - size + 1 : ends[-1] + 1], size)
                vectors = embed(*map(cut, (o, h, lo, c, v, w)), [cut(x) for x in b])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1) * len(LAYOUT), pa.int32()), pa.array(vectors.ravel(), pa.float32()))
                out.append(pa.table([*(table[x].combine_chunks().take(pa.array(ends)) for x in (key, order)), pa.array(np.full(len(ends), size), pa.int32()), lists], names=[key, order, "size", "vector"]))
        types = pa.schema([table.schema.field(key), table.schema.field(order), ("size", pa.int32()), ("vector", pa.list_(pa.float32()))])
        return pa.concat_tables(out) if out else types.empty_table()

    dealt = placed.select(key, order, *prices, "_week", *BENCHMARKS, "_at", F.explode(homes).alias("_chunk"))
    return dealt.groupBy(key, "_chunk").applyInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, size int, vector array<float>")
