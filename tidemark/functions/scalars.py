"""Scalar expressions: gaps, costs, buckets, sessions, time frames, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN becomes null, as everywhere in the engine."""
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles; a divisor of zero gives an infinity or NaN, where Spark's own division fails."""
    return F.when(b == 0, a * float("inf")).otherwise(a / b)


def gap_direction(gap: Column) -> Column:
    return F.when(gap > 0, "up").when(gap < 0, "down").otherwise("flat")


def gap_filled(direction: Column, high: Column, low: Column, previous_close: Column) -> Column:
    return F.when(direction == "up", low <= previous_close).when(direction == "down", high >= previous_close).otherwise(F.lit(False))


def gap_fill_ratio(direction: Column, open_: Column, high: Column, low: Column, previous_close: Column) -> Column:
    """How much of the gap the day gave back, 0 to 1; null without a gap."""
    back = F.when(direction == "up", (open_ - low) / (open_ - previous_close)).when(direction == "down", (high - open_) / (previous_close - open_))
    return F.when(open_ != previous_close, F.least(F.greatest(back, F.lit(0.0)), F.lit(1.0)))


def tier(x: Column, bounds: list[tuple[float, float | str]], last) -> Column:
    """The value of the first bound that x reaches; bounds fall."""
    out = F.lit(last)
    for least, value in reversed(bounds):
        out = F.when(x >= least, F.lit(value)).otherwise(out)
    return out


#: Half-spread in basis points by average dollar volume.
HALF_SPREADS = [(50e6, 3.0), (10e6, 8.0), (1e6, 20.0)]


def round_trip_cost_r(entry: Column, risk: Column, adv: Column, participation: float = 0.01, multiplier: float = 1.0, commission_bps: float = 0.5) -> Column:
    """Tiered round-trip cost as a multiple of the risk per share."""
    bps = tier(adv, HALF_SPREADS, 45.0) + 10 * participation * 100 + commission_bps
    return F.when(risk > 0, 2 * multiplier * bps / 10_000 * entry / risk)


def adv_bucket(adv: Column) -> Column:
    return tier(adv, [(50e6, "mega"), (10e6, "large"), (1e6, "mid")], "small")


def liquidity_bucket(dollar_volume: Column, spread_bps: Column, medium: float = 1e6, high: float = 5e6, tight: float = 5.0, wide: float = 25.0) -> Column:
    return F.when((dollar_volume >= high) & (spread_bps <= tight), "high").when((dollar_volume >= medium) & (spread_bps <= wide), "medium").otherwise("low")


def session_minute(ts: Column, session_open: Column) -> Column:
    """Whole minutes since the open, toward zero."""
    seconds = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(session_open.cast("timestamp"))
    return (seconds / 60_000_000).cast("long")


def day_minute(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_bucket(minute: Column, open_at: int = 570, close_at: int = 960) -> Column:
    """By minute of the local day: first half hour, midday, last hour, and outside."""
    return F.when(minute < open_at, "premarket").when(minute < open_at + 30, "open").when(minute >= close_at, "after_hours").when(minute >= close_at - 60, "power_hour").otherwise("midday")


def vwap_session_bucket(minute: Column, open_at: int = 570, close_at: int = 960) -> Column:
    """The other convention: the first and the last hour."""
    inside = (minute >= open_at) & (minute < close_at)
    return F.when(~inside, "out_of_session").when(minute < open_at + 60, "open").when(minute >= close_at - 60, "close").otherwise("mid")


def slope_direction(slope_bps: Column, flat_bps: float = 1.0) -> Column:
    return F.when(slope_bps.isNull(), "unknown").when(slope_bps > flat_bps, "up").when(slope_bps < -flat_bps, "down").otherwise("flat")


def period_months(period: Column) -> Column:
    """'2y', '6mo', '3wk', '90d' to months, rounded up; 'max' and unknown: null."""
    n = F.try_to_number(F.nullif(F.regexp_extract(period, r"^(\d+)", 1), F.lit("")), F.lit("999999")).cast("double")
    unit = F.regexp_extract(period, r"^\d+([a-z]+)$", 1)
    return F.when(unit == "y", n * 12).when(unit == "mo", n).when(unit == "wk", F.ceil(n * 7 / 30)).when(unit == "d", F.ceil(n / 30)).cast("int")


def timeframe_minutes(timeframe: Column, default: int = 5) -> Column:
    n = F.nullif(F.regexp_extract(timeframe, r"^(\d+)[mh]$", 1), F.lit("")).cast("int")
    return F.coalesce(F.when(timeframe.endswith("h"), n * 60).otherwise(n), F.lit(default))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end)."""
    days = F.datediff(end, start)
    first = F.weekday(start)
    rest = days % 7
    over = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), first + rest - 12)
    return (F.floor(days / 7) * 5 + rest - over).cast("int")


def first_positive(json: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.when(F.get_json_object(json, p).cast("double") > 0, F.get_json_object(json, p).cast("double")) for p in paths])


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-15, by West's rational approximation."""
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    top = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    low = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

    def horner(c: list[float]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + k
        return out

    tail = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
    upper = F.when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, e * horner(top) / horner(low)).otherwise(e / tail / 2.506628274631)
    return F.when(z > 0, 1 - upper).otherwise(upper)


# Coefficients of the rational approximations of the normal quantile (Wichura, Applied Statistics 241), highest power first.
_CENTRE = ("2.5090809287301226727e3 3.3430575583588128105e4 6.7265770927008700853e4 4.5921953931549871457e4 1.3731693765509461125e4 1.9715909503065514427e3 1.3314166789178437745e2 3.3871328727963666080e0",
           "5.2264952788528545610e3 2.8729085735721942674e4 3.9307895800092710610e4 2.1213794301586595867e4 5.3941960214247511077e3 6.8718700749205790830e2 4.2313330701600911252e1 1.0e0")
_TAIL = ("7.74545014278341407640e-4 2.27238449892691845833e-2 2.41780725177450611770e-1 1.27045825245236838258e0 3.64784832476320460504e0 5.76949722146069140550e0 4.63033784615654529590e0 1.42343711074968357734e0",
         "1.05075007164441684324e-9 5.47593808499534494600e-4 1.51986665636164571966e-2 1.48103976427480074590e-1 6.89767334985100004550e-1 1.67638483018380384940e0 2.05319162663775882187e0 1.0e0")
_FAR = ("2.01033439929228813265e-7 2.71155556874348757815e-5 1.24266094738807843860e-3 2.65321895265761230930e-2 2.96560571828504891230e-1 1.78482653991729133580e0 5.46378491116411436990e0 6.65790464350110377720e0",
        "2.04426310338993978564e-15 1.42151175831644588870e-7 1.84631831751005468180e-5 7.86869131145613259100e-4 1.48753612908506148525e-2 1.36929880922735805310e-1 5.99832206555887937690e-1 1.0e0")


def quantile_sql(p: str) -> str:
    """The standard normal quantile of an expression within 0 to 1, as SQL; null outside."""

    def ratio(coefficients: tuple[str, str], x: str) -> str:
        parts = []
        for text in coefficients:
            first, *rest = text.split()
            out = first
            for c in rest:
                out = f"({out} * {x} + {c})"
            parts.append(out)
        return f"{parts[0]} / {parts[1]}"

    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    tail = f"CASE WHEN {r} <= 5e0 THEN {ratio(_TAIL, f'({r} - 1.6e0)')} ELSE {ratio(_FAR, f'({r} - 5e0)')} END"
    centre = f"({p} - 5e-1) * {ratio(_CENTRE, f'(1.80625e-1 - ({p} - 5e-1) * ({p} - 5e-1))')}"
    return f"CASE WHEN {p} <= 0e0 OR {p} >= 1e0 THEN NULL WHEN abs({p} - 5e-1) <= 4.25e-1 THEN {centre} WHEN {p} < 5e-1 THEN -({tail}) ELSE {tail} END"


def normal_quantile(p: str) -> Column:
    """The standard normal quantile of a column, to about 1e-15."""
    return F.expr(quantile_sql(p))
