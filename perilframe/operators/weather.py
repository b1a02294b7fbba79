"""Daily weather: pivot, units, wind rose, fire weather index."""

from __future__ import annotations

import math

from collections.abc import Iterator
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilframe.operators.quantiles import exact_percentiles

KINDS = ["TMAX", "TMIN", "AWND", "WSF2", "WDF2", "PRCP"]


def pivot_daily(records: DataFrame) -> DataFrame:
    """A row for each station and date, a column for each kind: its first value. Dates that don't parse go."""
    dated = records.withColumn("date", F.try_to_date(F.col("date").cast("string"))).where("date is not null")
    return dated.groupBy("station", "date").pivot("datatype", KINDS).agg(F.min_by("value", "seq"))


def unit_convert(daily: DataFrame) -> DataFrame:
    """Tenths of C to F, tenths of m/s to mph, tenths of mm to inches."""
    f = lambda c: F.col(c) / 10 * 9 / 5 + 32
    return daily.select("station", "date", f("TMAX").alias("temp_f"), f("TMIN").alias("temp_min_f"), (F.col("AWND") / 10 * 2.23694).alias("wind_speed_mph"), (F.col("WSF2") / 10 * 2.23694).alias("wind_gust_mph"), F.col("WDF2").alias("wind_dir_deg"), (F.col("PRCP") / 10 / 25.4).alias("precip_in"))


def estimate_rh(tmax_c: Column, tmin_c: Column) -> Column:
    """Relative humidity with the low as dew point (Magnus)."""
    e = lambda t: F.exp(17.625 * t / (243.04 + t))
    return F.least(F.greatest(100 * e(tmin_c) / e(tmax_c), F.lit(0.0)), F.lit(100.0))


def fire_weather_filter(df: DataFrame, rh: float = 40.0, wind: float = 8.0, temp: float = 85.0) -> DataFrame:
    """Hot, dry, windy days; a test counts only if its column is there."""
    for name, test in (("rh_pct", F.col("rh_pct") <= rh), ("wind_speed_mph", F.col("wind_speed_mph") >= wind), ("temp_f", F.col("temp_f") >= temp)):
        if name in df.columns:
            df = df.where(test)
    return df


def wind_sector(direction: Column, sectors: int = 16) -> Column:
    width = 360.0 / sectors
    return F.floor(F.pmod(direction + width / 2, F.lit(360.0)) / width).cast("int")


def wind_rose(df: DataFrame, sectors: int = 16) -> DataFrame:
    """Share and speed quantiles of each sector; sectors without wind are 0."""
    known = df.where("wind_dir_deg is not null and wind_speed_mph is not null").withColumn("sector", wind_sector(F.col("wind_dir_deg"), sectors))
    quantiles = exact_percentiles(known, "wind_speed_mph", {"p90": 0.9, "p95": 0.95, "p99": 0.99}, ("sector",))
    each = known.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).join(quantiles, "sector", "left")
    total = known.agg(F.count(F.lit(1)).alias("total"))
    every = df.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    out = every.join(F.broadcast(each), "sector", "left").crossJoin(F.broadcast(total))  # at most one row a sector
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("sector", (F.col("sector") * 360.0 / sectors).alias("center_deg"), zero(F.col("n") / F.col("total")).alias("frequency"), *(zero(F.col(n)).alias(n) for n in ("p90", "p95", "p99")))


def dominant_direction(df: DataFrame) -> DataFrame:
    """The most frequent direction, the smallest of ties."""
    counts = df.where("wind_dir_deg is not null").groupBy("wind_dir_deg").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max(F.struct("n", -F.col("wind_dir_deg"))).alias("m")).select((-F.col("m.col2")).alias("dominant_deg"), F.col("m.n").alias("n"))


def daily_to_metric(df: DataFrame) -> DataFrame:
    return df.select("station", "date", ((F.col("temp_f") - 32) * 5 / 9).alias("temp_c"), F.coalesce("rh_pct", F.lit(50.0)).alias("rh_pct"), (F.coalesce("wind_speed_mph", F.lit(0.0)) * 1.60934).alias("wind_kmh"), (F.coalesce("precip_in", F.lit(0.0)) * 25.4).alias("precip_mm")).dropna()


def moisture_from_1hr(df: DataFrame) -> DataFrame:
    return df.withColumns({"m10": F.col("m1") * 1.3, "m100": F.lit(0.10), "m_lh": F.lit(0.80), "m_lw": F.lit(1.00)})


# --- the fire weather index: three codes are carried from day to day ------------------------


def _drivers(day: pd.DataFrame) -> dict[str, np.ndarray]:
    """What the weather of each day alone decides: equilibria and speeds of drying, rain that counts, gains."""
    t, h, w, r = (day[c].to_numpy(np.float64) for c in ("temp_c", "rh_pct", "wind_kmh", "precip_mm"))
    steep, warm = np.exp((h - 100) / 10), 0.18 * (21.1 - t) * (1 - np.exp(-0.115 * h))
    left = lambda x: 10 ** -((0.424 * (1 - x**1.7) + 0.0694 * np.sqrt(w) * (1 - x**8)) * 0.581 * np.exp(0.0365 * t))
    wet = np.where(r > 0.5, r - 0.5, 0.0)  # no record of rain is no rain
    return {
        "dry_to": 0.942 * h**0.679 + 11 * steep + warm, "dry_left": left(h / 100),
        "wet_to": 0.618 * h**0.753 + 10 * steep + warm, "wet_left": left((100 - h) / 100),
        "soak": 42.5 * wet * (1 - np.exp(-6.93 / np.where(wet > 0, wet, 1.0))),
        "duff_gain": 1.894e-4 * (t + 1.1) * (100 - h), "duff_rain": np.where(r > 1.5, 0.92 * r - 1.27, 0.0),
        "deep_gain": 0.5 * np.maximum(-1.6, 0.36 * (t + 2.8) + 0.5), "deep_rain": np.where(r > 2.8, 3.937 * (0.83 * r - 1.27), 0.0),
    }


#: Effective day length by day of the year, from 0.
_DAY_LENGTH = np.maximum(9.0, 11.5 + 4.5 * np.sin((np.arange(365) - 14) * 2 * np.pi / 365)).tolist()


def _carried(codes: tuple[float, float, float], length: float, dry_to: float, dry_left: float, wet_to: float, wet_left: float, soak: float, duff_gain: float, duff_rain: float, deep_gain: float, deep_rain: float) -> tuple[float, float, float]:
    """The three codes a day later."""
    fine, duff, deep = codes
    m = 147.2 * (101 - fine) / (59.5 + fine)
    if soak:
        m = min(250.0, m + soak * exp(-100 / (251 - m)))
    if m > dry_to:
        m = dry_to + (m - dry_to) * dry_left
    elif m < wet_to:
        m = wet_to - (wet_to - m) * wet_left
    gain = max(0.0, duff_gain * length)
    if duff_rain:
        slope = 65.91 + 11.2 * log(20 + exp(5.6348 - duff / 43.43)) if duff <= 65 else 200 / (0.999 + 0.23 * log(duff))
        over = exp(5.6348 - duff / 43.43) + 1000 * duff_rain / (48.77 + slope * duff_rain)
        duff = max(0.0, (244.72 - 43.43 * log(over) if over > 0 else 0.0) + gain)
    else:
        duff += gain
    if deep_rain:
        q = 800 * exp(-deep / 400) + deep_rain
        deep = 400 * log(800 / q) if q > 0 else 0.0
    return 59.5 * (250 - m) / (147.2 + m), duff, deep + deep_gain


def fire_weather_index(daily: DataFrame, start: tuple[float, float, float] = (85.0, 6.0, 15.0)) -> DataFrame:
    """FFMC, DMC and DC by a fold over each station's days in order of day_no, the other codes from them.

    The rows of a station arrive sorted and in batches, so that one station may be of any size. All that a
    day's weather alone decides is computed for a batch at once; the fold holds three numbers.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        station, state, i = object(), start, 0
        for frame in frames:
            out = []
            for now, *drivers in zip(frame["station"].tolist(), *(x.tolist() for x in _drivers(frame).values())):
                if now != station:
                    station, state, i = now, start, 0
                state = _carried(state, _DAY_LENGTH[i % 365], *drivers)
                i += 1
                out.append(state)
            codes = np.array(out, np.float64).reshape(-1, 3)
            yield frame[["station", "day_no", "wind_kmh"]].assign(ffmc=codes[:, 0], dmc=codes[:, 1], dc=codes[:, 2])

    ordered = daily.select("station", "day_no", "temp_c", "rh_pct", "wind_kmh", "precip_mm").repartition("station").sortWithinPartitions("station", "day_no")
    kinds = dict(daily.dtypes)
    codes = ordered.mapInPandas(fold, f"station {kinds['station']}, day_no {kinds['day_no']}, wind_kmh double, ffmc double, dmc double, dc double")
    return codes.withColumn("isi", isi(F.col("ffmc"), F.col("wind_kmh"))).withColumn("bui", bui(F.col("dmc"), F.col("dc"))).withColumn("fwi", fwi(F.col("isi"), F.col("bui"))).drop("wind_kmh")


def isi(ffmc: Column, wind: Column) -> Column:
    m = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    return 0.208 * F.exp(0.05039 * wind) * 91.9 * F.exp(-0.1386 * m) * (1 + F.pow(m, F.lit(5.31)) / 4.93e7)


def bui(dmc: Column, dc: Column) -> Column:
    return F.when(dmc > 0, 0.8 * dmc * dc / (dmc + 0.4 * dc)).otherwise(0.0)


def fwi(isi_: Column, bui_: Column) -> Column:
    b = 0.1 * isi_ * F.when(bui_ <= 80, 0.626 * F.pow(bui_, F.lit(0.809)) + 2).otherwise(1000 / (25 + 108.64 * F.exp(-0.023 * bui_)))
    return F.when(b > 1, F.exp(2.72 * F.pow(0.434 * F.ln(F.greatest(b, F.lit(1.0))), F.lit(0.647)))).otherwise(b)


def uniform(seed: int, stream: str, *key: Column) -> Column:
    """A draw between 0 and 1 for each key, by the md5 of seed, key and stream: the same in every plan, run and engine."""
    said = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key), F.lit(stream))
    return (F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long") + 0.5) / 2.0**48


def normal(seed: int, stream: str, *key: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, stream, *key))) * F.cos(2 * math.pi * uniform(seed, f"{stream}'", *key))


def exponential(seed: int, stream: str, *key: Column) -> Column:
    return -F.ln(1 - uniform(seed, stream, *key))


def climatology(spans: DataFrame, climate: DataFrame, seed: int = 42) -> DataFrame:
    """A daily series for each of spans (station, start, end), from monthly normals with noise, for places without records.

    Highest and lowest temperature vary by 5 degrees about the month's; rain is exponential about a thirtieth of the
    month's, wind the sum of two exponentials of 4, its direction one of three; humidity follows from the temperatures.
    Draws go by station and day, so that a day is the same whatever span it is asked in.
    """
    days = spans.select("station", F.explode(F.sequence("start", "end")).alias("date")).withColumn("month", F.month("date"))
    key = (F.col("station"), F.date_format("date", "yyyy-MM-dd"))
    wind = (exponential(seed, "wind 1", *key) + exponential(seed, "wind 2", *key)) * 4
    heading = F.element_at(F.array(F.lit(180.0), F.lit(225.0), F.lit(270.0)), F.floor(uniform(seed, "direction", *key) * 3).cast("int") + 1)
    out = days.join(F.broadcast(climate), "month").withColumns({
        "temp_f": F.col("tmax_f") + 5 * normal(seed, "high", *key), "temp_min_f": F.col("tmin_f") + 5 * normal(seed, "low", *key), "wind_speed_mph": wind,
        "wind_dir_deg": heading, "precip_in": exponential(seed, "rain", *key) * F.col("precip_in") / 30,
    })
    c = lambda x: (F.col(x) - 32) * 5 / 9
    held = lambda t: F.exp(17.27 * t / (t + 237.3))  # noqa: E731  water that air of so many degrees holds, with the low as dew point
    humidity = F.least(F.greatest(100 * held(c("temp_min_f")) / held(c("temp_f")), F.lit(20.0)), F.lit(95.0))
    return out.withColumn("rh_pct", humidity).select("station", "date", "temp_f", "temp_min_f", "rh_pct", "wind_speed_mph", "wind_dir_deg", "precip_in")
