"""Bar series as DataFrames: (series_id, t, ts, open, high, low, close, volume).

``t`` numbers a series' bars from 0.  Prices and volumes are FLOAT at rest and widened to DOUBLE where
they are computed with.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import finite, to_double, to_long

#: Header names of each column, in order of preference (fixed values).
ALIASES = {
    "ts": ("timestamp", "time", "date", "datetime"),
    "open": ("open",),
    "high": ("high",),
    "low": ("low",),
    "close": ("close", "adjclose", "adj_close"),
    "volume": ("volume", "vol"),
}
COLUMNS = ("open", "high", "low", "close", "volume")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with t, the row number of its series from 0."""
    w = Window.partitionBy("series_id").orderBy(*order)
    return df.withColumn("t", (F.row_number().over(w) - 1).cast("bigint"))


def filled(df: DataFrame, order: str) -> DataFrame:
    """Missing open: the close before (first: its own); high and low: of open and close; volume: 0."""
    before = F.lag("close").over(Window.partitionBy("series_id").orderBy(order))
    open_ = F.col("open") if "open" in df.columns else F.coalesce(before, F.col("close"))
    df = df.withColumn("open", open_)
    high = F.col("high") if "high" in df.columns else F.greatest("open", "close")
    low = F.col("low") if "low" in df.columns else F.least("open", "close")
    volume = F.col("volume") if "volume" in df.columns else F.lit(0.0)
    return df.withColumns({"high": high, "low": low, "volume": volume})


def events_as_ticks(events: DataFrame, series: Column | None = None) -> DataFrame:
    """One bar per event."""
    raw = events.select(
        (series if series is not None else F.lit("events")).alias("series_id"),
        F.col("ts"),
        F.col("event_id"),
        (F.lit(1000.0) + F.col("value") / 10.0).cast("float").alias("close"),
        F.col("user_id").cast("float").alias("volume"),
    )
    bars = numbered(raw, "ts", "event_id").drop("event_id")
    return filled(bars, "t").select("series_id", "t", "ts", *COLUMNS)


def resampled(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Bars of a fixed width from events; stretches without events have none."""
    price = (F.lit(1000.0) + F.col("value") / 10.0).cast("float")
    at = F.struct("ts", "event_id")
    raw = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("price", price)
    out = raw.groupBy(F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume")
    )
    out = out.select(F.lit("events").alias("series_id"), F.col("w")["start"].alias("ts"), *COLUMNS)
    return numbered(out, "ts").select("series_id", "t", "ts", *COLUMNS)


def resolve(header: list[str]) -> dict[str, str]:
    """Column of the file for each bar column that it has; a file without any close is refused."""
    lower = {h.strip().lower(): h for h in reversed(header)}
    found = {k: next((lower[n] for n in names if n in lower), None) for k, names in ALIASES.items()}
    if found["close"] is None:
        raise ValueError(f"no close column among {header}")
    return {k: v for k, v in found.items() if v is not None}


def read_csv(spark: SparkSession, path: str, series_id: str, lenient: bool = False) -> DataFrame:
    """A CSV file of bars, sorted by time, ties in file order.

    Missing columns are filled in file order, before rows with a missing or infinite number go.
    ``lenient``: a missing open is the row's own close.  A time is a number kept as it is, or text
    parsed to nanoseconds; rows whose time can't be read go.  Without a time column it is the ordinal.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = resolve(raw.columns)
    order = F.monotonically_increasing_id()
    cells = raw.select(order.alias("_row"), *[F.col(f"`{c}`").alias(k) for k, c in names.items()])
    cells = cells.withColumn("series_id", F.lit(series_id))
    for k in COLUMNS:
        if k in names:
            cells = cells.withColumn(k, to_double(F.col(k)))
    if lenient and "open" not in names:
        cells = cells.withColumn("open", F.col("close"))
    cells = filled(cells, "_row")
    if "ts" in names:
        parsed = F.unix_micros(F.try_to_timestamp("ts")) * 1000
        cells = cells.withColumn("ts", F.coalesce(to_long(F.col("ts")), parsed)).where(F.col("ts").isNotNull())
    else:
        cells = cells.withColumn("ts", (F.row_number().over(Window.partitionBy("series_id").orderBy("_row")) - 1).cast("bigint"))
    for k in COLUMNS:
        cells = cells.where(finite(F.col(k)))
    bars = numbered(cells, "ts", "_row")
    return bars.select("series_id", "t", "ts", *[F.col(k).cast("float").alias(k) for k in COLUMNS])


def demo(spark: SparkSession, n_bars: int = 120_000, seed: int = 7, start_ts: int = 1_600_000_000, bar_seconds: int = 900) -> DataFrame:
    """A synthetic series of four regimes (drift, volatility), the same for one seed."""
    regimes = spark.createDataFrame([(0, 0.0, 0.004), (1, 5e-5, 0.0025), (2, -3e-5, 0.0035), (3, 2e-5, 0.006)], "regime int, drift double, vol double")
    segment = max(1000, n_bars // 4)
    rows = spark.range(0, n_bars, 1, 1).select(F.col("id").alias("t"), F.least(F.floor(F.col("id") / segment), F.lit(3)).cast("int").alias("regime"), F.randn(seed).alias("e"), F.randn(seed + 1).alias("e2"), F.randn(seed + 2).alias("e3"))
    rows = rows.join(F.broadcast(regimes), "regime").withColumn("series_id", F.lit(f"demo_{n_bars}_{bar_seconds}_{seed}"))
    w = Window.partitionBy("series_id").orderBy("t")
    step = F.sum(F.col("drift") + F.col("vol") * F.col("e")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("close", F.exp(F.lit(4.605170185988092) + step))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    spread = F.abs(F.col("e2") * F.col("vol") * F.col("close") * 2.5)
    volume = F.lit(1e3) * (1 + 80 * F.col("vol")) * F.exp(0.15 * F.col("e3"))
    rows = rows.select("series_id", "t", (F.lit(start_ts) + F.col("t") * bar_seconds).alias("ts"), "open", (F.greatest("open", "close") + spread).alias("high"), (F.least("open", "close") - spread).alias("low"), "close", volume.alias("volume"))
    return rows.select("series_id", "t", "ts", *[F.col(k).cast("float").alias(k) for k in COLUMNS])


def bar_seconds(ts: DataFrame, default: int = 86400) -> DataFrame:
    """(series_id, bar_seconds) from the median step of ``ts`` (a long column), its unit guessed by size:
    above 1e12 nanoseconds, above 1e9 milliseconds, else seconds; between a second and a week."""
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy("series_id").orderBy("t"))
    per = ts.withColumn("_d", step).groupBy("series_id").agg(F.count("*").alias("n"), F.median("_d").alias("m"))
    m = F.col("m")
    seconds = F.when(m > 1e12, m / 1e9).when(m > 1e9, m / 1e3).otherwise(m)
    whole = F.greatest(F.lit(1), F.least(F.lit(7 * 86400), F.bround(seconds).cast("bigint")))
    return per.select("series_id", F.when((F.col("n") < 3) | m.isNull() | (m <= 0), F.lit(default)).otherwise(whole).cast("bigint").alias("bar_seconds"))


def fingerprint(path: str) -> str:
    """Of a file's place, size and time of change."""
    s = os.stat(path)
    return hashlib.sha256(f"{os.path.abspath(path)}|{s.st_size}|{s.st_mtime_ns}".encode()).hexdigest()[:16]


def read_json_if_exists(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached(spark: SparkSession, root: str, dataset_id: str, build, force: bool = False) -> DataFrame:
    """The stored series ``dataset_id``; where it isn't there yet, or by force, what ``build()`` makes."""
    path = f"{root}/{dataset_id}"
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepare_csv(spark: SparkSession, path: str, root: str, force: bool = False) -> tuple[str, DataFrame]:
    dataset_id = f"csv_{fingerprint(path)}"
    return dataset_id, cached(spark, root, dataset_id, lambda: read_csv(spark, path, dataset_id), force)


def prepare_demo(spark: SparkSession, root: str, n_bars: int = 120_000, bar_seconds: int = 900, seed: int = 7, force: bool = False) -> tuple[str, DataFrame]:
    dataset_id = f"demo_{n_bars}_{bar_seconds}_{seed}"
    return dataset_id, cached(spark, root, dataset_id, lambda: demo(spark, n_bars, seed, bar_seconds=bar_seconds), force)
