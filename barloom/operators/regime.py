"""Regimes: tertiles of volatility by tertiles of trend, and the attribution of pnl to the nine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import annual_factor
from barloom.operators.features import column, features, quantiles

MIN_FINITE = 200


def tertile(x: Column, n: Column, q: Column) -> Column:
    """0, 1 or 2 by the quantiles q; null for a null value, or with fewer than 200 of them."""
    return F.when((n >= MIN_FINITE) & x.isNotNull(), F.when(x <= q[0], 0).when(x <= q[1], 1).otherwise(2))


def labels(bars: DataFrame, vol_window: int = 160, trend_window: int = 160) -> DataFrame:
    """(series_id, t, vol_bin, trend_bin, regime), quantiles over the whole series; regime null if either bin is."""
    vol, trend = column("vol_s", vol_window), f"trend_{trend_window}"
    rows = features(bars.select("series_id", "t", "close", "volume"), [("vol_s", vol_window)], trends=[trend_window])
    per = quantiles(rows, {"_qv": F.col(vol), "_qt": F.col(trend)}, [1 / 3, 2 / 3]).withColumnsRenamed({"n__qv": "_nv", "n__qt": "_nt"})
    rows = rows.join(F.broadcast(per), "series_id", "left")
    rows = rows.withColumns({"vol_bin": tertile(F.col(vol), F.col("_nv"), F.col("_qv")), "trend_bin": tertile(F.col(trend), F.col("_nt"), F.col("_qt"))})
    return rows.select("series_id", "t", "vol_bin", "trend_bin", (F.col("vol_bin") * 3 + F.col("trend_bin")).cast("byte").alias("regime"))


def attribution(pnl: DataFrame, regimes: DataFrame, bar_seconds: int) -> DataFrame:
    """Nine rows per (series_id, genome_id): bars, active_bars, exposure, pnl_sum, pnl_mean and sharpe."""
    root = annual_factor(bar_seconds) ** 0.5
    rows = pnl.where(F.col("pnl").isNotNull()).join(regimes.select("series_id", "t", "regime"), ["series_id", "t"]).where(F.col("regime").isNotNull())
    per = rows.groupBy("series_id", "genome_id", F.col("regime").cast("int").alias("rid")).agg(
        F.count("*").alias("bars"), F.sum((F.col("pos") != 0).cast("long")).alias("active_bars"), F.sum("pnl").alias("pnl_sum"), F.avg("pnl").alias("pnl_mean"), F.stddev_pop("pnl").alias("_sd")
    )
    spine = pnl.select("series_id", "genome_id").distinct().withColumn("rid", F.explode(F.array(*[F.lit(i) for i in range(9)])))
    out = spine.join(per, ["series_id", "genome_id", "rid"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sharpe = F.when(F.col("_sd") > 1e-12, F.col("pnl_mean") / F.col("_sd") * root).otherwise(F.lit(0.0))
    return out.select(
        "series_id", "genome_id", "rid", F.floor(F.col("rid") / 3).cast("int").alias("vol_bin"), (F.col("rid") % 3).alias("trend_bin"), zero("bars").alias("bars"), zero("active_bars").alias("active_bars"),
        F.when(zero("bars") > 0, F.col("active_bars") / F.col("bars")).otherwise(F.lit(0.0)).alias("exposure"), F.coalesce("pnl_sum", F.lit(0.0)).alias("pnl_sum"), F.coalesce("pnl_mean", F.lit(0.0)).alias("pnl_mean"), sharpe.alias("sharpe"),
    )


def summary(rows: DataFrame, min_bars: int = 600, min_exposure: float = 0.03) -> DataFrame:
    """Per genome: coverage and worst sharpe of the regimes with enough bars and exposure, and dominance of gains."""
    counts = (F.col("bars") >= min_bars) & (F.col("exposure") >= min_exposure)
    gain = F.greatest(F.lit(0.0), F.col("pnl_sum"))
    return rows.groupBy("series_id", "genome_id").agg(
        F.sum(counts.cast("long")).alias("coverage"), F.coalesce(F.min(F.when(counts, F.col("sharpe"))), F.lit(0.0)).alias("worst_sharpe"),
        F.when(F.sum(gain) > 1e-12, F.max(gain) / F.sum(gain)).otherwise(F.lit(0.0)).alias("dominance"),
    )
