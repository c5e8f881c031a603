"""The audit of one stored strategy: stress grid, folds and regimes as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import EvalConfig
from barloom.operators import backtest, regime, signal, validate


def audit(bars: DataFrame, genome: dict, cfg: EvalConfig, bar_seconds: int, cost_mults=(1.0, 2.0, 3.0, 5.0), delays=(0, 1)) -> dict[str, DataFrame]:
    """stress, active, walkforward, cv_folds, cv_summary, regimes and regime_summary; one feature pass serves all."""
    spark = bars.sparkSession
    genomes = spark.createDataFrame([(0, genome)], f"genome_id long, genome {signal.GENOME}")
    pos = signal.positions(bars, genomes, signal.needed([genome])).persist()
    sizes = validate.series_sizes(bars)
    holdout = max(0.05, cfg.holdout_frac)
    split = validate.train_holdout(sizes, holdout)
    rows = backtest.pnl(backtest.sliced(pos, split), cfg.costs)
    folds, errors = validate.cv_folds(pos, sizes, genomes, cfg, bar_seconds)
    by = regime.attribution(rows, regime.labels(bars, cfg.regime_vol_window, cfg.regime_trend_window), bar_seconds)
    return {
        "stress": validate.stress_grid(pos, sizes, cfg.costs, bar_seconds, holdout, cost_mults, delays, cfg.mdd_floor, cfg.calmar_cap),
        "base": backtest.metrics(rows, bar_seconds, backtest.KEYS, cfg.mdd_floor, cfg.calmar_cap).join(backtest.trade_meta(rows), list(backtest.KEYS)),
        "active": backtest.active_metrics(rows, bar_seconds, 30, backtest.KEYS, cfg.mdd_floor, cfg.calmar_cap),
        "walkforward": validate.walkforward(rows.where(F.col("slice_id") == "train"), bar_seconds, cfg.n_walkforward_splits),
        "cv_folds": folds,
        "cv_summary": validate.cv_summary(folds, errors),
        "regimes": by.drop("pnl_mean"),
        "regime_summary": regime.summary(by, cfg.regime_min_bars, cfg.regime_min_exposure),
    }
