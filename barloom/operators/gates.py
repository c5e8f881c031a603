"""The ordered chain of gates, scores, and the two-pass evaluation of a generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import EvalConfig
from barloom.functions.scalar import finite
from barloom.operators import backtest, regime, signal, validate


def c(name: str) -> Column:
    return F.col(name)


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that holds; null if none does."""
    out = F.when(F.coalesce(checks[0][1], F.lit(False)), F.lit(checks[0][0]))
    for name, bad in checks[1:]:
        out = out.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    return out


def stage1_checks(cfg: EvalConfig) -> list[tuple[str, Column]]:
    """In order; the columns are those of ``stage1``."""
    return [
        ("batch_train_too_short", c("n_train") < cfg.min_train_bars),
        ("batch_holdout_too_short", c("n_holdout") < cfg.min_holdout_bars),
        ("fail_type", c("type") != signal.TYPE),
        ("fail_train_metrics_error", c("train_error").isNotNull()),
        ("fail_train_exposure", c("train_exposure") < cfg.min_exposure_train),
        ("fail_train_active_bars", c("train_active_bars") < cfg.min_active_bars_train),
        ("fail_train_trades", c("train_trades") < cfg.min_trades_train),
        ("fail_train_turnover", c("train_turnover_mean") > cfg.max_turnover_mean_train),
        ("fail_train_mdd", F.abs(c("train_max_drawdown")) > cfg.max_drawdown_abs_train),
        ("fail_train_sharpe", c("train_sharpe") < cfg.min_train_sharpe),
        ("fail_train_wf_error", c("wf_usable") == 0),
        ("fail_train_wf_pos_segments", c("wf_positive_segments") < cfg.min_wf_positive_segments),
        ("fail_train_wf_dominance", F.abs(c("wf_dominance")) > cfg.max_wf_dominance),
        ("fail_holdout_metrics_error", c("holdout_error").isNotNull()),
        ("fail_holdout_exposure", c("holdout_exposure") < cfg.min_exposure_holdout),
        ("fail_holdout_active_bars", c("holdout_active_bars") < cfg.min_active_bars_holdout),
        ("fail_holdout_trades", c("holdout_trades") < cfg.min_trades_holdout),
        ("fail_holdout_turnover", c("holdout_turnover_mean") > cfg.max_turnover_mean_holdout),
        ("fail_holdout_mdd", F.abs(c("holdout_max_drawdown")) > cfg.max_drawdown_abs_holdout),
        ("fail_holdout_sharpe", c("holdout_sharpe") < cfg.min_holdout_sharpe),
        ("fail_holdout_stress_metrics_error", c("stress_error").isNotNull()),
        ("fail_holdout_stress_sharpe", c("stress_sharpe") < cfg.min_holdout_stress_sharpe),
    ]


#: The checks whose failures are near misses and may join the elite.
NEAR_MISS = ("fail_holdout_sharpe", "fail_holdout_stress_metrics_error", "fail_holdout_stress_sharpe")


def _least_positive(frac: float, count: int) -> Column:
    if count > 0:
        return F.lit(count)
    return F.greatest(F.lit(1), F.least(c("cv_folds"), F.ceil(c("cv_folds") * frac - 1e-12)))


def stage2_checks(cfg: EvalConfig) -> list[tuple[str, Column]]:
    return [
        ("fail_cv_pos_folds", c("cv_positive_folds") < _least_positive(cfg.cv_min_positive_folds_frac, cfg.cv_min_positive_folds)),
        ("fail_cv_min_sharpe", c("cv_min_sharpe") < cfg.cv_min_sharpe),
        ("fail_cv_med_sharpe", c("cv_median_sharpe") < cfg.cv_min_median_sharpe_base),
        ("fail_cv_med_delay1", c("cv_median_sharpe_delay") < cfg.cv_min_median_sharpe_delay1),
        ("fail_cv_med_cost", c("cv_median_sharpe_cost") < cfg.cv_min_median_sharpe_coststress),
        ("fail_cv_min_delay1", c("cv_min_sharpe_delay") < cfg.cv_min_sharpe_delay1),
        ("fail_cv_min_cost", c("cv_min_sharpe_cost") < cfg.cv_min_sharpe_coststress),
        ("fail_cv_pos_cost_folds", c("cv_positive_folds_cost") < _least_positive(cfg.cv_min_positive_folds_coststress_frac, cfg.cv_min_positive_folds_coststress)),
    ]


def soft_score() -> Column:
    """Of near misses, from stage 1 alone."""
    gap = F.greatest(F.lit(0.0), c("train_sharpe") - c("holdout_sharpe"))
    return (
        0.55 * c("holdout_sharpe") + 0.25 * c("train_sharpe") + 0.10 * F.coalesce("stress_sharpe", "holdout_sharpe")
        - 0.20 * gap - 0.15 * F.abs(c("holdout_max_drawdown")) - 0.05 * c("holdout_turnover_mean") - 0.10 * F.greatest(F.lit(0.0), F.abs(c("wf_dominance")) - 0.65)
    )


def fallback_score() -> Column:
    return 0.55 * c("holdout_sharpe") + 0.25 * c("train_sharpe")


def full_score(with_regime: bool = True) -> Column:
    gap = F.greatest(F.lit(0.0), c("train_sharpe") - c("holdout_sharpe"))
    gain = 0.55 * c("cv_median_sharpe") + 0.22 * c("cv_min_sharpe") + 0.10 * c("cv_median_sharpe_delay") + 0.08 * c("cv_median_sharpe_cost") + 0.05 * c("stress_sharpe") + 0.04 * c("holdout_sharpe")
    gain = gain * (0.85 + 0.15 * c("cv_positive_folds") / c("cv_folds"))
    loss = 0.22 * c("cv_std_sharpe") + 0.22 * gap + 0.12 * F.abs(c("holdout_max_drawdown")) + 0.05 * c("train_turnover_mean") + 0.12 * F.greatest(F.lit(0.0), F.abs(c("wf_dominance")) - 0.60)
    if not with_regime:
        return gain - loss
    by_regime = 0.10 * c("regime_coverage") / 9.0 - 0.25 * F.greatest(F.lit(0.0), c("regime_dominance") - 0.55) - 0.08 * F.greatest(F.lit(0.0), -c("regime_worst_sharpe") - 0.20)
    return gain - loss + F.coalesce(by_regime, F.lit(0.0))


def stage1(pos: DataFrame, sizes: DataFrame, genomes: DataFrame, cfg: EvalConfig, bar_seconds: int) -> DataFrame:
    """One row per (series_id, genome_id): metrics of train, holdout and stressed holdout, walk-forward, reject_reason."""
    frac, mult = cfg.holdout_frac, float(cfg.stress_cost_mult)
    slices = validate.train_holdout(sizes, frac).unionByName(validate.train_holdout(sizes, frac, 0, mult, "stress_").where(c("slice_id") == "stress_holdout"))
    rows = backtest.pnl(backtest.sliced(pos, slices), cfg.costs)
    m = backtest.metrics(rows, bar_seconds, backtest.KEYS, cfg.mdd_floor, cfg.calmar_cap)
    meta = backtest.trade_meta(rows)
    both = m.join(meta, list(backtest.KEYS))
    names = {"train": "train", "holdout": "holdout", "stress_holdout": "stress"}
    fields = ("error", "bars", "sharpe", "total_return", "cagr", "calmar", "max_drawdown", "trades", "turnover_mean", "turnover_sum", "exposure", "active_bars")
    wide = both.groupBy("series_id", "genome_id").agg(*[F.max(F.when(c("slice_id") == s, c(f))).alias(f"{n}_{f}") for s, n in names.items() for f in fields])
    wf = validate.walkforward(rows.where(c("slice_id") == "train"), bar_seconds, cfg.n_walkforward_splits, backtest.KEYS, cfg.mdd_floor, cfg.calmar_cap)
    wf = wf.select("series_id", "genome_id", *[c(x).alias(f"wf_{x}") for x in ("n_segments", "positive_segments", "median_sharpe", "std_sharpe", "usable", "dominance")])
    split = validate.split_index_column(c("n"), frac)
    lengths = sizes.select("series_id", F.least(split, c("n") - 1).alias("n_train"), F.greatest(F.lit(0), c("n") - 1 - split).alias("n_holdout"))
    out = wide.join(wf, ["series_id", "genome_id"], "left").join(F.broadcast(lengths), "series_id").join(genomes.select("genome_id", c("genome.type").alias("type")), "genome_id")
    out = out.withColumn("reject_reason", first_failure(stage1_checks(cfg)))
    return out.withColumn("soft_score", F.when(c("reject_reason").isNull() | c("reject_reason").isin(*NEAR_MISS), soft_score()))


def evaluate(bars: DataFrame, genomes: DataFrame, feats: list[tuple[str, int]], cfg: EvalConfig, bar_seconds: int, materialise=None) -> DataFrame:
    """Every genome with its reject_reason (null: accepted), pass_flags and score.

    Pass one runs the cheap checks on all genomes; only survivors meet cross-validation and regimes.
    ``materialise(df, name)`` may write intermediate results and read them back.
    """
    keep = materialise or (lambda df, name: df)
    pos = keep(signal.positions(bars, genomes, feats), "positions")
    sizes = validate.series_sizes(bars)
    first = keep(stage1(pos, sizes, genomes, cfg, bar_seconds), "stage1")
    if not (cfg.deep_validation and cfg.cv_folds >= 2):
        score = F.when(c("reject_reason").isNull(), fallback_score())
        return first.withColumns({"pass_flags": F.when(c("reject_reason").isNull(), F.lit("train+wf+holdout+stress")), "score": score})
    alive = first.where(c("reject_reason").isNull()).select("series_id", "genome_id")
    chosen = pos.join(F.broadcast(alive), ["series_id", "genome_id"], "left_semi")
    folds, errors = validate.cv_folds(chosen, sizes, genomes.join(alive.select("genome_id").distinct(), "genome_id", "left_semi"), cfg, bar_seconds)
    cv = validate.cv_summary(folds, errors)
    cv = cv.select("series_id", "genome_id", *[c(x).alias(f"cv_{x}") for x in cv.columns if x not in ("series_id", "genome_id")])
    out = first.join(cv, ["series_id", "genome_id"], "left")
    later = F.when(c("cv_error").isNotNull(), F.concat(F.lit("fail_"), c("cv_error"))).otherwise(first_failure(stage2_checks(cfg)))
    out = out.withColumn("reject_reason", F.coalesce("reject_reason", F.when(c("soft_score").isNotNull(), later)))
    flags = ["train+wf+holdout+stress", "cv"]
    if cfg.regime_enabled:
        rows = backtest.pnl(backtest.sliced(chosen, validate.train_holdout(sizes, cfg.holdout_frac)), cfg.costs)
        by = regime.attribution(rows, regime.labels(bars, cfg.regime_vol_window, cfg.regime_trend_window), bar_seconds)
        per = regime.summary(by, cfg.regime_min_bars, cfg.regime_min_exposure)
        out = out.join(per.select("series_id", "genome_id", *[c(x).alias(f"regime_{x}") for x in ("coverage", "worst_sharpe", "dominance")]), ["series_id", "genome_id"], "left")
        flags.append("regime")
    accepted = c("reject_reason").isNull()
    return out.withColumns({"pass_flags": F.when(accepted, F.lit("+".join(flags))), "score": F.when(accepted, full_score(cfg.regime_enabled))})


def reject_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(c("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "reject_reason").limit(k)


def elite_updates(evaluated: DataFrame, share: float = 0.06) -> DataFrame:
    """Of each series the best near misses by soft score: 6 % of the generation, from 2 to 8."""
    near = evaluated.where(c("reject_reason").isNotNull() & finite(c("soft_score")))
    n = evaluated.groupBy("series_id").agg(F.count("*").alias("_n"))
    k = F.greatest(F.lit(2), F.least(F.lit(8), F.ceil(c("_n") * share - 1e-12)))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("soft_score"), "genome_id"))
    return near.join(F.broadcast(n), "series_id").withColumn("rank", rank).where(c("rank") <= k).drop("_n")
