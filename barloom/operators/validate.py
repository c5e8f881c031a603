"""Walk-forward segments, time-block cross-validation and stress grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import Costs, EvalConfig
from barloom.functions.scalar import split_index_column
from barloom.operators import backtest

CV_SCENARIOS = ("base", "delay", "cost")


def series_sizes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("series_id").agg(F.count("*").cast("bigint").alias("n"))


def train_holdout(sizes: DataFrame, holdout_frac: float, delay: int = 0, cost_mult: float = 1.0, prefix: str = "") -> DataFrame:
    """Slices train and holdout of every series; the first holdout bar is the last position of train."""
    split = split_index_column(F.col("n"), holdout_frac)
    last = F.least(split, F.col("n") - 1)
    rows = sizes.select("series_id", F.explode(F.array(
        F.struct(F.lit(prefix + "train").alias("slice_id"), F.lit(0).cast("bigint").alias("lo"), last.alias("hi"), F.lit(0).alias("delay"), F.lit(cost_mult).alias("cost_mult")),
        F.struct(F.lit(prefix + "holdout").alias("slice_id"), split.alias("lo"), (F.col("n") - 1).alias("hi"), F.lit(delay).alias("delay"), F.lit(cost_mult).alias("cost_mult")),
    )).alias("s"))
    return rows.select("series_id", "s.*")


def stress_slices(sizes: DataFrame, holdout_frac: float, cost_mults: tuple[float, ...] = (1.0, 2.0, 3.0, 5.0), delays: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Train and holdout under every cost and delay; the delay holds for the holdout only."""
    out = None
    for c in cost_mults:
        for d in delays:
            own = train_holdout(sizes, holdout_frac, d, c, f"x{c:g}_d{d}_")
            out = own if out is None else out.unionByName(own)
    return out


def walkforward(pnl: DataFrame, bar_seconds: int, splits: int = 4, keys: tuple[str, ...] = backtest.KEYS, mdd_floor: float = 0.02, calmar_cap: float = 25.0) -> DataFrame:
    """Per slice: n_segments, positive_segments, median_sharpe, std_sharpe, dominance.

    Returns are cut into equal segments, the last with the rest, or kept whole where one would have
    fewer than 200.  Dominance is the best segment's share of the sum (of a loss, the worst's).
    """
    rows = pnl.where(F.col("pnl").isNotNull())
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    k = max(1, splits)
    seg = F.floor(F.col("_n") / k)
    i = F.col("t") - F.col("lo")
    rows = rows.join(F.broadcast(n), list(keys)).withColumn("segment", F.when(seg < 200, F.lit(0)).otherwise(F.least(F.floor(i / seg), F.lit(k - 1))).cast("int"))
    per = backtest.metrics(rows, bar_seconds, (*keys, "segment"), mdd_floor, calmar_cap)
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.sum((F.col("total_return") > 0).cast("long")).alias("positive_segments"), F.median("sharpe").alias("median_sharpe"),
        F.coalesce(F.stddev_pop("sharpe"), F.lit(0.0)).alias("std_sharpe"), F.count("sharpe").alias("usable"), dominance("pnl_sum").alias("dominance"),
    )


def dominance(column: str):
    total = F.sum(column)
    return F.when(total > 1e-12, F.max(column) / total).when(total < -1e-12, F.min(column) / total).otherwise(F.lit(1.0))


def warmup(genomes: DataFrame) -> DataFrame:
    """(genome_id, warmup): the longest window of the genome and its gate, and 3, from 2 to 5000."""
    longest = F.greatest(F.array_max(F.transform("genome.features", lambda p: p["window"])), F.col("genome.vol_gate.window"))
    return genomes.select("genome_id", F.greatest(F.lit(2), F.least(F.lit(5000), longest + 3)).cast("bigint").alias("warmup"))


def cv_slices(sizes: DataFrame, genomes: DataFrame, cfg: EvalConfig) -> tuple[DataFrame, DataFrame]:
    """Slices (series_id, genome_id, slice_id, ...) of every fold and scenario, and (…, error) of genomes without folds."""
    lo = cfg.cv_min_fold_bars
    base = sizes.crossJoin(F.broadcast(warmup(genomes)))
    start = F.least(F.greatest(F.lit(0), F.col("warmup")), F.col("n") - 2).cast("bigint")
    base = base.withColumn("start", start).withColumn("n_eff", F.col("n") - F.col("start"))
    asked = max(2, cfg.cv_folds)
    k = F.when(F.col("n_eff") < asked * lo, F.greatest(F.lit(2), F.floor(F.col("n_eff") / lo))).otherwise(F.lit(asked)).cast("bigint")
    base = base.withColumn("k", k).withColumn("seg", F.floor(F.col("n_eff") / F.col("k")).cast("bigint"))
    error = F.when(F.col("seg") < lo, F.lit("cv_fold_too_short"))
    errors = base.select("series_id", "genome_id", error.alias("error"))
    folds = base.where(error.isNull()).withColumn("fold", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    a = F.col("start") + F.col("fold") * F.col("seg")
    b = F.when(F.col("fold") < F.col("k") - 1, a + F.col("seg")).otherwise(F.col("n"))
    folds = folds.withColumns({"lo": a, "hi": b - 1}).where((b - a >= lo) & (b - a >= 6))
    scenarios = F.array(
        F.struct(F.lit("base").alias("name"), F.lit(0).alias("delay"), F.lit(1.0).alias("cost_mult")),
        F.struct(F.lit("delay").alias("name"), F.lit(cfg.cv_delay_bars).alias("delay"), F.lit(1.0).alias("cost_mult")),
        F.struct(F.lit("cost").alias("name"), F.lit(0).alias("delay"), F.lit(float(cfg.stress_cost_mult)).alias("cost_mult")),
    )
    out = folds.withColumn("s", F.explode(scenarios))
    slice_id = F.concat_ws(":", F.lpad(F.col("fold").cast("string"), 4, "0"), F.col("s.name"))
    return out.select("series_id", "genome_id", slice_id.alias("slice_id"), "lo", "hi", "s.delay", "s.cost_mult"), errors


def cv_folds(pos: DataFrame, sizes: DataFrame, genomes: DataFrame, cfg: EvalConfig, bar_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Fold metrics per scenario: (series_id, genome_id, fold, scenario, sharpe, total_return, max_drawdown), and errors."""
    slices, errors = cv_slices(sizes, genomes, cfg)
    rows = backtest.pnl(backtest.sliced(pos, slices, ("series_id", "genome_id")), cfg.costs, delays=(0, cfg.cv_delay_bars))
    per = backtest.metrics(rows, bar_seconds, backtest.KEYS, cfg.mdd_floor, cfg.calmar_cap)
    part = F.split("slice_id", ":")
    return per.where(F.col("error").isNull()).select("series_id", "genome_id", part[0].cast("int").alias("fold"), part[1].alias("scenario"), "sharpe", "total_return", "max_drawdown"), errors


def cv_summary(folds: DataFrame, errors: DataFrame) -> DataFrame:
    """Per genome: error, folds, medians, minima, standard deviation, positive folds and arrays by fold."""
    wide = folds.groupBy("series_id", "genome_id", "fold").pivot("scenario", list(CV_SCENARIOS)).agg(F.first("sharpe").alias("sh"), F.first("total_return").alias("rt"))
    wide = wide.where(F.col("base_sh").isNotNull() & F.col("delay_sh").isNotNull() & F.col("cost_sh").isNotNull())
    by_fold = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("fold", c))), lambda x: x[c])
    per = wide.groupBy("series_id", "genome_id").agg(
        F.count("*").alias("folds"), F.median("base_sh").alias("median_sharpe"), F.min("base_sh").alias("min_sharpe"), F.stddev_pop("base_sh").alias("std_sharpe"),
        F.median("delay_sh").alias("median_sharpe_delay"), F.min("delay_sh").alias("min_sharpe_delay"), F.median("cost_sh").alias("median_sharpe_cost"), F.min("cost_sh").alias("min_sharpe_cost"),
        F.sum((F.col("base_rt") > 0).cast("long")).alias("positive_folds"), F.sum((F.col("cost_rt") > 0).cast("long")).alias("positive_folds_cost"),
        by_fold("base_sh").alias("fold_sharpes"), by_fold("delay_sh").alias("fold_sharpes_delay"), by_fold("cost_sh").alias("fold_sharpes_cost"),
    )
    out = errors.join(per, ["series_id", "genome_id"], "left")
    short = F.coalesce(F.col("folds"), F.lit(0)) < 2
    return out.withColumn("error", F.coalesce("error", F.when(short, F.lit("cv_insufficient_folds"))))


def stress_grid(pos: DataFrame, sizes: DataFrame, costs: Costs, bar_seconds: int, holdout_frac: float, cost_mults=(1.0, 2.0, 3.0, 5.0), delays=(0, 1), mdd_floor: float = 0.02, calmar_cap: float = 25.0) -> DataFrame:
    """Metrics of ``stress_slices``.  Of train there is one slice, as no delay changes it, and all costs of a slice are taken over its rows at once."""
    delays, mults = list(dict.fromkeys(delays)), {f"x{c:g}": float(c) for c in cost_mults}
    slices = train_holdout(sizes, holdout_frac).where(F.col("slice_id") == "train")
    for d in delays:
        slices = slices.unionByName(train_holdout(sizes, holdout_frac, d).where(F.col("slice_id") == "holdout").withColumn("slice_id", F.lit(f"d{d}_holdout")))
    rows = backtest.pnl(backtest.sliced(pos, slices), costs, delays=(0, *delays))
    rows = rows.withColumns({name: backtest.net(costs, F.lit(c)) for name, c in mults.items()})
    per = backtest.metrics(rows, bar_seconds, backtest.KEYS, mdd_floor, calmar_cap, values=tuple(mults))
    names = F.when(F.col("slice_id") == "train", F.array(*[F.lit(f"d{d}_train") for d in delays])).otherwise(F.array("slice_id"))
    per = per.withColumn("slice_id", F.explode(names))
    name = per["value"] if "value" in per.columns else F.lit(next(iter(mults)))
    return per.withColumn("slice_id", F.concat_ws("_", name, "slice_id")).drop("value")
